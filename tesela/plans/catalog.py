"""All queries of the corpus model by name, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.star import TABLES, Star
from . import checked, oracle
from .extras import EXTRAS
from .questions import PARAMS, QUESTIONS
from .views import VIEWS


def _query(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Star(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"tbl_{t}": _query(lambda c, t=t: c[t]) for t in TABLES}
    out |= {f"view_{v}": _query(f) for v, f in VIEWS.items()}
    out |= {q: _query(lambda c, f=f: f(c, PARAMS)) for q, f in (QUESTIONS | EXTRAS).items()}
    return out | checked.CHECKED


def oracle_sql() -> dict[str, str]:
    out = {f"tbl_{t}": f"select * from {t}" for t in TABLES} | {f"view_{v}": f"select * from {v}" for v in VIEWS}
    out |= {q: sql.format(**PARAMS) if "{" in sql else sql for q, sql in oracle.QUERIES.items()}
    out |= checked.SQL
    return {q: oracle.with_tables(sql) for q, sql in out.items()}
