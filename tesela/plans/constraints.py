"""What a relational engine would enforce, as queries: a violation is a row (check, tabla, columna, doc)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import Contract

PARENTS = {"decision_decisores": "decision", "iniciativa_sistemas": "iniciativa", "iniciativa_personas": "iniciativa", "reunion_asistentes": "reunion"}
CHILDREN = ["documentos_tags", "documentos_verified", "documentos_sources", *PARENTS]


def _has(c, table: str) -> bool:
    """A dict may hold some of the tables; other corpora have all."""
    return not isinstance(c, dict) or table in c


def _kinds(c, contract: Contract):
    """(table, key column, type or None)."""
    return [x for x in [("documentos", "path", None), *((k.lower(), "doc", k) for k in contract.types)] if _has(c, x[0])]


def _row(rows: DataFrame, check: str, table: str, column: str | Column, key: str) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(table).alias("tabla"), (F.lit(column) if isinstance(column, str) else column).alias("columna"), F.col(key).alias("doc"))


def _flagged(rows: DataFrame, check: str, table: str, key: str, tests: dict[str, Column]) -> DataFrame | None:
    """One read of a table for all its columns' tests."""
    if not tests:
        return None
    found = F.array_compact(F.array(*(F.when(t, F.lit(c)) for c, t in tests.items())))
    return _row(rows.select(key, F.explode(found).alias("__c")), check, table, F.col("__c"), key)


def _union(frames: list[DataFrame | None]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f for f in frames if f is not None])


def not_null(c, contract: Contract | None = None) -> DataFrame:
    contract = contract or Contract()
    return _union([_flagged(c[t], "not_null", t, key, {n: F.col(n).isNull() for n, (_, null) in contract.columns(kind).items() if not null and n != key}) for t, key, kind in _kinds(c, contract)])


def enums(c, contract: Contract | None = None) -> DataFrame:
    contract = contract or Contract()
    fields = lambda kind: contract.common if kind is None else contract.types[kind]
    return _union([_flagged(c[t], "enum", t, key, {n: F.col(n).isNotNull() & ~F.col(n).isin(*f.values) for n, f in fields(kind).items() if f.kind == "enum"}) for t, key, kind in _kinds(c, contract)])


def keys(c, contract: Contract | None = None) -> DataFrame:
    twice = lambda rows, *by: rows.groupBy(*by).count().filter("count > 1")
    contract = contract or Contract()
    return _union([_row(twice(c[t], key), "pk", t, key, key) for t, key, _ in _kinds(c, contract)] + [_row(twice(c[t], "doc", "idx"), "pk", t, "idx", "doc") for t in CHILDREN if _has(c, t)])


def unique(c, contract: Contract | None = None) -> DataFrame:
    """Initiatives whose project another has too: all but the first by path."""
    from pyspark.sql.window import Window

    first = F.row_number().over(Window.partitionBy("proyecto").orderBy("doc"))
    return _row(c["iniciativa"].withColumn("__n", first).filter("__n > 1"), "unique", "iniciativa", "proyecto", "doc")


def parents(c, contract: Contract | None = None) -> DataFrame:
    contract = contract or Contract()
    docs = c["documentos"].select(F.col("path").alias("doc"), "type")
    # a type's documents are looked for among those of the type, which leaves all other scans out
    out = [_row(c[k.lower()].join(docs.filter(F.col("type") == k), "doc", "left_anti"), "fk", k.lower(), "doc", "doc") for k in contract.types if _has(c, k.lower())]
    out += [_row(c[t].join(c[p].select("doc"), "doc", "left_anti"), "fk", t, "doc", "doc") for t, p in PARENTS.items() if _has(c, t)]
    common = [c[t].select(F.lit(t).alias("__t"), "doc") for t in CHILDREN if t not in PARENTS and _has(c, t)]
    if common:  # one join for all of them
        out.append(_union(common).join(docs, "doc", "left_anti").select(F.lit("fk").alias("check"), F.col("__t").alias("tabla"), F.lit("doc").alias("columna"), "doc"))
    return _union(out)


def strict(c, contract: Contract | None = None) -> list[tuple[str, str, str, str | None]]:
    """(table, column, declared type, type there is) where a table's columns are not those of the contract; None where a column is missing. Whole
    numbers of another width count as equal."""
    contract = contract or Contract()
    whole = {"tinyint": "int", "smallint": "int", "bigint": "int"}
    out = []
    for name, declared in contract.tables().items():
        if not _has(c, name):
            continue
        there = {f.name: whole.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in c[name].schema}
        out += [(name, f.name, f.dataType.simpleString(), there.get(f.name)) for f in declared if there.get(f.name) != f.dataType.simpleString()]
        out += [(name, extra, "none", there[extra]) for extra in there if extra not in declared.names]
    return out


CHECKS = {"chk_not_null": not_null, "chk_enum": enums, "chk_pk": keys, "chk_unique": unique, "chk_fk": parents}


def violations(c, contract: Contract | None = None) -> DataFrame:
    return _union([f(c, contract) for name, f in CHECKS.items() if name != "chk_unique" or _has(c, "iniciativa")])
