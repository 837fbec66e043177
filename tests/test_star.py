"""Every query of the corpus model over the star tables against its DuckDB counterpart, and what holds of the plans."""

import duckdb
import pytest

from tesela.operators import search
from tesela.plans import catalog
from tesela.plans.questions import PARAMS, QUESTIONS
from tesela.plans.views import VIEWS
from tesela.sources.star import TABLES, Star

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    return "null" if v is None else format(v, ".6g") if isinstance(v, float) else str(v)


QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()
#: Tables are read by all else; views and questions are compared row by row.
COMPARED = [q for q in ORACLE if not q.startswith("tbl_")] + ["tbl_documentos", "tbl_iniciativa_personas", "tbl_documentos_verified", "tbl_consultas"]


@pytest.mark.parametrize("name", COMPARED)
def test_equals_duckdb(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    rows = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    at = [sql.columns.index(c) for c in columns]
    assert rows == sorted(tuple(_plain(r[i]) for i in at) for r in sql.fetchall())


def test_the_model_has_all_its_parts():
    assert len(TABLES) == 22 and len(VIEWS) == 3 and len(QUESTIONS) == 42


@pytest.mark.parametrize("name", ["adv_03", "adv_06", "adv_11", "cq_50"])
def test_references_join_by_hash(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_other_types_are_not_read(spark):
    plan = QUESTIONS["cq_21"](Star(spark, SF), PARAMS)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan and "c_custkey" not in plan


def test_order_of_results(spark):
    star = Star(spark, SF)
    ranked = [r.relevancia for r in search.ranked(star.busqueda, "was", 10).collect()]
    assert ranked == sorted(ranked) and ranked[0] < 0
    dates = [r.fecha for r in QUESTIONS["cq_47"](star, PARAMS).collect()]
    assert dates == sorted(dates, reverse=True)


DOCS = [("a", "Migración del ERP", "plan", "uno dos tres", "prueba_x y uno"), ("b", "otra", "migracion", "", "dos uno"), ("c", None, None, None, "tres dos uno uno"), ("d", "migrar", "", "", "")]


@pytest.mark.parametrize(("query", "want"), [("MIGRACIÓN", "ab"), ("migracion plan", "a"), ("migr*", "abd"), ("uno NOT plan", "bc"), ('"dos uno"', "bc"), ('"dos tres"', "a"), ("title:migracion", "a"), ("erp OR tres", "ac"), ("prueba", "a"), ("nada", "")])
def test_query_language(spark, query, want):
    docs = spark.createDataFrame(DOCS, "path string, title string, description string, resumen string, cuerpo string")
    assert sorted(r.path for r in search.matching(docs, query).collect()) == list(want)


@pytest.mark.parametrize("query", ["", "a-b", "NOT x", "x NOT", '"x', "otra:x", "x OR"])
def test_malformed_queries(query):
    with pytest.raises(ValueError):
        search.parse(query)


def test_scores_are_those_of_sqlite(spark):
    """SQLite's full-text index is a second reference for the ranking."""
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(path unindexed, title, description, resumen, cuerpo, tokenize = 'unicode61 remove_diacritics 2')")
    rows = [(p, *(x or "" for x in rest)) for p, *rest in DOCS] + [(f"n{i}", "relleno", "nada", "algo más", "cosa " * i) for i in range(6)]
    con.executemany("insert into t values (?, ?, ?, ?, ?)", rows)
    want = dict(con.execute("select path, bm25(t) from t where t match 'uno dos'").fetchall())
    docs = spark.createDataFrame(rows, "path string, title string, description string, resumen string, cuerpo string")
    got = {r.path: r.relevancia for r in search.scored(docs, "uno dos").collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_without_the_llm_folders(spark, tmp_path):
    """The entry and all other queries work where the llm folders and the pipeline were left out."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tesela", tmp_path / "tesela", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE)), "False"], said.stderr
