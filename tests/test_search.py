"""Search where no index is stored: one pass over the documents, no index written, the rows of SQL; words of odd texts."""

import re
import shutil
from functools import reduce
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from test_star import ORACLE, QUERIES, SF, _plain

from tesela.functions.text import tokens, unaccented
from tesela.operators import search
from tesela.operators.index import Index
from tesela.sources.star import Star

ONE_PASS = ["fts_phrase", "fts_match", "fts_prefix", "fts_topk", "fts_postings", "cq_49", "fts_column", "cq_29"]


@pytest.fixture(scope="module")
def fresh(tmp_path_factory):
    """Tables that no index has been made of."""
    return shutil.copytree(SF, tmp_path_factory.mktemp("star") / "sf")


def _rows(rows):
    return sorted(rows, key=repr)


def _shown(columns, rows):
    """Rows as texts, columns by name."""
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", ONE_PASS)
def test_a_query_writes_no_index(spark, fresh, name):
    made = lambda: set(Path("/tmp/checkpoints").glob("tesela-index/*"))
    before = made()
    df = QUERIES[name](spark, str(fresh))
    got = _shown(df.columns, df.collect())
    assert made() == before and Star(spark, str(fresh)).stored is None
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    sql = con.execute(ORACLE[name])
    assert got[1] and got == _shown([d[0] for d in sql.description], sql.fetchall())


def test_an_index_that_is_stored_is_used(spark, fresh):
    other = shutil.copytree(fresh, fresh.parent / "indexed")
    star = Star(spark, str(other))
    assert star.stored is None and star.index.exists() and star.stored is not None
    plan = QUERIES["fts_phrase"](spark, str(other))._jdf.queryExecution().executedPlan().toString()
    assert "postings" in plan and "documents.parquet" not in plan
    assert _rows(QUERIES["fts_phrase"](spark, str(other)).collect()) == _rows(QUERIES["fts_phrase"](spark, str(fresh)).collect())


@pytest.mark.parametrize("name", ["fts_match", "fts_prefix", "fts_column", "cq_29"])
def test_the_jvm_compiles_each_method(spark, fresh, name):
    """It interprets methods of more than 8,000 bytes at many times the cost, and compiles none of them."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the whole plan is there before it runs
    try:
        plan = QUERIES[name](spark, str(fresh))._jdf.queryExecution().executedPlan()
        code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000, sizes


def test_a_question_on_decisions_reads_no_other_texts(spark, fresh):
    """Rows of one key with different texts too: each counts if one of them matches, as in SQL."""
    assert not re.search("c_custkey|p_partkey|conv_id|page_id", QUERIES["cq_29"](spark, str(fresh))._jdf.queryExecution().optimizedPlan().toString())
    again, con = shutil.copytree(fresh, fresh.parent / "again"), duckdb.connect()
    (again / "orders.parquet").unlink()
    con.execute(f"copy (from '{SF}/orders.parquet' union all by name select * replace ('1-URGENT' as o_orderpriority) from '{SF}/orders.parquet' where o_orderkey % 4 = 1) to '{again}/orders.parquet' (format parquet)")
    for f in again.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df, sql = QUERIES["cq_29"](spark, str(again)), con.execute(ORACLE["cq_29"])
    want = _shown([d[0] for d in sql.description], sql.fetchall())
    assert len(want[1]) > len(set(want[1])) and _shown(df.columns, df.collect()) == want


ODD = [None, "", " ", "a", "-a-", "A_b\tc\n", "Ünïcödé ẞtraße İstanbul", "éa ño", "x² ½ Ⅷ 中文 日本", "...", "a b​c", "ﬁn ŒUVRE ǅ", "ÀÉ", "o" * 300 + " O" * 300, "dz' \"q\" [^a-z] \\p $1", "̀́", "\U0001d400\U0001f600z"]


def test_words_of_odd_texts(spark):
    """Against the plain form: folded, split at what is no letter or digit."""
    plain = F.filter(F.split(unaccented(F.lower(F.coalesce("t", F.lit("")))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", tokens(F.col("t")).alias("got"), plain.alias("want")).collect()
    assert len(rows) == len(ODD) and all(r.got == r.want for r in rows), [r for r in rows if r.got != r.want]


def test_one_pass_equals_the_index_on_odd_texts(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", t, None, ODD[i - 1], f"uno {t} uno uno uno dos") for i, t in enumerate(ODD)], "path string, title string, description string, resumen string, cuerpo string")
    index = Index(spark, str(tmp_path / "i")).build(docs)
    for q in ["uno", '"uno uno"', '"uno uno un"*', "a", "unico*", "istanbul", "uno NOT a", "title:a OR dos", "eano*", "x²", "中文", "none"]:
        assert _rows(index.matching(q).collect()) == _rows(search.matching(docs, q).collect()), q
        got, want = ({r.path: r.relevancia for r in x.collect()} for x in (search.scored(docs, q), index.scored(q)))
        assert got == pytest.approx(want), q
    assert _rows(map(tuple, index.postings().collect())) == _rows(map(tuple, search.postings(docs).collect()))


def test_columns_are_looked_at_together_and_matched_apart(spark):
    docs = spark.createDataFrame([("a", "del uno", "dos", None, None), ("b", "ñ", None, "UNO  dos", "uno"), ("c", "uno dosX", "Σ", "uno\ndos", None), ("d", None, None, None, None)], "path string, title string, description string, resumen string, cuerpo string")
    found = lambda q: sorted(r.path for r in search.matching(docs, q).collect())
    assert found('"uno dos"') == ["b", "c"] and found("uno dos") == ["a", "b", "c"] and found("title:uno NOT dos") == [] and found("n OR σ") == ["b", "c"] and found("uno NOT title:del") == ["b", "c"]


def test_types_whose_titles_cannot_have_a_word_are_not_read(spark, fresh):
    assert not re.search("conv_id|page_id|doc_id", QUERIES["fts_column"](spark, str(fresh))._jdf.queryExecution().optimizedPlan().toString())
    others = [docs.filter(~F.col(c).eqNullSafe(F.concat(F.lit(f"{constant} "), rest))).select("path") for docs, made in Star(spark, str(fresh)).texts() for c, (constant, rest) in made.items()]
    assert len(others) == 22 and reduce(DataFrame.unionByName, others).count() == 0


def test_columns_made_of_others_are_matched_as_texts_are(spark):
    keys = spark.createDataFrame([(k, t) for k in (5, -51, 0, None) for t in (None, "uno 5", "Decisión", "x5 urgente, URGENT")], "key bigint, cuerpo string")
    docs = keys.selectExpr("concat(key, '-', cuerpo) path", "key", "concat('Decision ', key) title", "concat('Documento Decision ', key) description", "substr(cuerpo, 1, 8) resumen", "cuerpo")
    named = docs.withColumn("title", F.col("cuerpo")).withColumn("description", F.concat(F.lit("Documento "), "title"))
    numbered = {"title": ("Decision", "key"), "description": ("Documento Decision", "key")}
    for rows, made in ((docs, numbered), (docs.withColumn("key", F.col("key").cast("string")), numbered), (named, {"description": ("Documento", "title")})):
        for q in ["5", "5*", "51", "decision", "deci*", "documento NOT decision", "NOT 5 documento", "title:decision NOT urgent", "urgent OR 0", '"documento decision"', '"decision 5"*', "description:uno", "x5", "²", "resumen:urg*", "uno NOT title:uno"]:
            found = lambda m: _rows(search.matching(rows.withColumn("path", F.struct("path", "key", "cuerpo")), q, m).collect())  # noqa: B023, E731
            assert found(made) == found(None), q


def test_decisions_on_a_subject_meet_by_number(spark, fresh):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["cq_29"](spark, str(fresh))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert (dealt := re.findall(r"hashpartitioning\((.*?), \d+\)", plan)) and all(re.fullmatch(r"(key|num)#\d+L", x) for x in dealt), dealt
    assert "dec-" not in plan
