"""The stored search index against the scan, through builds, changes and compaction; the cost model; the command line."""

import pytest
from test_rules import DECISION, SOUND, D, doc
from test_star import DOCS, SF

from tesela.__main__ import main
from tesela.operators import search
from tesela.operators.index import Index
from tesela.plans import cost
from tesela.sources.bundle import Bundle
from tesela.sources.star import Star
from pyspark.sql import functions as F

SCHEMA = "path string, title string, description string, resumen string, cuerpo string"
QUERIES = ["MIGRACIÓN", "migracion plan", "migr*", "uno NOT plan", '"dos uno"', '"dos tres"', '"tres dos un"*', "title:migracion", "erp OR tres", "nada", "uno uno", "cuerpo:uno"]


def held(index, docs):
    for q in QUERIES:
        assert sorted(r.path for r in index.matching(q).collect()) == sorted(r.path for r in search.matching(docs, q).collect()), q
        got, want = ({r.path: r.relevancia for r in x.collect()} for x in (index.scored(q), search.scored(docs, q)))
        assert got == pytest.approx(want), q
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, search.postings(docs).select("term", "path", "field", "tf").collect()))


def test_index_equals_the_scan(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    index = Index(spark, str(tmp_path / "i"))
    with pytest.raises(LookupError):
        index.matching("uno")
    held(index.build(docs, ["title"]), docs)
    changed = [("b", "otra vez", None, None, "uno uno uno"), ("e", "Migración nueva", "", "plan", "tres dos uno")]
    index.change(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([("c",)], "path string"))
    after = spark.createDataFrame([d for d in DOCS if d[0] not in "bc"] + changed, SCHEMA)
    held(index, after)
    index.change(spark.createDataFrame([changed[0][:1] + ("una", None, None, "dos uno")], SCHEMA), spark.createDataFrame([("z",)], "path string"))
    last = spark.createDataFrame([d for d in DOCS if d[0] not in "bc"] + [("b", "una", None, None, "dos uno"), changed[1]], SCHEMA)
    held(index, last)
    held(index.compacted(), last)
    top = index.ranked("uno", 2).collect()
    assert len(top) == 2 and top[0].relevancia <= top[1].relevancia and top[0].__fields__ == ["path", "relevancia", "title"]
    assert index.ranked("nadaquehaya", 2).collect() == []
    assert Index(spark, str(tmp_path / "e")).build(docs.limit(0)).scored("uno").collect() == []


def test_index_reads_the_terms_letter_alone(spark):
    plan = Star(spark, SF).index.matching("was")._jdf.queryExecution().executedPlan().toString()
    assert "initial" in plan.split("PartitionFilters")[1][:300] and "EqualTo(term,was)" in plan


def test_cost_model_and_scan(spark):
    texts = SOUND | {D: doc("Decision", DECISION), "roto.md": "---\ntype: 'X'\n: :\n\t- [\nsin cierre", "vacio.md": ""}
    scan = cost.scanned(Bundle.of_texts(spark, texts).content)
    rows = {r.path: r for r in scan.collect()}
    assert len(rows) == len(texts) and rows["roto.md"].type == "X" and rows["vacio.md"].type is None and rows[D].chars == len(texts[D])
    row = cost.model(scan.select("path", "chars", F.lit(40).alias("line"))).first()
    t = sorted((len(x) // 4 for x in texts.values()), reverse=True)
    assert (row.docs, row.tokens, row.reading, row.verdict) == (len(texts), sum(t), sum(t[:5]), "unreliable")
    assert {(r.type, r.field): r.n for r in cost.catalogue(scan).collect()}["Decision", "fecha"] == 2
    assert {r.dir for r in cost.without_index(scan).collect()} == {"02-areas/personas", "01-proyectos/x", "01-proyectos/x/02-decisiones"}
    for docs, verdict in ((300, "upkeep"), (2, "unreliable")):
        rows = spark.range(docs).select(F.concat(F.lit("a/d"), "id", F.lit(".md")).alias("path"), F.lit(4_000).alias("chars"), F.lit(4).alias("line"))
        assert cost.model(rows).first().verdict == verdict


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "b"
    for path, text in (SOUND | {D: doc("Decision", DECISION, description="una: dos")}).items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    run = lambda *words: (main(list(words), spark), capsys.readouterr().out)
    code, out = run("validate", str(root), "--now", "2026-06-14T00:00:00Z")
    assert code == 1 and "V18" in out and "V12" in out
    code, out = run("fix", str(root), "--now", "2026-06-14T00:00:00Z")
    assert D in out and "GOALS.md" in out and run("fix", str(root), "--now", "2026-06-14T00:00:00Z")[1] == ""
    code, out = run("validate", str(root), "--json", "--now", "2026-06-14T00:00:00Z")
    assert code == 0 and out == ""
    assert "dec-1.md" in run("search", str(root), "título")[1]
    assert run("project", str(root), "--to", str(tmp_path / "p"))[1].startswith("v-")
    assert run("place", "Reunion", "proyecto=x") == (0, "01-proyectos/x/01-reuniones\n") and "type: Plan" in run("template", "Plan")[1]
