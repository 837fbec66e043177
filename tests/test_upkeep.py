"""Derived files, repair, seals, manifests, dumps, profiles and a new bundle."""

import hashlib

import pytest
from test_rules import DECISION, SOUND, D, doc

from tesela.plans import derived, upkeep
from tesela.plans.contract import Contract, ContractError, holds
from tesela.plans.rules import findings
from tesela.sources import markdown
from tesela.sources.bundle import Bundle, files
from pyspark.sql import functions as F


def texts_of(content):
    return {r.path: bytes(r.content).decode() for r in content.collect()}


QUESTIONS = {
    f"01-proyectos/x/04-preguntas/q{i}.md": doc("Pregunta", f"proyecto: x\nestado: {e}\nbloqueante: {b}\ncreated: 2026-06-{d}\n" + (f"responsable: {w}\n" if w else ""), title=t)
    for i, (e, b, d, w, t) in enumerate([("abierta", "false", "01", "/02-areas/personas/ana.md", "uno | dos"), ("abierta", "true", "10", "/no/hay.md", "tres"), ("respondida", "true", "02", "", "cuatro"), ("en-progreso", "false", "04", "libre", "cinco")])
}


def test_derived_table_graph_and_index(spark):
    bundle, contract = Bundle.of_texts(spark, SOUND | QUESTIONS | {"02-areas/personas/luis.md": doc("Persona", "rol: r\nreports_to: /02-areas/personas/ana.md\n", title='Luis "L"')}), Contract()
    got = {s.path: derived.texts(derived.lines(bundle, contract, s, "2026-06-14"))[s.path] for s in derived.SPECS}
    assert got["PREGUNTAS-ABIERTAS.md"] == """# Preguntas abiertas

| Pregunta | Proyecto | Responsable | Días |
|---|---|---|---|
| ⛔ [tres](/01-proyectos/x/04-preguntas/q1.md) | x | hay | 4 |
| [uno \\| dos](/01-proyectos/x/04-preguntas/q0.md) | x | Un título | 13 |
| [cinco](/01-proyectos/x/04-preguntas/q3.md) | x | libre | 10 |
"""
    assert got["GOALS.md"].split("\n")[2:9] == ["## Asignadas", "", "| Iniciativa | Periodo | Estado |", "|---|---|---|", "| — | | |", "", "## Personales"] and "| [Un título](/01-proyectos/x/CONTEXT.md) | 2026-Q1 | iniciando |" in got["GOALS.md"]
    assert "    02_areas_personas_ana_md --> 02_areas_personas_luis_md\n" in got["ORGANIGRAMA.md"] and "[\"Luis 'L'\"]" in got["ORGANIGRAMA.md"] and "* [Un título](/02-areas/personas/ana.md)" in got["ORGANIGRAMA.md"]
    index = derived.texts(derived.index_lines(bundle))
    assert index["01-proyectos/x/index.md"] == "* [Un título](CONTEXT.md) - una\n\n## Carpetas\n\n* [02-decisiones/](02-decisiones/index.md)\n* [04-preguntas/](04-preguntas/index.md)\n"
    assert set(index) == {"01-proyectos/x/index.md", "01-proyectos/x/02-decisiones/index.md", "01-proyectos/x/04-preguntas/index.md", "02-areas/personas/index.md"}


def test_empty_corpus_has_its_empty_tables(spark):
    bundle = Bundle.of_texts(spark, {"index.md": "x"})
    assert "| — | | | |" in derived.texts(derived.lines(bundle, Contract(), derived.SPECS[0], "2026-06-14"))["PREGUNTAS-ABIERTAS.md"]
    assert derived.index_lines(bundle).count() == 0


def test_repair_reaches_a_fixed_point(spark):
    broken = SOUND | QUESTIONS | {D: doc("Decision", DECISION, description="una: dos # y", title="yes"), "GOALS.md": "---\ntype: Indice\n---\nviejo\n", "02-areas/personas/index.md": "viejo", "malo.md": "---\na: [1\n"}
    once = upkeep.fixed(Bundle.of_texts(spark, broken).content, Contract(), "2026-06-14")
    texts = texts_of(once)
    meta = markdown.parsed(texts[D]).meta
    assert meta["description"] == "una: dos" and meta["title"] == "yes" and 'title: "yes"' in texts[D] and "# y\n" in texts[D]
    assert texts["GOALS.md"].startswith("---\ntype: Indice\n---\n\n# Metas\n") and texts["malo.md"] == broken["malo.md"]
    rules = {r.rule for r in findings(Bundle.of_texts(spark, texts), "2026-06-14T00:00:00Z").collect()}
    assert not rules & {"V12", "V13"}
    assert texts_of(upkeep.fixed(Bundle.of_texts(spark, texts).content, Contract(), "2026-06-14")) == texts


def test_seal():
    text = doc("Decision", DECISION, resumen_hash="0")
    done = upkeep.sealed(text)
    assert markdown.parsed(done).meta["resumen_hash"] == markdown.body_hash(text) and upkeep.sealed(done) == done
    assert markdown.parsed(upkeep.sealed(doc("Decision", DECISION, resumen_hash=None))).meta["resumen_hash"] and upkeep.sealed("sin nada") == "sin nada"
    windows = doc("Decision", DECISION, resumen_hash="0").replace("\n", "\r\n")
    assert upkeep.sealed(windows).count("\r\n") == windows.count("\n") and upkeep.sealed(windows).count("\n") == windows.count("\n")


def test_manifest(spark):
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = ["# Crudos", "| archivo | sha256 | bytes | día | origen |", "|---|---|---|---|---|", f"| `a b.pdf` | {h('a')} | 1 | 2026-01-01 | correo |", f"| b.pdf | {h('x')} | 1 | 2026-01-01 | |", f"| b.pdf | {h('b')} | 1 | 2026-01-02 | |", f"| c.pdf | {h('z')} | 1 | | |", "| d.pdf | - | | | |", f"| e.pdf | {h('e')} | 5 | | |", "| mal |"]
    stated = upkeep.manifest(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert stated.count() == 6 and stated.filter("file = 'a b.pdf'").first().origin == "correo"
    real = spark.createDataFrame([(n, bytearray(t.encode())) for n, t in (("a b.pdf", "a"), ("b.pdf", "b"), ("c.pdf", "c"), ("d.pdf", "d"), ("f.pdf", "f"))], "path string, content binary")
    assert {r.file: r.state for r in upkeep.integrity(stated, real).collect()} == {"a b.pdf": "ok", "b.pdf": "ok", "c.pdf": "changed", "d.pdf": "no hash", "e.pdf": "missing", "f.pdf": "orphan"}


def test_dumps_and_reports(spark):
    a = spark.createDataFrame([(2, None), (1, "x"), (1, "x")], "n int, t string")
    assert [r.row for r in upkeep.dump(a).collect()] == ['{"n":1,"t":"x"}', '{"n":1,"t":"x"}', '{"n":2,"t":null}']
    assert upkeep.same(a, a.repartition(3)) and not upkeep.same(a, a.distinct())
    found = findings(Bundle.of_texts(spark, SOUND | {D: doc("Decision", DECISION, "[n](/no/hay.md)", status="stable", stale_after="2026-01-01T00:00:00Z")}), "2026-06-14T00:00:00Z")
    assert {r.rule: (r.error, r.warning, r.info, r.total) for r in upkeep.by_severity(found).collect() if r.rule in ("V10", "V15")} == {"V10": (0, 0, 1, 1), "V15": (0, 1, 0, 1)}
    assert any('"rule":"V15"' in r.finding for r in upkeep.as_json(found).collect())


def test_profiles_and_periods(spark):
    table = lambda d: spark.createDataFrame([(p, bytearray(t.encode())) for p, t in d.items()], "path string, content binary")
    got = {r.slug: (bytes(r.content).decode(), r.origin) for r in upkeep.profiles(table({"roles/dev.md": "a", "roles/pm.md": "b", "roles/x.txt": "c"}), table({"mis/pm.md": "d"})).collect()}
    assert got == {"dev": ("a", "base"), "pm": ("d", "own")}
    paths = spark.createDataFrame([("04-archivo/2026-Q1/x/CONTEXT.md",), ("04-archivo/2026-Q1/y/04-archivo/2026-Q1/z.md",), ("01-proyectos/x.md",)], "path string")
    assert [tuple(r) for r in upkeep.archive_periods(paths).collect()] == [("2026-Q1", 2)]


def test_conditions(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "1")], "x string, y string")
    test = lambda when: [r.x for r in rows.filter(holds(when, F.col)).collect()]
    assert test({"x": "a"}) == ["a"] and test({"x": ["a", "b"], "y": "2"}) == ["b"] and test({"x": {"not": "a"}}) == ["b", None] and test({"x": {"not": ["a", "b"]}}) == [None] and test({}) == ["a", "b", None]
    with pytest.raises(ContractError):
        holds({"x": {"no": 1}}, F.col)


def test_choices_of_a_contract():
    c = Contract().extended('{"types": {"Riesgo": {"fields": {"nivel": {"kind": "text"}, "dueño": {"kind": "text"}}, "floor": "restricted"}}, "floors": {"Decision": "confidential"}, "conditions": [["Riesgo", {"nivel": {"not": "bajo"}}, ["dueño"]]], "actors": ["bot:[a-z]+"]}')
    assert c.floors["Riesgo"] == "restricted" and c.floors["Decision"] == "confidential" and c.conditions[-1][0] == "Riesgo" and c.actors[-1] == "bot:[a-z]+"
    for bad in ('{"floors": {"Persona": "public"}}', '{"floors": {"Nada": "public"}}', '{"conditions": [["Riesgo", {}, []]]}', '{"conditions": [["Plan", {"nada": 1}, []]]}', '{"types": {"R": {"otro": 1}}}'):
        with pytest.raises(ContractError):
            Contract().extended(bad)
    assert c.role_shapes("Iniciativa", "archivo") == ["^04\\-archivo/[^/]+/[^/]+$"] and c.role_shapes("Plan", "activas") == c.place_shapes("Plan")
    with pytest.raises(ContractError):
        c.role_shapes("Iniciativa", "nadie")
    assert "## Riesgo" in c.document() and "CREATE TABLE IF NOT EXISTS riesgo" in c.ddl() and len(Contract().tables()) == 22


def test_tables_apply_as_statements(spark):
    from tesela.sources.star import TABLES

    assert set(Contract().tables()) == set(TABLES)
    for name, fields in Contract().tables().items():
        assert spark.createDataFrame([], fields).schema == fields, name
    parser = spark._jsparkSession.sessionState().sqlParser()
    for statement in Contract().ddl().split(";")[:-1]:
        assert "CreateTable" in parser.parsePlan(statement).getClass().getName()


def test_strict_types(spark):
    from tesela.plans.constraints import strict
    from tesela.sources.star import Star

    bundle = Bundle.of_texts(spark, SOUND)
    assert strict(bundle) == [] and strict(Star(spark, "/root/testdata/sf0.001")) == []
    wrong = {"persona": bundle["persona"].withColumn("rol", F.lit(1)).drop("equipo").withColumn("nuevo", F.lit("x"))}
    assert strict(wrong) == [("persona", "rol", "string", "int"), ("persona", "equipo", "string", None), ("persona", "nuevo", "none", "string")]


def test_a_new_bundle(spark, tmp_path):
    root = str(tmp_path / "nuevo")
    made = upkeep.begin(spark, root)
    assert "schema/ddl.sql" in made and "index.md" in made and upkeep.begin(spark, root) == []
    assert not upkeep.write_if_changed(spark, f"{root}/log.md", "# Registro\r\n") and upkeep.write_if_changed(spark, f"{root}/log.md", "otro")
    content = files(spark, root)
    assert upkeep.stale_artifacts(content, Contract()).count() == 0
    assert {r.rule for r in findings(Bundle(content)).collect()} <= {"V13"}


def test_capabilities(spark):
    assert {r.name: r.ok for r in upkeep.capabilities(spark).collect()} == dict.fromkeys(["window", "recursion", "json", "digest", "dates", "lists", "python", "adaptive", "utc", "shared folder"], True)
