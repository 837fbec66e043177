"""Each rule has a document that it passes and one that it names."""

import pytest

from tesela.plans import upkeep
from tesela.plans.contract import Contract
from tesela.plans.rules import RULES, Context, findings
from tesela.sources.bundle import Bundle
from tesela.sources.markdown import body_hash


def doc(kind, extra="", body="Texto.", title="Un título", **common):
    text = f"\n# {title}\n\n{body}\n"
    fields = {"title": title, "description": "una", "tags": "[a]", "classification": "confidential" if kind in ("Persona", "Insumo") else "internal", "generated": "{by: human:ana, at: 2026-01-01T00:00:00Z}", "resumen": "algo", "resumen_hash": body_hash(text), "procedencia": "manual"} | common
    return f"---\ntype: {kind}\n" + "".join(f"{k}: {v}\n" for k, v in fields.items() if v is not None) + f"{extra}---\n{text}"


SOUND = {
    "02-areas/personas/ana.md": doc("Persona", "rol: jefa\n"),
    "01-proyectos/x/CONTEXT.md": doc("Iniciativa", "proyecto: x\norigen: objetivo-equipo\nperiodo: 2026-Q1\nestado: iniciando\n"),
    "01-proyectos/x/02-decisiones/dec-1.md": doc("Decision", "proyecto: x\nestado: aceptada\nfecha: 2026-01-01\ndecisores: [/02-areas/personas/ana.md]\n", "Ver [x](../CONTEXT.md) y [y](https://a.b/c).\n\n# Citations\n\n[ana](/02-areas/personas/ana.md)"),
    "log-consultas.md": "## 2026-01-01\n- q — 3 docs (2 completos, 1 citados) · directa · no\n",
    "index.md": "* nada\n",
    "PERFIL.md": "---\ntype: Perfil\n---\n",
}
D = "01-proyectos/x/02-decisiones/d.md"
DECISION = "proyecto: x\nestado: aceptada\nfecha: 2026-01-01\n"
PERSON = "02-areas/personas/z.md"
SEEDED = {
    "V1": {"a.md": "---\ntype: X\n"}, "V2": {"a.md": "---\ntype:\n---\n"}, "V3": {"log.md": "## ayer\n"}, "V4": {"a.md": doc("Cosa")}, "V5": {D: doc("Decision", DECISION, resumen=None)}, "V6": {D: doc("Decision", DECISION.replace("2026-01-01", "ayer"))},
    "V7": {"01-proyectos/x/04-preguntas/q.md": doc("Pregunta", "proyecto: x\nestado: respondida\nbloqueante: false\ncreated: 2026-01-01\n")}, "V8": {D: doc("Decision", DECISION + "raro: 1\n")}, "V9": {D: doc("Decision", DECISION, "falta <esto aquí>")}, "V10": {D: doc("Decision", DECISION, "[n](/no/hay.md)")},
    "V11": {PERSON: doc("Persona", "rol: r\nreports_to: /01-proyectos/x/CONTEXT.md\n")}, "V15": {D: doc("Decision", DECISION, status="stable", stale_after="2026-01-01T00:00:00Z")}, "V16": {PERSON: doc("Persona", "rol: r\n", classification="public")}, "V17": {D: doc("Decision", DECISION + "decisores: [comité]\n")},
    "V18": {D: doc("Decision", DECISION, description="una: dos")}, "V19": {"otra/d.md": doc("Decision", DECISION)}, "V20": {D: doc("Decision", DECISION.replace("proyecto: x", "proyecto: zz"))}, "V21": {"01-proyectos/y/CONTEXT.md": doc("Iniciativa", "proyecto: y\norigen: objetivo-equipo\nperiodo: Q3-2026\nestado: iniciando\n")},
    "V22": {D: doc("Decision", DECISION, "# Citations\n\n[n](/no/hay.md)")}, "V23": {D: doc("Decision", DECISION, resumen_hash="0")}, "V24": {D: doc("Decision", DECISION + "valido_desde: 2026-02-01\nvalido_hasta: 2026-01-01\n")}, "V25": {D: doc("Decision", DECISION, procedencia="fuente")},
    "V26": {"log-consultas.md": "## 2026-01-01\n- q — 3 docs (1 completos, 2 citados) · directa · no\n- otra\n"}, "V27": {"01-proyectos/y/CONTEXT.md": SOUND["01-proyectos/x/CONTEXT.md"]},
}


@pytest.fixture(scope="module")
def sound(spark):
    """The sound documents with their derived files and schema artifacts."""
    content = Bundle.of_texts(spark, SOUND | Contract().artifacts()).content
    return {r.path: bytes(r.content).decode() for r in upkeep.fixed(content, Contract(), "2026-06-14").collect()}


def test_a_sound_bundle_has_no_findings(spark, sound):
    assert findings(Bundle.of_texts(spark, sound)).collect() == []


@pytest.mark.parametrize(("rule", "path", "change"), [
    ("V12", "02-areas/personas/index.md", lambda t: t.replace("Un título", "Otro")), ("V12", "01-proyectos/x/index.md", lambda t: None), ("V12", "01-proyectos/x/02-decisiones/index.md", lambda t: t + "más\n"), ("V13", "GOALS.md", lambda t: t.replace("iniciando", "bloqueada")), ("V13", "ORGANIGRAMA.md", lambda t: None),
    ("V13", "PREGUNTAS-ABIERTAS.md", lambda t: t.replace("—", "nada")), ("V14", "schema/json/decision.schema.json", lambda t: t + " "), ("V14", "schema/ddl.sql", lambda t: None),
])
def test_derived_files_out_of_date(spark, sound, rule, path, change):
    new = change(sound[path])
    texts = {k: v for k, v in sound.items() if k != path} | ({path: new} if new is not None else {})
    assert [(r.rule, r.path) for r in RULES[rule](Context(Bundle.of_texts(spark, texts))).collect()] == [(rule, path)]


def test_every_rule_has_a_seeded_case():
    assert set(SEEDED) | {"V12", "V13", "V14"} == set(RULES)


@pytest.mark.parametrize("name", SEEDED)
def test_rule_names_its_defect(spark, name):
    got = RULES[name](Context(Bundle.of_texts(spark, SOUND | SEEDED[name]))).collect()
    assert {r.path for r in got} == set(SEEDED[name]) and {r.rule for r in got} == {name}


def test_staged_documents_alone(spark):
    bundle = Bundle.of_texts(spark, SOUND | SEEDED["V19"] | SEEDED["V25"])
    assert {r.path for r in findings(bundle, staged=["otra/d.md"]).collect()} == {"otra/d.md"}
