"""Documents to tables: parsing, projection, difference, constraints."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesela.plans.constraints import CHECKS, violations
from tesela.plans.contract import Contract, ContractError
from tesela.plans.incremental import Snapshots, difference
from tesela.plans.questions import PARAMS, QUESTIONS
from tesela.sources import markdown
from tesela.sources.bundle import Bundle, files, listed
from tesela.sources.star import TABLES

COMMON = "classification: internal\ngenerated: {by: human:ana, at: 2026-01-01T00:00:00Z}\nresumen: \"algo: con dos puntos\"\nresumen_hash: x\nprocedencia: manual\n"


def doc(kind, extra="", body="Texto contenido.", title="T", common=COMMON):
    return f"---\ntype: {kind}\ntitle: {title}\ndescription: una\ntags: [a, b]\n{common}{extra}---\n\n# {title}\n{body}\n"


TEXTS = {
    "02-areas/personas/ana.md": doc("Persona", "rol: jefe\nreports_to: /02-areas/personas/luis.md\n", common=COMMON.replace("internal", "confidential")),
    "02-areas/personas/luis.md": doc("Persona", "rol: jefe\n", common=COMMON.replace("internal", "confidential")),
    "01-proyectos/x/CONTEXT.md": doc("Iniciativa", "proyecto: x\norigen: proyecto-asignado\nperiodo: 2026-Q1\nestado: entregada\nsistemas:\n- /a.md\n- /b.md\n"),
    "01-proyectos/x/02-decisiones/dec-1.md": doc("Decision", "proyecto: x\nestado: aceptada\nfecha: 2026-01-01\nvalido_desde: 2026-01-01\nvalido_hasta: 2026-04-01\nreemplazada_por: /01-proyectos/x/02-decisiones/dec-2.md\ndecisores: [/02-areas/personas/ana.md]\n"),
    "01-proyectos/x/02-decisiones/dec-2.md": doc("Decision", "proyecto: x\nestado: aceptada\nfecha: 2026-04-01\nvalido_desde: 2026-04-01\n"),
    "01-proyectos/x/04-preguntas/q.md": doc("Pregunta", "proyecto: x\nestado: abierta\nbloqueante: true\ncreated: 2026-02-01\n"),
    "02-areas/europe/l.md": doc("Lineamiento", "area: europe\nfuente: norma\nestado: aprobado\nsources:\n- {resource: /01-proyectos/x/CONTEXT.md, id: 1}\n"),
    "_notas.md": doc("Glosario"),
    "index.md": "* nada\n",
    "roto.md": "---\ntype: Glosario\na: [1\n---\n",
    "log-consultas.md": "- antes — 1 docs (0 completos, 0 citados) · directa · no\n## 2026-01-02\n- q — 3 docs (2 completos, 1 citados) · directa · archivada\n- mal\n## 2026-01-03\n- r — 5 docs (0 completos, 0 citados) · explorar · no\n",
}


@pytest.fixture(scope="module")
def bundle(spark):
    return Bundle.of_texts(spark, TEXTS)


def test_front_matter_values():
    got = markdown.front_matter(["a: x # no", 'b: "x # \\"y\\""', "c: [1, 'a,b', {k: v, w: }]", "d: {k: TRUE}", "e:", "- uno", "- {a: b}", "f: ~", "", "g: http://a:1"])
    assert got == {"a": "x", "b": 'x # "y"', "c": ["1", "a,b", {"k": "v", "w": None}], "d": {"k": True}, "e": ["uno", {"a": "b"}], "f": None, "g": "http://a:1"}


@pytest.mark.parametrize(("lines", "line"), [(["a: 1", "a: 2"], 2), (["a:\t1"], 1), (["  a: 1"], 1), (["- x"], 1), (["a: [x"], 1), (["a: {b: {c: d}}"], 1), (["a: [[x]]"], 1), (["a: |"], 1), (["nada"], 1), (["a: 'x"], 1)])
def test_front_matter_refuses(lines, line):
    with pytest.raises(markdown.FrontMatterError) as e:
        markdown.front_matter(lines)
    assert e.value.line == line


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",))))
def test_a_written_text_reads_back(text):
    line = f"k: {markdown.written(text)}"
    assert line.splitlines() == [line] or not line.strip()
    assert markdown.front_matter([line])["k"] == text
    assert markdown.front_matter([f"k: [{markdown.in_quotes(text)}, x]"])["k"] == [text, "x"]


@pytest.mark.parametrize("text", ["yes", "No", "NULL", "~", "12", "-1.5e3", "0x1F", "12:30", ".inf", "a: b", "a:", "- x", "-", "? x", "# x", "x # y", "", " x", "x ", "'a'", '"b"', "[a", "{b", "&a", "*a", "!a", "%a", "@a", "`a", "|", ">", "it: c\\d", "\x85", "a\u2028b"])
def test_texts_that_need_quotes(text):
    assert markdown.written(text)[0] == '"' and markdown.unquoted(markdown.written(text)) == text


@pytest.mark.parametrize("text", ["plain words", "http://a:1/b", "a#b", "it's", "c\\d", "-x", "?why", ":x", "2026-01-01T00:00:00Z", "y/n", "año — nuevo"])
def test_texts_that_stand_as_they_are(text):
    assert markdown.written(text) == text and markdown.front_matter([f"k: {text}"])["k"] == text


def test_hazards_of_raw_lines():
    lines = ["a: one: two", "b: yes", "c: text # more", 'd: "x: y"', "e: [a: b]", "f: -", "g: 12", "h: it's # so", "i: fine", "j: @x", "- k: l"]
    found = markdown.hazards(lines, {"g": "date"})
    assert [(n, k, bad) for n, k, _, bad in found] == [(1, "a", True), (2, "b", True), (3, "c", False), (6, "f", True), (8, "h", False), (10, "j", True)]
    assert markdown.uncommented("a: 'x # y' # z") == "a: 'x # y'" and markdown.uncommented("# all") == "" and markdown.uncommented("it's # so") == "it's"


def test_body_hash_ignores_line_ends_and_front_matter():
    assert markdown.body_hash("---\na: 1\n---\r\n\r\nx\r\ny") == markdown.body_hash("x\ny\n\n") != markdown.body_hash("x y")


def test_tables_of_a_bundle(bundle):
    assert {t: bundle[t].count() for t in TABLES} | {} == {
        "documentos": 8, "documentos_tags": 16, "documentos_verified": 0, "documentos_sources": 1, "analisis": 0, "decision": 2, "decision_decisores": 1, "diagrama": 0, "glosario": 1, "iniciativa": 1, "iniciativa_sistemas": 2, "iniciativa_personas": 0, "insumo": 0,
        "lineamiento": 1, "persona": 2, "plan": 0, "playbook": 0, "pregunta": 1, "reunion": 0, "reunion_asistentes": 0, "sistema": 0, "consultas": 2,
    }
    d = bundle["documentos"].filter("path = '01-proyectos/x/04-preguntas/q.md'").first()
    assert (d.generated_by, d.resumen, d.status) == ("human:ana", "algo: con dos puntos", None)
    assert bundle["pregunta"].first().bloqueante == 1
    assert [tuple(r) for r in bundle["consultas"].orderBy("linea").collect()] == [(3, "2026-01-02", 3, 2, 1, "directa", 1), (6, "2026-01-03", 5, 0, 0, "explorar", 0)]


def test_table_columns_are_those_of_the_star_model(spark, bundle):
    from tesela.sources.star import Star

    star = Star(spark, "/root/testdata/sf0.001")
    assert {t: bundle[t].columns for t in TABLES} == {t: star[t].columns for t in TABLES}


def test_questions_run_on_a_bundle(bundle):
    p = PARAMS | {"proyecto": "x", "persona": "/02-areas/personas/ana.md", "periodo": "2026-Q1", "termino": "contenido"}
    counts = {q: f(bundle, p).count() for q, f in QUESTIONS.items()}
    assert counts["cq_21"] == counts["cq_27"] == counts["cq_28"] == counts["cq_40"] == counts["cq_25"] == 1 and counts["cq_49"] == 8
    assert [r.caso for r in QUESTIONS["cq_50"](bundle, p).collect()] == ["promovido"]
    assert [r.doc for r in QUESTIONS["cq_48"](bundle, p | {"fecha": "2026-02-01"}).collect() if r.tipo == "Decision"] == ["01-proyectos/x/02-decisiones/dec-1.md"]
    assert all(counts[q] == 0 for q in counts if q.startswith("adv_"))


#: A defect for each adversarial check: path and new text.
DEFECTS = {
    "adv_03": ("02-areas/personas/z.md", doc("Persona", "rol: r\nreports_to: /nadie.md\n")), "adv_04": ("a.md", doc("Glosario", "status: stable\nstale_after: 2020-01-01T00:00:00Z\n")), "adv_05": ("02-areas/personas/z.md", doc("Persona", "rol: r\n")),
    "adv_06": ("d.md", doc("Decision", "proyecto: x\nestado: aceptada\nfecha: 2026-01-01\ndecisores: [comite]\n")), "adv_07": ("d.md", doc("Decision", "proyecto: x\nestado: propuesta\nfecha: 2026-01-01\nvalido_hasta: 2026-02-01\n")),
    "adv_08": ("d.md", doc("Decision", "proyecto: x\nestado: aceptada\nfecha: 2026-01-01\nreemplazada_por: /x.md\n")), "adv_09": ("g.md", doc("Glosario", "verified: [{by: process:p, at: 2026-01-01}]\n")), "adv_10": ("a.md", doc("Glosario", "status: draft\nstale_after: 2020-01-01T00:00:00Z\n")),
    "adv_11": ("02-areas/personas/luis.md", doc("Persona", "rol: jefe\nreports_to: 02-areas/personas/ana.md\n")), "adv_12": ("g.md", doc("Glosario", "sources: [{resource: ' '}]\n")),
}


@pytest.mark.parametrize("check", DEFECTS)
def test_each_adversarial_check_sees_its_defect(spark, check):
    path, text = DEFECTS[check]
    assert QUESTIONS[check](Bundle.of_texts(spark, TEXTS | {path: text}), PARAMS).count() > 0


def test_constraints_see_defects(spark, bundle):
    assert violations(bundle).count() == 0
    bad = TEXTS | {"01-proyectos/y/CONTEXT.md": TEXTS["01-proyectos/x/CONTEXT.md"], "g.md": doc("Glosario", common=COMMON.replace("manual", "nada").replace("resumen_hash: x\n", ""))}
    found = {(r.check, r.columna) for r in violations(Bundle.of_texts(spark, bad)).collect()}
    assert found == {("unique", "proyecto"), ("enum", "procedencia"), ("not_null", "resumen_hash")}
    assert set(CHECKS) == {"chk_not_null", "chk_enum", "chk_pk", "chk_unique", "chk_fk"}


def test_incremental_equals_full(spark, tmp_path):
    names = [t for t in TABLES if t.split("_")[0] in ("documentos", "decision", "persona", "consultas")]
    steps = [TEXTS, TEXTS, TEXTS | {"02-areas/personas/ana.md": TEXTS["02-areas/personas/ana.md"].replace("rol: jefe", "rol: otra")}, {k: v for k, v in TEXTS.items() if "dec-2" not in k}]
    snaps = Snapshots(spark, f"{tmp_path}/inc")
    with pytest.raises(LookupError):
        snaps["documentos"]
    for i, texts in enumerate(steps):
        corpus = Bundle.of_texts(spark, texts)
        snaps.publish(corpus, names)
        whole = Snapshots(spark, f"{tmp_path}/full{i}")
        whole.publish(corpus, names, full=True)
        for t in names:
            assert snaps[t].exceptAll(whole[t]).isEmpty() and whole[t].exceptAll(snaps[t]).isEmpty(), (i, t)
    old, new = Bundle.of_texts(spark, steps[1])["documentos"], Bundle.of_texts(spark, steps[2])["documentos"]
    assert {r.state: r["count"] for r in difference(old, new).groupBy("state").count().collect()} == {"same": 7, "changed": 1}


def test_a_broken_corpus_is_not_published(spark, tmp_path):
    snaps = Snapshots(spark, f"{tmp_path}/s")
    good = snaps.publish(Bundle.of_texts(spark, TEXTS), TABLES)
    with pytest.raises(ValueError, match="not published"):
        snaps.publish(Bundle.of_texts(spark, TEXTS | {"01-proyectos/y/CONTEXT.md": TEXTS["01-proyectos/x/CONTEXT.md"]}), TABLES)
    assert snaps.current() == good and {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("v-")} == {good}


def test_readers_see_a_projection_while_others_are_published(spark, tmp_path):
    import threading

    snaps = Snapshots(spark, f"{tmp_path}/s")
    names = ["documentos", "persona"]
    corpus = Bundle.of_texts(spark, TEXTS)
    snaps.publish(corpus, names)
    seen, over = [], threading.Event()

    def read():
        while not over.is_set():
            seen.append(snaps["documentos"].count())

    reader = threading.Thread(target=read)
    reader.start()
    try:
        published = [snaps.publish(corpus, names, full=True) for _ in range(3)]
    finally:
        over.set()
        reader.join()
    assert set(seen) == {8} and snaps.current() == published[-1]
    assert len(snaps.dropped(keep=1)) == 3 and snaps["documentos"].count() == 8


def test_files_of_a_folder(spark, tmp_path):
    for name in ("a.md", "_b.md", "sub dir/c.md", ".git/d.md", "e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    assert listed(spark, str(tmp_path)) == ["_b.md", "a.md", "sub dir/c.md"]
    assert {r.path: bytes(r.content).decode() for r in files(spark, str(tmp_path)).collect()} == {"_b.md": "_b.md", "a.md": "a.md", "sub dir/c.md": "sub dir/c.md"}
    odd = tmp_path / "o'dd +%20 [x]" / "b c"
    odd.mkdir(parents=True)
    (odd / "ñ é+%.md").write_text("in")
    assert {r.path for r in files(spark, str(tmp_path)).collect()} >= {"o'dd +%20 [x]/b c/ñ é+%.md"}


def test_contract_extensions():
    c = Contract().extended('{"types": {"Riesgo": {"fields": {"nivel": {"kind": "enum", "values": ["a", "b"], "required": true}}, "places": ["05-riesgos"]}}, "period": "mes"}')
    assert c.columns("Riesgo")["nivel"][1] is False and c.place_shapes("Riesgo") == ["^05\\-riesgos$"]
    for bad in ('{"x": 1}', '{"types": {"Decision": {}}}', '{"period": "siglo"}'):
        with pytest.raises(ContractError):
            Contract().extended(bad)
    assert Contract().place("Decision", {"proyecto": "x"}) == ["01-proyectos/x/02-decisiones", "02-areas/decisiones"]
    assert Contract().json_schema("Decision")["properties"]["verified"]["items"]["required"] == ["by", "at"]
    assert markdown.parsed(Contract().template("Pregunta")).error is None
