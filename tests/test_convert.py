"""Converters on files built here."""

import base64
import html
import io
import re
import zipfile
import zlib
from urllib.parse import quote

import pytest

from tesela.sources import convert, markdown

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def made(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = made({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Uno</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>punto</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'})
PPTX = made({f"ppt/slides/slide{n}.xml": f"<p:sld {A}><p:sp><a:p><a:r><a:t>S{n}</a:t></a:r></a:p></p:sp></p:sld>" for n in (10, 2)})
XLSX = made({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="H" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>', "xl/sharedStrings.xml": f"<sst {S}><si><t>fecha</t></si></sst>",
    "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c></row><row><c r="A2" s="1"><v>46023</v></c><c r="B2"><f>1+1</f></c></row>' + "<row><c><v>1</v></c></row>" * 60 + "</sheetData></worksheet>",
})
MODEL = '<mxGraphModel><root><mxCell id="1" vertex="1" value="A&lt;br&gt;b"/><mxCell id="2" vertex="1" value="C"/><mxCell id="3" edge="1" source="1" target="2" value="va"/></root></mxGraphModel>'


def test_office():
    assert convert.docx(DOCX)[0] == "## Uno\n\n- punto\n\n| a\\|b |\n|---|\n| c |"
    assert convert.pptx(PPTX)[0] == "## Slide 2\n\nS2\n\n## Slide 10\n\nS10"
    text, warnings, _ = convert.xlsx(XLSX)
    assert text.startswith("## H\n\n| fecha |  | TRUE |\n|---|---|---|\n| 2026-01-01 |  |  |") and warnings == ["H: 50 of 61 rows", "H: 1 formulas without a stored value"]


def test_drawio_packed_and_plain():
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = base64.b64encode(deflate.compress(quote(MODEL).encode()) + deflate.flush()).decode()
    want = '```mermaid\nflowchart TD\n    n1["A b"]\n    n2["C"]\n    n1 -->|va| n2\n```'
    assert all(want in convert.drawio(x.encode())[0] for x in (f'<mxfile><diagram name="D">{packed}</diagram></mxfile>', MODEL))


def test_page():
    text, warnings, _ = convert.page(b"<nav>x</nav><article><h2>T &amp; u</h2><p>uno\n dos</p><ul><li>a</li><li>b</li></ul><script>no</script></article><footer>z</footer>")
    assert text == "## T & u\n\nuno dos\n\n- a\n- b" and len(warnings) == 2


def test_pages_with_nested_and_unclosed_parts():
    text = lambda source: convert.page(source.encode())[0]
    assert text("<article><p>uno</p><article><p>dos</p></article><p>tres</p></article><p>fuera</p>") == "uno\n\ndos\n\ntres"
    assert text("<p>uno</p><form><p>dos</p><header>no</header><p>tres") == "uno\n\ndos\n\ntres"
    assert text("<main><aside>no<nav>no</nav></aside><p>sí</main>") == "sí" and text("") == text("<script>x</script>") == ""


def test_linked_nodes_without_a_label():
    model = '<mxGraphModel><root><mxCell id="1" vertex="1" value=""/><mxCell id="2" vertex="1" value="C"/><mxCell id="4" vertex="1" value=""/><mxCell id="3" edge="1" source="1" target="2"/></root></mxGraphModel>'
    text = convert.drawio(model.encode())[0]
    assert "n1[" in text and "n1 --> n2" in text and "n4" not in text


def test_times_of_day():
    assert convert.serial_date(46023.5) == "2026-01-01 12:00" and convert.serial_date(46023.5 + 1 / 86400) == "2026-01-01 12:00:01" and convert.serial_date(46023) == "2026-01-01"


def plain_page(source):
    """The words of a page's main part, by taking away what is no content."""
    if m := re.search(r"(?s)<(main|article)\b[^>]*>(.*)</\1>", source):
        source = m[2]
    for name in convert.NOISE:
        source = re.sub(rf"(?s)<{name}\b[^>]*>.*?</{name}>", " ", source)
    return html.unescape(re.sub(r"<[^>]+>", lambda m: "" if re.match(r"</?(a|b|i|em|strong|span|code)\b", m[0]) else " ", source)).split()


def test_pages_of_the_table_against_a_plain_version(spark):
    from tesela.plans.checked import html_to_markdown

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = html_to_markdown(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages)
    for r in got:
        words = [w for w in re.sub(r"(?m)^(#+|-) ", "", r.text).split()]
        assert r.status == "ok" and words == plain_page(pages[r.page_id] or ""), r.page_id


def test_a_title_with_quotes_reads_back():
    for title in ('Dijo "sí": \\ y #', "yes", "- x", "a: b"):
        doc = markdown.parsed(convert.as_document(title, "Insumo", "hola", 'raw/"a".docx', "2026-01-01T00:00:00Z"))
        assert doc.error is None and doc.meta["title"] == title and doc.meta["original"] == 'raw/"a".docx'


def test_names_and_columns():
    assert convert.title_of("x/2026-01-02-plan_de-obra-3fa9b1c.docx") == "Plan de obra" and convert.title_of("facade.pdf") == "Facade"
    assert [convert.column_index(x) for x in ("A1", "Z9", "AA1", "AB12")] == [0, 25, 26, 27] and convert.serial_date(1, True) == "1904-01-02"


def test_a_table_of_files(spark):
    files = [("a.docx", bytearray(DOCX)), ("b.doc", bytearray(b"x")), ("c.zzz", bytearray(b"x")), ("d.xlsx", bytearray(b"no zip")), ("e.yml", bytearray(b"a: 1\n"))]
    got = {r.path: r.status for r in convert.convert(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"a.docx": "ok", "b.doc": "unsupported", "c.zzz": "unsupported", "d.xlsx": "failed", "e.yml": "ok"}


def test_a_converted_file_is_a_sound_document():
    doc = markdown.parsed(convert.as_document("Título: uno", "Insumo", "hola\nmundo", "/raw/a.docx", "2026-01-01T00:00:00Z"))
    assert doc.error is None and doc.meta["title"] == "Título: uno" and doc.meta["generated"] == {"by": "process:convert", "at": "2026-01-01T00:00:00Z"}


@pytest.mark.parametrize("name", ["x.ppt", "x.xls", "x"])
def test_refused(name):
    with pytest.raises(convert.Unsupported):
        convert.converted(name, b"")
