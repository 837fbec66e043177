"""Office, web, diagram and data files as Markdown: (text, warnings, type) from bytes, and the same over a table of files.

Readers work on the bytes of one file with the standard library: zip archives of XML parts for docx, pptx and xlsx, deflated XML for drawio.
"""

from __future__ import annotations

import base64
import html
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from html.parser import HTMLParser
from pathlib import PurePosixPath
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

#: Elements of a page that are no content, and those that begin a block.
NOISE = frozenset("nav footer header aside form script style noscript svg iframe button".split())
BLOCKS = frozenset("p div section article br tr ul ol table blockquote pre".split())
LEGACY = frozenset("doc ppt xls".split())
SHEET_ROWS = 50


class Unsupported(ValueError):
    pass


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(e, name: str):
    return (x for x in e.iter() if _tag(x) == name)


def _attr(e, name: str, default: str = "") -> str:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), default)


def table(rows: list[list[str]]) -> str:
    """Rows as a Markdown table, the first as its head; cells escaped, columns that are empty at the right end left out."""
    rows = [[re.sub(r"\s+", " ", c or "").strip().replace("|", "\\|") for c in r] for r in rows]
    width = max((i + 1 for r in rows for i, c in enumerate(r) if c), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join((r + [""] * width)[:width]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


# ------------------------------------------------ docx, pptx

def _paragraph_text(p) -> str:
    return "".join({"t": lambda x: x.text or "", "tab": lambda x: " ", "br": lambda x: " "}.get(_tag(x), lambda x: "")(x) for x in p.iter()).strip()


def docx(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(_all(ET.fromstring(z.read("word/document.xml")), "body"))
    out = []
    for e in body:
        if _tag(e) == "tbl":
            out.append(table([[" ".join(_paragraph_text(p) for p in _all(cell, "p")) for cell in _all(row, "tc")] for row in _all(e, "tr")]))
        elif _tag(e) == "p" and (text := _paragraph_text(e)):
            style = next((_attr(s, "val") for s in _all(e, "pStyle")), "")
            level = re.fullmatch(r"(?:Heading|T[ií]tulo|Ttulo)\s*(\d)", style)
            listed = next(_all(e, "numPr"), None) is not None
            out.append(("#" * min(6, int(level[1])) + " " if level else "# " if style == "Title" else "- " if listed else "") + text)
    return "\n\n".join(x for x in out if x), [], "Insumo"


def pptx(data: bytes):
    out, warnings = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides:
            root, lines = ET.fromstring(z.read(name)), [f"## Slide {number}"]
            for shape in root.iter():
                if _tag(shape) == "sp":
                    lines += [t for p in _all(shape, "p") if (t := "".join(x.text or "" for x in _all(p, "t")).strip())]
                elif _tag(shape) == "tbl":
                    lines.append(table([["".join(x.text or "" for x in _all(cell, "t")) for cell in _all(row, "tc")] for row in _all(shape, "tr")]))
            rels = f"ppt/slides/_rels/slide{number}.xml.rels"
            for rel in _all(ET.fromstring(z.read(rels)), "Relationship") if rels in z.namelist() else ():
                target = "ppt/" + rel.get("Target", "").replace("../", "")
                if "notesSlide" in target and target in z.namelist():
                    notes = " ".join(t for p in _all(ET.fromstring(z.read(target)), "p") if (t := "".join(x.text or "" for x in _all(p, "t")).strip()))
                    lines += [f"> {notes}"] if notes else []
            out.append("\n\n".join(lines))
    if not slides:
        warnings.append("no slides")
    return "\n\n".join(out), warnings, "Insumo"


# ------------------------------------------------ xlsx

def column_index(ref: str) -> int:
    """Position from 0 of a cell reference such as AB12: its letters are digits from 1 to 26."""
    letters = ref.rstrip("0123456789")
    return sum((ord(c) - ord("A") + 1) * 26**place for place, c in enumerate(reversed(letters))) - 1


def serial_date(serial: float, from_1904: bool = False) -> str:
    """A spreadsheet's day number as a date, with the time of day where it has one."""
    when = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    when += timedelta(seconds=round(serial * 86_400))
    return when.date().isoformat() if serial == int(serial) else when.isoformat(" ", "minutes" if when.second == 0 else "seconds")


#: Built-in number formats that are dates. Fixed values.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def xlsx(data: bytes, most: int = SHEET_ROWS):
    warnings, out = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        part = lambda n: ET.fromstring(z.read(n)) if n in z.namelist() else ET.Element("none")
        shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(part("xl/sharedStrings.xml"), "si")]
        styles, book = part("xl/styles.xml"), part("xl/workbook.xml")
        custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in _all(styles, "numFmt")}
        is_date = lambda i: i in DATE_FORMATS or bool(re.search(r"[ymdYMD]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(i, ""))))
        dated = [is_date(int(xf.get("numFmtId", 0))) for xfs in _all(styles, "cellXfs") for xf in xfs]
        old = any(_attr(p, "date1904") in ("1", "true") for p in _all(book, "workbookPr"))
        targets = {r.get("Id"): r.get("Target", "") for r in _all(part("xl/_rels/workbook.xml.rels"), "Relationship")}
        for sheet in _all(book, "sheet"):
            target = targets.get(_attr(sheet, "id"), "").lstrip("/")
            root = part(target if target.startswith("xl/") else f"xl/{target}")
            rows, total, uncached = [], 0, 0
            for row in _all(root, "row"):
                total += 1
                if len(rows) > most:
                    continue
                cells: dict[int, str] = {}
                for i, c in enumerate(_all(row, "c")):
                    v = next(_all(c, "v"), None)
                    value, kind = (v.text or "") if v is not None else "", c.get("t")
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in _all(c, "t"))
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    elif not value and next(_all(c, "f"), None) is not None:
                        uncached += 1
                    elif kind in (None, "n") and value and (s := int(c.get("s", 0))) < len(dated) and dated[s]:
                        value = serial_date(float(value), old)
                    cells[column_index(c.get("r")) if c.get("r") else i] = value
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out.append(f"## {sheet.get('name')}\n\n{table(rows[: most + 1])}")
            if total > most + 1:
                warnings.append(f"{sheet.get('name')}: {most} of {total - 1} rows")
            if uncached:
                warnings.append(f"{sheet.get('name')}: {uncached} formulas without a stored value")
    return "\n\n".join(out), warnings, "Insumo"


# ------------------------------------------------ drawio

def label(text: str) -> str:
    text = re.sub(r"<br\s*/?>|</?(?:div|p)[^>]*>", " ", html.unescape(text or ""))
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", text)).replace("\xa0", " ")).strip()


def drawio(data: bytes):
    root, out = ET.fromstring(data), []
    for diagram in _all(root, "diagram") if _tag(root) == "mxfile" else [root]:
        packed = (diagram.text or "").strip()
        model = ET.fromstring(unquote(zlib.decompress(base64.b64decode(packed), -15).decode())) if packed and not len(diagram) else diagram
        nodes, edges = {}, []
        for e in model.iter():
            cell = e if _tag(e) == "mxCell" else next((x for x in e if _tag(x) == "mxCell"), None) if _tag(e) in ("object", "UserObject") else None
            if cell is None:
                continue
            ident, text = e.get("id") or cell.get("id"), label(e.get("label") or e.get("value") or "")
            if cell.get("edge") == "1":
                edges.append((cell.get("source"), cell.get("target"), text))
            elif cell.get("vertex") == "1" and ident not in nodes:
                nodes[ident] = text
        linked = {end for a, b, _ in edges for end in (a, b)}
        nodes = {k: t or "·" for k, t in nodes.items() if t or k in linked}  # a node without a label counts where something leads to it
        name = {k: re.sub(r"\W", "_", f"n{k}", flags=re.A) for k in nodes}
        lines = [f'    {name[k]}["{t}"]' for k, t in nodes.items()]
        lines += [f"    {name[a]} -->{f'|{t}|' if t else ''} {name[b]}" for a, b, t in edges if a in name and b in name]
        out.append(f"## {diagram.get('name') or 'Diagram'}\n\n```mermaid\nflowchart TD\n" + "\n".join(lines) + "\n```")
    return "\n\n".join(out), [], "Diagrama"


# ------------------------------------------------ html, yaml, pdf

class _Events(HTMLParser):
    """The tags and texts of a page in order: (tag, opens, text)."""

    def __init__(self):
        super().__init__()
        self.all: list[tuple[str, bool, str]] = []

    def handle_starttag(self, tag, attrs):
        self.all.append((tag, True, ""))

    def handle_endtag(self, tag):
        self.all.append((tag, False, ""))

    def handle_data(self, data):
        self.all.append(("", False, data))


def _spans(events: list[tuple[str, bool, str]], names: frozenset[str]) -> list[tuple[int, int]]:
    """(start, end) of each element of some names that is closed, by the place of its tags; one that is not closed is passed over."""
    open_at: dict[str, list[int]] = {}
    out = []
    for i, (tag, opens, _) in enumerate(events):
        if tag in names:
            if opens:
                open_at.setdefault(tag, []).append(i)
            elif open_at.get(tag):
                out.append((open_at[tag].pop(), i))
    return sorted(out)


def page(data: bytes):
    """The page's main part (its first main or article, with all that is nested in it) or all of it, without what is no content."""
    reader, warnings = _Events(), []
    reader.feed(data.decode("utf-8", "replace"))
    reader.close()
    events = reader.all
    marked = _spans(events, frozenset(("main", "article")))
    if marked:
        a, b = marked[0]
        warnings.append(f"only the part marked {events[a][0]}")
        events = events[a + 1 : b]
    noise = _spans(events, NOISE)
    silent = [0] * (len(events) + 1)
    for a, b in noise:
        silent[a] += 1
        silent[b + 1] -= 1
    blocks, depth = [["", ""]], 0
    for (tag, opens, text), step in zip(events, silent, strict=False):
        depth += step
        if depth:
            continue
        heading = re.fullmatch("h([1-6])", tag)
        if tag in BLOCKS or tag == "li" or heading:
            blocks.append(["#" * int(heading[1]) + " " if heading and opens else "- " if tag == "li" and opens else "", ""])
        blocks[-1][1] += text
    if noise:
        warnings.append(f"{len(noise)} parts of the page's frame left out")
    lines: list[str] = []
    for prefix, text in ((p, " ".join(t.split())) for p, t in blocks):
        if text:  # items of a list follow each other without a blank line
            near = prefix == "- " and lines and lines[-1].lstrip("\n").startswith("- ")
            lines.append(("" if not lines else "\n" if near else "\n\n") + prefix + text)
    return "".join(lines), warnings, "Insumo"


def data_file(data: bytes):
    return f"```yaml\n{data.decode('utf-8', 'replace').rstrip()}\n```", [], "Insumo"


def pdf(data: bytes):
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise Unsupported("reading pdf needs an optional library") from e
    texts = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    scanned = sum(map(len, texts)) < 100 * len(texts)
    return "\n\n".join(t.strip() for t in texts), ["little text: the pages may be scans"] if scanned else [], "Insumo"


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "drawio": drawio, "html": page, "htm": page, "yaml": data_file, "yml": data_file, "pdf": pdf}


def title_of(name: str) -> str:
    """A title from a file name: its words, without a date in front and an identifier in hexadecimal at the end."""
    words = [w for w in re.split(r"[-_\s]+", PurePosixPath(name).stem) if w]
    if len(words) > 3 and [len(w) for w in words[:3]] == [4, 2, 2] and "".join(words[:3]).isdigit():
        words = words[3:]
    if len(words) > 1 and len(words[-1]) >= 6 and set(words[-1]) <= set("0123456789abcdef") and not words[-1].isalpha():
        words.pop()
    title = " ".join(words)
    return title[:1].upper() + title[1:]


def converted(name: str, data: bytes) -> tuple[str, list[str], str]:
    """Raises Unsupported for kinds of files that have no reader."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind in LEGACY:
        raise Unsupported(f".{kind} is an old format; save it as .{kind}x")
    if kind not in READERS:
        raise Unsupported(f"no reader for .{kind}")
    return READERS[kind](data)


def convert(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, status (ok, unsupported or failed), title, type, text, warnings for a table of files; a file that can't be read does not stop others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame[path], frame[content], strict=True):
                try:
                    text, warnings, kind = converted(name, bytes(data))
                    rows.append((name, "ok", title_of(name), kind, text, warnings))
                except Unsupported as e:
                    rows.append((name, "unsupported", title_of(name), None, None, [str(e)]))
                except (zipfile.BadZipFile, ET.ParseError, KeyError, StopIteration, ValueError, zlib.error, IndexError) as e:
                    rows.append((name, "failed", title_of(name), None, None, [f"{type(e).__name__}: {e}"]))
            yield pd.DataFrame(rows, columns=["path", "status", "title", "type", "text", "warnings"])

    return files.select(path, content).mapInPandas(run, "path string, status string, title string, type string, text string, warnings array<string>")


def as_document(title: str, kind: str, text: str, original: str, made_at: str) -> str:
    """A converted text as a document with front matter."""
    from .markdown import body_hash, written

    body = f"# {title}\n\n{text}\n"
    head = {"type": kind, "title": title, "description": f"Convertido de {original}", "tags": "[]", "classification": "confidential", "generated": "{by: process:convert, at: " + made_at + "}", "resumen": text[:200].replace("\n", " ").strip() or title, "resumen_hash": body_hash(body), "procedencia": "fuente", "proyecto": "transversal", "original": original}
    return "---\n" + "\n".join(f"{k}: {v if k in ('tags', 'generated') else written(v)}" for k, v in head.items()) + f"\n---\n\n{body}"

