"""Files that are derived from a corpus: directory indexes, tables, grouped tables, graphs. First as rows (path, pos, line), one for each line, which is
what the rules compare; a text is made of them only where a file is written.

Positions come from a window for each file, so a file's lines meet in one task, as they do in the file itself; nothing is gathered in memory.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .contract import RESERVED, Contract, holds
from .questions import bare

def _none() -> Column:
    return F.lit("")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _cell(text: Column) -> Column:
    """Text in a table's cell."""
    return F.replace(F.trim(F.regexp_replace(F.coalesce(text.cast("string"), _none()), r"\s+", " ")), F.lit("|"), F.lit("\\|"))


@dataclass(frozen=True)
class Show:
    """A column of a derived table: the field, its heading, and how it is shown: plain, as a link to the document, as the title of the document that
    the field leads to, or as days since the field's date."""

    field: str
    head: str
    how: str = "plain"


@dataclass(frozen=True)
class Spec:
    """A derived file. `where` is a contract's `when`; order: fields, a - before those that go down, as text, blanks first, then the path; groups:
    declared values of a field with their headings, others under the last heading; edge: the field that a graph's edges follow."""

    path: str
    kind: str
    title: str
    show: tuple[Show, ...] = ()
    where: dict = field(default_factory=dict)
    role: str | None = None
    order: tuple[str, ...] = ()
    flag: tuple[str, str, str] | None = None  # (field, value, mark before the first cell)
    empty: str = "—"
    group: tuple[str, tuple[tuple[str, str], ...], str] | None = None
    edge: str | None = None


#: Choices of this library, as the base contract's files are not published.
SPECS = (
    Spec("PREGUNTAS-ABIERTAS.md", "Pregunta", "Preguntas abiertas", (Show("title", "Pregunta", "link"), Show("proyecto", "Proyecto"), Show("responsable", "Responsable", "title"), Show("created", "Días", "days")), {"estado": {"not": "respondida"}}, order=("-bloqueante", "created"), flag=("bloqueante", "1", "⛔ ")),
    Spec("GOALS.md", "Iniciativa", "Metas", (Show("title", "Iniciativa", "link"), Show("periodo", "Periodo"), Show("estado", "Estado")), role="activas", order=("periodo", "title"), group=("origen", (("proyecto-asignado", "Asignadas"), ("objetivo-personal", "Personales"), ("objetivo-equipo", "Del equipo")), "Otras")),
    Spec("ORGANIGRAMA.md", "Persona", "Organigrama", edge="reports_to"),
)


def rows_of(corpus, contract: Contract, spec: Spec) -> DataFrame:
    """path, title and own fields of the documents that a file is made of."""
    docs = corpus["documentos"].select(F.col("path").alias("doc"), "title")
    rows = corpus[spec.kind.lower()].join(docs, "doc")
    rows = rows.filter(holds(spec.where, lambda n: F.col(n).cast("string")))
    if spec.role:
        rows = rows.filter(_folder(F.col("doc")).rlike("|".join(contract.role_shapes(spec.kind, spec.role))))
    return rows


def _shown(corpus, spec: Spec, rows: DataFrame, today: str) -> DataFrame:
    """rows with `cells`, an array of text."""
    titles = corpus["documentos"].select(F.col("path").alias("__to"), F.col("title").alias("__title"))
    cells = []
    for i, s in enumerate(spec.show):
        value = F.col(s.field)
        if s.how == "link":
            cell = F.concat(F.lit("["), _cell(value), F.lit("](/"), F.col("doc"), F.lit(")"))
        elif s.how == "days":
            cell = F.coalesce(F.datediff(F.lit(today).try_cast("date"), value.try_cast("date")).cast("string"), _none())
        elif s.how == "title":
            rows = rows.withColumn("__to", bare(F.trim(value))).join(titles, "__to", "left").withColumn(f"__t{i}", F.col("__title")).drop("__to", "__title")
            stem = F.regexp_replace(F.substring_index(F.trim(value), "/", -1), r"\.md$", "")
            cell = _cell(F.coalesce(f"__t{i}", F.when(F.trim(value).startswith("/"), stem), value))
        else:
            cell = _cell(value)
        cells.append(cell)
    if spec.flag and cells:
        name, wanted, mark = spec.flag
        cells[0] = F.concat(F.when(F.col(name).cast("string") == wanted, F.lit(mark)).otherwise(_none()), cells[0])
    return rows.withColumn("cells", F.array(*cells))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _ordering(spec: Spec) -> list[Column]:
    text = lambda n: F.coalesce(F.col(n.removeprefix("-")).cast("string"), _none())
    return [text(n).desc() if n.startswith("-") else text(n).asc() for n in spec.order] + [F.col("doc").asc()]


def _fixed(rows: DataFrame, spec: Spec, lines: list[tuple[float, str]]) -> DataFrame:
    """Lines that every corpus has: (place, text)."""
    return rows.sparkSession.createDataFrame([(spec.path, float(g), 0, t) for g, t in lines], "path string, part double, n int, line string")


def _numbered(lines: DataFrame) -> DataFrame:
    """path, pos, line from (path, part, n, line): parts in order, the lines of a part by n."""
    return lines.select("path", F.row_number().over(Window.partitionBy("path").orderBy("part", "n")).alias("pos"), "line")


def table_lines(corpus, contract: Contract, spec: Spec, today: str) -> DataFrame:
    """The lines of a table, or of a table for each group: heading, head, rows or the line for none. A group's rows are numbered for themselves."""
    rows = _shown(corpus, spec, rows_of(corpus, contract, spec), today)
    head = [f"| {' | '.join(s.head for s in spec.show)} |", "|" + "---|" * len(spec.show)]
    none = f"| {spec.empty} |" + " |" * (len(spec.show) - 1)
    if spec.group is None:
        groups, part = [(None, None)], F.lit(0)
    else:
        name, declared, other = spec.group
        groups = [*declared, (None, other)]
        part = F.coalesce(*(F.when(F.col(name) == v, F.lit(i)) for i, (v, _) in enumerate(declared)), F.lit(len(declared)))
    rows = rows.withColumn("g", part)
    body = rows.select(F.lit(spec.path).alias("path"), (F.col("g") * 10 + 5).cast("double").alias("part"), F.row_number().over(Window.partitionBy("g").orderBy(*_ordering(spec))).alias("n"), _line(F.col("cells")).alias("line"))
    fixed = [(-2, f"# {spec.title}"), (-1, "")]
    for g, (_, heading) in enumerate(groups):
        if heading is not None:
            fixed += [(g * 10 + 0.1, f"## {heading}"), (g * 10 + 0.2, "")]
        fixed += [(g * 10 + 1, head[0]), (g * 10 + 2, head[1])]
        if g < len(groups) - 1:
            fixed.append((g * 10 + 9, ""))
    blank = _fixed(rows, spec, [(g * 10 + 5, none) for g in range(len(groups))])
    absent = blank.join(body.select("part").distinct(), "part", "left_anti")
    return _numbered(reduce(DataFrame.unionByName, [_fixed(rows, spec, fixed), body, absent]))


def _ident(path: Column) -> Column:
    return F.regexp_replace(path, "[^A-Za-z0-9_]", "_")


def graph_lines(corpus, contract: Contract, spec: Spec) -> DataFrame:
    """The lines of a graph: nodes, edges to nodes that there are, and a list of documents without an edge."""
    rows = rows_of(corpus, contract, spec).withColumn("to", bare(F.trim(F.coalesce(F.col(spec.edge), _none()))))
    by = Window.orderBy("doc")  # a graph is one file
    label = F.regexp_replace(_cell(F.col("title")), '"', "'")
    nodes = rows.select(F.lit(1.0).alias("part"), F.row_number().over(by).alias("n"), F.concat(F.lit("    "), _ident(F.col("doc")), F.lit('["'), label, F.lit('"]')).alias("line"))
    there = rows.select(F.col("doc").alias("to"))
    edges = rows.join(there, "to", "left_semi").select(F.lit(2.0).alias("part"), F.row_number().over(by).alias("n"), F.concat(F.lit("    "), _ident(F.col("to")), F.lit(" --> "), _ident(F.col("doc"))).alias("line"))
    gaps = rows.filter(F.col("to") == "").select(F.lit(5.0).alias("part"), F.row_number().over(by).alias("n"), F.concat(F.lit("* ["), _cell(F.col("title")), F.lit("](/"), F.col("doc"), F.lit(")")).alias("line"))
    own = reduce(DataFrame.unionByName, [nodes, edges, gaps]).select(F.lit(spec.path).alias("path"), "part", "n", "line")
    fixed = _fixed(rows, spec, [(-2, f"# {spec.title}"), (-1, ""), (0, "```mermaid"), (0.5, "flowchart TD"), (3, "```"), (4, ""), (4.5, "## Sin enlace"), (4.7, "")])
    return _numbered(fixed.unionByName(own))


def lines(corpus, contract: Contract, spec: Spec, today: str) -> DataFrame:
    return graph_lines(corpus, contract, spec) if spec.edge else table_lines(corpus, contract, spec, today)


def index_lines(corpus) -> DataFrame:
    """The lines of every folder's index.md: its documents by name, then the folders right below it that hold documents, if any, under a heading."""
    docs = corpus["documentos"].select(_folder(F.col("path")).alias("dir"), F.substring_index("path", "/", -1).alias("file"), "title", "description").filter(~F.col("file").isin(*RESERVED))
    own = docs.select("dir", F.lit(0.0).alias("part"), "file", F.concat(F.lit("* ["), _cell(F.col("title")), F.lit("]("), "file", F.lit(") - "), _cell(F.col("description"))).alias("line"))
    below = docs.select("dir").distinct().filter("dir <> ''").select(_folder(F.col("dir")).alias("up"), F.substring_index("dir", "/", -1).alias("file"))
    below = below.join(docs.select(F.col("dir").alias("up")).distinct(), "up").select(F.col("up").alias("dir"), F.lit(2.0).alias("part"), "file", F.concat(F.lit("* ["), "file", F.lit("/]("), "file", F.lit("/index.md)")).alias("line"))
    heads = below.select("dir").distinct().select("dir", F.lit(1.0).alias("part"), F.posexplode(F.array(F.lit(""), F.lit("## Carpetas"), F.lit(""))).alias("n", "line")).select("dir", "part", F.col("n").cast("string").alias("file"), "line")
    every = reduce(DataFrame.unionByName, [own, below, heads])
    path = F.when(F.col("dir") == "", F.lit("index.md")).otherwise(F.concat("dir", F.lit("/index.md")))
    return every.select(path.alias("path"), F.row_number().over(Window.partitionBy("dir").orderBy("part", "file")).alias("pos"), "line")


def expected(corpus, contract: Contract, today: str, specs: tuple[Spec, ...] = SPECS) -> DataFrame:
    """kind (V12 for indexes, V13 for other files), path, pos and line of all derived files."""
    return reduce(DataFrame.unionByName, [index_lines(corpus).select(F.lit("V12").alias("kind"), "path", "pos", "line"), *(lines(corpus, contract, s, today).select(F.lit("V13").alias("kind"), "path", "pos", "line") for s in specs)])


def body_lines(parsed: DataFrame) -> DataFrame:
    """path, pos, line of the bodies of documents, without blank lines at their ends."""
    body = F.regexp_replace(F.regexp_replace("body", r"^\s*\n", ""), r"\s+$", "")
    rows = parsed.select("path", F.posexplode(F.split(body, "\n")).alias("n", "line"))
    return rows.select("path", (F.col("n") + 1).alias("pos"), F.rtrim("line").alias("line"))


def stale(want: DataFrame, have: DataFrame, files: DataFrame) -> DataFrame:
    """kind, path and state (absent, or stale with the first line that differs) of derived files; files: the paths that there are."""
    named = want.select("kind", "path").distinct()
    here = have.join(named.select("path"), "path", "left_semi").select("path", "pos", F.col("line").alias("there"))
    both = want.select("path", "pos", F.rtrim("line").alias("line")).join(here, ["path", "pos"], "full_outer")
    # blank lines at a file's end do not count
    off = both.filter(F.coalesce("line", _none()) != F.coalesce("there", _none())).groupBy("path").agg(F.min("pos").alias("first"))
    there = files.select("path").distinct().withColumn("__there", F.lit(True))
    rows = named.join(there, "path", "left").join(off, "path", "left")
    state = F.when(F.col("__there").isNull(), "absent").when(F.col("first").isNotNull(), "stale")
    return rows.select("kind", "path", state.alias("state"), F.when(state == "stale", F.col("first")).alias("line")).filter("state is not null")


def texts(rows: DataFrame) -> dict[str, str]:
    """path to text, one file at a time from sorted lines: for writing files, whose size is what bounds it."""
    out: dict[str, list[str]] = {}
    for r in rows.orderBy("path", "pos").toLocalIterator():
        out.setdefault(r.path, []).append(r.line)
    return {p: "\n".join(x).rstrip() + "\n" for p, x in out.items()}
