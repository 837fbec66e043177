"""The rules of the contract as queries over a bundle: each gives findings (rule, severity, path, line, message).

A bundle's parsed rows are read as they are for front matter, exploded to lines for bodies, and joined by path for references. Reserved files
meet V3 and V26 alone, exempt ones V1, V2 and V18. Times are parameters, so results do not depend on the clock.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .contract import CITATIONS, EXEMPT, LEVELS, LOG_LINE, RESERVED, SCHEMA, SENTINELS, holds
from .derived import SPECS

#: The target of an inline link, a heading with its text, and a slot that a template leaves to be filled in.
TARGET = r"\]\(\s*<?([^\s<>()]+)>?(?:\s[^()]*)?\)"
HEADED = r"^ {0,3}#{1,6}[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$"
SLOT = r"<\s*[^\s<>/!][^<>]+>|(?<!\w)TODO(?!\w)"
DATE = r"^\d{4}-\d{2}-\d{2}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
RULES: dict = {}


def rule(name: str):
    def put(f):
        RULES[name] = f
        return f

    return put


class Context:
    """What rules share of a bundle: documents by role, their front matter, lines and links."""

    def __init__(self, bundle, now: str = "2026-06-14T00:00:00Z", staged: list[str] | None = None):
        self.bundle, self.contract, self.now = bundle, bundle.contract, now
        self.all = bundle.parsed.filter(F.col("path").endswith(".md") & ~F.col("path").startswith(SCHEMA) & ~F.col("path").isin(*(s.path for s in SPECS)))
        base = bundle.name(F.col("path"))
        self.reserved = self.all.filter(base.isin(*RESERVED)).withColumn("base", base)
        own = self.all.filter(~base.isin(*RESERVED))
        if staged is not None:  # per-document rules look at these alone; targets stay all documents
            own = own.join(own.sparkSession.createDataFrame([(p,) for p in staged], "path string"), "path", "left_semi")
        self.own, self.exempt = own, bundle.name(F.col("path")).isin(*EXEMPT)
        self.read = own.filter("has_front and error is null and type is not null")
        self.typed = self.read.filter(F.col("type").isin(*self.contract.types) & ~self.exempt)
        self.meta = {k: self.typed.filter(F.col("type") == k).select("path", "keys", "body_hash", F.from_json("meta", self.contract.json_struct(k)).alias("m")) for k in self.contract.types}
        self.paths = bundle.parsed.select(F.col("path").alias("target"), F.col("type").alias("target_type"))
        self.lines = self.typed.select("path", F.explode("lines").alias("l")).select("path", "l.line", "l.text")
        link = F.explode(F.regexp_extract_all("text", F.lit(TARGET), F.lit(1)))
        self.links = self.lines.select("path", "line", link.alias("to"))

    @cached_property
    def derived(self) -> DataFrame:
        from . import derived

        return derived.expected(self.bundle, self.contract, self.now[:10])

    def fields(self, *kinds: str):
        """(type, name, field) of fields of some kinds."""
        return [(k, n, f) for k in self.contract.types for n, f in self.contract.fields(k).items() if not kinds or f.kind in kinds]

    def values(self, *kinds: str) -> DataFrame | None:
        """path, field, value of scalar fields of some kinds and of lists of such, blanks left out."""
        out = []
        for k in self.contract.types:
            found = [F.struct(F.lit(n).alias("field"), F.col(f"m.{n}").alias("value")) for n, f in self.contract.fields(k).items() if f.kind in kinds]
            if found:
                out.append(self.meta[k].select("path", F.explode(F.array(*found)).alias("x")).select("path", "x.field", "x.value"))
            for n, f in self.contract.fields(k).items():
                if f.kind == "list" and f.of in kinds:
                    out.append(self.meta[k].select("path", F.lit(n).alias("field"), F.explode(f"m.{n}").alias("value")))
        return reduce(DataFrame.unionByName, out).filter("trim(value) <> ''") if out else None


def found(rows: DataFrame, name: str, severity: str, message: str | Column, line: str | None = None) -> DataFrame:
    return rows.select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "path", (F.col(line) if line else F.lit(None)).cast("int").alias("line"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _both(*frames: DataFrame | None) -> DataFrame:
    return reduce(DataFrame.unionByName, [f for f in frames if f is not None])


def _flags(x: Context, name: str, tests) -> DataFrame:
    """One read of each type for all its tests: tests(type) gives (severity, message, condition)."""
    out = []
    for k, rows in x.meta.items():
        hits = [F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(msg).alias("message"))) for sev, msg, cond in tests(k)]
        if hits:
            out.append(rows.select("path", F.explode(F.array_compact(F.array(*hits))).alias("h")).select(F.lit(name).alias("rule"), "h.severity", "path", F.lit(None).cast("int").alias("line"), "h.message"))
    return _both(*out)


@rule("V1")
def readable(x):
    return _both(found(x.own.filter("error is not null"), "V1", "error", F.col("error"), "error_line"), found(x.own.filter("error is null and not has_front"), "V1", "error", "no front matter"))


@rule("V2")
def has_type(x):
    return found(x.own.filter("has_front and error is null and type is null"), "V2", "error", "no type")


@rule("V3")
def reserved_files(x):
    log = x.reserved.filter(F.col("base").isin("log.md", "log-consultas.md")).select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("n", "text"))
    head = F.regexp_extract("text", r"^##\s+(\S+)", 1)
    bad = log.filter(F.col("text").rlike(r"^##\s+\S") & ~head.rlike(DATE)).withColumn("line", F.col("n") + 1)
    index = x.reserved.filter("base = 'index.md' and has_front")
    extra = F.array_except("keys", F.array(F.lit("okf_version")))
    return _both(found(bad, "V3", "error", "a log's heading is no date", "line"), found(index.filter("path <> 'index.md'"), "V3", "error", "front matter in an index below the top"), found(index.filter((F.col("path") == "index.md") & (F.size(extra) > 0)), "V3", "error", "fields in the top index"))


@rule("V4")
def known_type(x):
    return found(x.read.filter(~x.exempt & ~F.col("type").isin(*x.contract.types)), "V4", "warning", F.concat(F.lit("unknown type "), "type"))


@rule("V5")
def required(x):
    def tests(k):
        for n, f in x.contract.fields(k).items():
            if f.required and n not in ("classification", "type"):
                yield f.severity, f"{n} is missing", ~F.array_contains("keys", n) if f.kind == "list" else F.col(f"m.{n}").isNull()

    return _flags(x, "V5", tests)


@rule("V6")
def well_formed(x):
    actor = "^(" + "|".join(x.contract.actors) + ")$"

    def tests(k):
        for n, f in x.contract.fields(k).items():
            v = F.col(f"m.{n}")
            wrong = {"enum": lambda v=v, f=f: ~v.isin(*f.values), "date": lambda v=v: ~v.rlike(DATE), "datetime": lambda v=v: ~v.rlike(INSTANT), "boolean": lambda v=v: ~v.isin("0", "1"), "sentence": lambda v=v, f=f: F.length(v) > f.max_chars}
            wrong |= dict.fromkeys(("link", "typed-ref"), lambda v=v: ~v.rlike(r"^(/|\./|\.\./)|://"))
            if n != "classification" and f.kind in wrong:
                yield f.severity, f"{n}: not a {f.kind}", v.isNotNull() & wrong[f.kind]()
        yield "error", "generated.by: not an actor", F.col("m.generated.by").isNotNull() & ~F.col("m.generated.by").rlike(actor)
        yield "error", "verified.by: not an actor", F.exists(F.col("m.verified"), lambda e: ~e["by"].rlike(actor))

    return _flags(x, "V6", tests)


@rule("V7")
def conditional(x):
    blank = lambda n: F.trim(F.coalesce(F.col(f"m.{n}").cast("string"), F.lit(""))) == ""
    return _flags(x, "V7", lambda k: [("error", f"{n} is needed here", holds(when, lambda f: F.col(f"m.{f}")) & blank(n)) for t, when, need in x.contract.conditions if t == k for n in need])


@rule("V8")
def declared(x):
    out = [m.select("path", F.explode(F.array_except("keys", F.array(*map(F.lit, x.contract.fields(k))))).alias("key")) for k, m in x.meta.items()]
    return found(_both(*out), "V8", "warning", F.concat(F.lit("not declared: "), "key"))


@rule("V9")
def filled_in(x):
    """The first open slot of a body, and slots in front matter. Comments are taken away line by line."""
    clean = F.regexp_replace("text", "<!--.*?-->", "")
    first = x.lines.filter(clean.rlike(SLOT)).groupBy("path").agg(F.min("line").alias("line"))
    return _both(found(first, "V9", "error", "a slot that is not filled in", "line"), found(x.typed.filter(F.col("meta").rlike(SLOT)), "V9", "error", "a slot in the front matter"))


def _targets(x) -> DataFrame:
    """Links inside the bundle with the path they lead to: from its top, or from the document's folder."""
    to = F.regexp_replace("to", "[#?].*$", "")
    rows = x.links.filter(~F.col("to").contains("://") & ~F.col("to").rlike("^(#|mailto:)")).withColumn("plain", to)
    parts = F.filter(F.split(F.when(F.col("plain").startswith("/"), F.expr("substring(plain, 2)")).otherwise(F.concat(F.regexp_extract("path", "^(.*/)?[^/]*$", 1), "plain")), "/"), lambda p: ~p.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return rows.withColumn("target", F.array_join(up, "/")).filter("target like '%.md'")


@rule("V10")
def links(x):
    missing = _targets(x).join(x.paths, "target", "left_anti")
    odd = x.links.filter(F.col("to").contains("://") & ~F.col("to").rlike(r"^[a-z][a-z0-9+.-]*://[^/\s]"))
    return _both(found(missing, "V10", "info", F.concat(F.lit("leads nowhere: "), "to"), "line"), found(odd, "V10", "error", F.concat(F.lit("malformed: "), "to"), "line"))


@rule("V11")
def typed_references(x):
    out = []
    for k, n, f in x.fields("typed-ref"):
        rows = x.meta[k].select("path", F.regexp_replace(f"m.{n}", "^/", "").alias("target")).join(x.paths, "target").filter(F.col("target_type") != f.target)
        out.append(found(rows, "V11", "error", F.concat(F.lit(f"{n} leads to a "), "target_type")))
    return _both(*out)


def _derived(x, kind: str) -> DataFrame:
    from . import derived

    return derived.stale(x.derived.filter(F.col("kind") == kind), derived.body_lines(x.bundle.parsed), x.bundle.parsed.select("path"))


@rule("V12")
def indexes(x):
    """Every folder's index: absent, or other than the documents below it give."""
    return found(_derived(x, "V12"), "V12", "error", F.concat(F.lit("the index is "), "state"), "line")


@rule("V13")
def derived_files(x):
    return found(_derived(x, "V13"), "V13", "error", F.concat(F.lit("the derived file is "), "state"), "line")


@rule("V14")
def artifacts(x):
    """Generated schema files; looked at where the bundle has any."""
    from .upkeep import stale_artifacts

    files = x.bundle.content.filter(F.col("path").startswith(SCHEMA))
    off = stale_artifacts(files, x.contract)
    return found(off.limit(0) if files.isEmpty() else off, "V14", "error", F.concat(F.lit("the generated file is "), "state"))


@rule("V15")
def stale(x):
    late = F.try_to_timestamp(F.col("m.stale_after")) < F.try_to_timestamp(F.lit(x.now))
    return _flags(x, "V15", lambda k: [("warning", "past its date and still stable", late & (F.coalesce("m.status", F.lit("stable")) == "stable"))])


@rule("V16")
def classification(x):
    v = F.col("m.classification")
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), v)

    def tests(k):
        floor = LEVELS.index(x.contract.floors.get(k, "internal")) + 1
        return [("warning", "no classification", F.coalesce(v, F.lit("")) == ""), ("error", "unknown level", (v != "") & (rank == 0)), ("error", f"below the floor of {k}", (rank > 0) & (rank < floor))]

    return _flags(x, "V16", tests)


@rule("V17")
def people(x):
    refs = x.values("person-ref")
    led = refs.filter(F.col("value").startswith("/")).withColumn("target", F.regexp_replace("value", "^/", "")).join(x.paths, "target", "left")
    return _both(found(refs.filter(~F.col("value").startswith("/")), "V17", "warning", F.concat("field", F.lit(": free text"))), found(led.filter("target_type is null"), "V17", "warning", F.concat("field", F.lit(" leads nowhere"))), found(led.filter("target_type <> 'Persona'"), "V17", "error", F.concat("field", F.lit(" leads to a "), "target_type")))


@rule("V18")
def yaml_safe(x):
    rows = x.read.select("path", F.explode("hazards").alias("h")).select("path", "h.*")
    text = F.concat("key", F.lit(": "), "why")
    return _both(found(rows.filter("breaks"), "V18", "error", text, "line"), found(rows.filter("not breaks"), "V18", "warning", text, "line"))


@rule("V19")
def in_place(x):
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return _flags(x, "V19", lambda k: [("warning", f"not where a {k} belongs", ~folder.rlike("|".join(x.contract.place_shapes(k))))] if x.contract.place_shapes(k) else [])


@rule("V20")
def known_keys(x):
    known = x.meta["Iniciativa"].select(F.col("m.proyecto").alias("value"))
    return found(x.values("type-key").filter(~F.col("value").isin(*SENTINELS)).join(known, "value", "left_anti"), "V20", "warning", F.concat(F.lit("no initiative "), "value"))


@rule("V21")
def periods(x):
    shape = x.contract.period_shape
    folder = F.regexp_extract("path", "^04-archivo/([^/]+)/", 1)
    return _both(_flags(x, "V21", lambda k: [("warning", "the period has another shape", ~F.col("m.periodo").rlike(shape))] if "periodo" in x.contract.fields(k) else []), found(x.typed.filter((folder != "") & ~folder.rlike(shape)), "V21", "warning", "the archive folder's period has another shape"))


@rule("V22")
def citations(x):
    """Links under the heading of citations (the last heading above them) that lead nowhere."""
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("text").rlike(HEADED), F.regexp_extract("text", HEADED, 1)), ignorenulls=True).over(upto)
    cited = x.lines.withColumn("head", head).filter(F.col("head") == CITATIONS).select("path", "line")
    return found(_targets(x).join(cited, ["path", "line"], "left_semi").join(x.paths, "target", "left_anti"), "V22", "error", F.concat(F.lit("cites what is not there: "), "to"), "line")


@rule("V23")
def summaries(x):
    return _flags(x, "V23", lambda k: [("warning", "the summary is of another body", F.col("m.resumen_hash").isNotNull() & (F.col("m.resumen_hash") != F.col("body_hash")))])


@rule("V24")
def validity(x):
    ruled = [k for k in x.contract.types if "valido_hasta" in x.contract.fields(k)]
    rows = _both(*(x.meta[k].select("path", F.col("m.valido_desde").alias("since"), F.col("m.valido_hasta").alias("until"), F.regexp_replace("m.reemplazada_por", "^/", "").alias("next")) for k in ruled))
    back = rows.select(F.col("next").alias("path"), F.col("path").alias("next"))
    return _both(found(rows.filter("until < since"), "V24", "error", "ends before it begins"), found(rows.filter("next is not null and until is null"), "V24", "error", "replaced without an end"), found(rows.join(back, ["path", "next"], "left_semi"), "V24", "error", "two replace each other"))


@rule("V25")
def provenance(x):
    def tests(k):
        bare = F.size("m.sources") == 0
        if "original" in x.contract.fields(k):
            bare = bare & F.col("m.original").isNull()
        return [("warning", "from a source that is not named", (F.col("m.procedencia") == "fuente") & bare)]

    return _flags(x, "V25", tests)


@rule("V26")
def log_lines(x):
    rows = x.reserved.filter("base = 'log-consultas.md'").select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("n", "text")).filter(F.col("text").startswith("- ")).withColumn("line", F.col("n") + 1)
    n = lambda i: F.regexp_extract("text", LOG_LINE, i).try_cast("int")
    good = F.rtrim("text").rlike(LOG_LINE)
    return _both(found(rows.filter(~good), "V26", "error", "a line of another shape", "line"), found(rows.filter(good & (n(4) > n(3))), "V26", "error", "cites more than was opened", "line"))


@rule("V27")
def unique_keys(x):
    first = F.row_number().over(Window.partitionBy("k").orderBy("path"))
    rows = x.meta["Iniciativa"].select("path", F.col("m.proyecto").alias("k")).filter("k is not null").withColumn("n", first)
    return found(rows.filter("n > 1"), "V27", "error", F.concat(F.lit("another has the key "), "k"))


#: Rules that look at the corpus as a whole: left out where only staged documents are looked at.
WHOLE = {"V12", "V13", "V14", "V15", "V24", "V27"}


def findings(bundle, now: str = "2026-06-14T00:00:00Z", staged: list[str] | None = None) -> DataFrame:
    """All findings in the order of reports: severity, rule as text, path, line.

    The bundle's rows are parsed once and written; the rules read them from there."""
    x = Context(bundle, now, staged)
    rank = F.array_position(F.array(*map(F.lit, ("error", "warning", "info"))), F.col("severity"))
    return _both(*(f(x) for name, f in RULES.items() if staged is None or name not in WHOLE)).orderBy(rank, "rule", "path", "line")
