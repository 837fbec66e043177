"""Queries over the generated bundle: each rule's findings, what the parser reads, and a projection by difference; converters over pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import convert, generated
from ..sources.bundle import query_log
from ..sources.star import Star
from .contract import LOG_LINE
from .incremental import applied, difference
from .rules import RULES, Context

CHECKED: dict = {}
#: Rules whose findings a query gives; those of the star tables have names of their own.
SHOWN = ("V1", "V2", "V4", "V5", "V6", "V8", "V9", "V10", "V11", "V18", "V19", "V22", "V23", "V27")


def checked(name: str):
    def put(f):
        CHECKED[name] = f
        return f

    return put


def _rule(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return RULES[name](Context(generated.bundle(spark, sf_dir))).select("path", "severity")

    return run


for _name in SHOWN:
    CHECKED[f"rule_v{int(_name[1:]):02}"] = _rule(_name)


@checked("rules_on_bundle")
def rules_on_bundle(spark, sf_dir):
    """How many findings each rule of single documents has on the generated bundle, parsed once for all of them."""
    x = Context(generated.bundle(spark, sf_dir))
    names = [r for r in RULES if r not in ("V3", "V12", "V13", "V14", "V26")]
    return reduce(DataFrame.unionByName, [RULES[r](x).select("rule", "severity") for r in names]).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@checked("findings_by_severity")
def findings_by_severity(spark, sf_dir):
    """The report's counts: for each rule of single documents how many errors, warnings and notes."""
    from .upkeep import by_severity

    x = Context(generated.bundle(spark, sf_dir))
    names = [r for r in RULES if r not in ("V3", "V12", "V13", "V14", "V26")]
    return by_severity(reduce(DataFrame.unionByName, [RULES[r](x) for r in names]))


@checked("frontmatter_parse")
def frontmatter_parse(spark, sf_dir):
    rows = generated.bundle(spark, sf_dir).parsed
    return rows.select("path", "type", "has_front", F.get_json_object("meta", "$.title").alias("title"), F.size("keys").alias("n_keys"), F.col("error").isNotNull().alias("broken"))


@checked("body_sha256")
def body_sha256(spark, sf_dir):
    return generated.bundle(spark, sf_dir).parsed.filter("error is null").select("path", "body_hash")


@checked("bundle_decision")
def bundle_decision(spark, sf_dir):
    """The table of decisions as the bundle gives it."""
    return generated.bundle(spark, sf_dir)["decision"]


@checked("apply_incremental")
def apply_incremental(spark, sf_dir):
    """The tags of all documents brought up to date by difference from a state in which some documents were absent, changed, or others."""
    c = Star(spark, sf_dir)
    now, head = c["documentos_tags"], c["documentos"].select("path", "hash", (F.length("path") % 7).alias("n"))
    before = head.filter("n <> 0").select(F.when(F.col("n") == 1, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"), F.when(F.col("n") == 2, "x").otherwise(F.col("hash")).alias("hash"))
    n = F.length("doc") % 7
    old = now.filter(n != 0).select(F.when(n == 1, F.concat("doc", F.lit(".old"))).otherwise(F.col("doc")).alias("doc"), "idx", F.when(n == 2, "viejo").otherwise(F.col("value")).alias("value"))
    return applied(old, now, difference(before, head.select("path", "hash")))


@checked("querylog_parse")
def querylog_parse(spark, sf_dir):
    """The query log as text lines, a file for each hundred conversations, and read back: dates from headings, counts from lines."""
    c = Star(spark, sf_dir)["consultas"].withColumn("file", F.concat(F.lit("log-"), F.floor(F.col("linea") / 100).cast("string")))
    entry = F.format_string("- consulta %d — %d docs (%d completos, %d citados) · %s · %s", "linea", "docs", "completos", "citados", "modo", F.when(F.col("archivada") == 1, "archivada").otherwise("no"))
    odd = F.when(F.col("linea") % 13 == 4, F.lit("- mal escrita")).otherwise(entry)
    rows = c.select("file", "linea", F.explode(F.array(F.struct((F.col("linea") * 2).alias("at"), F.concat(F.lit("## "), "fecha").alias("line")), F.struct((F.col("linea") * 2 + 1).alias("at"), odd.alias("line")))).alias("x"))
    return query_log(rows.select(F.col("file").alias("path"), F.col("x.at").alias("linea"), "x.line"))


@checked("querylog_malformed")
def querylog_malformed(spark, sf_dir):
    """Lines that a log can't be read from, by kind of fault, over lines made of the log's rows."""
    c = Star(spark, sf_dir)["consultas"]
    entry = F.format_string("- consulta %d — %d docs (%d completos, %d citados) · %s · %s", "linea", "docs", "completos", "citados", "modo", F.when(F.col("archivada") == 1, "archivada").otherwise("no"))
    line = F.when(F.col("linea") % 13 == 4, F.lit("- mal escrita")).when(F.col("linea") % 13 == 5, F.replace(entry, F.lit("·"), F.lit("-"))).otherwise(entry)
    fault = F.when(~F.col("line").rlike(LOG_LINE), "shape").when(F.regexp_extract("line", LOG_LINE, 4).cast("long") > F.regexp_extract("line", LOG_LINE, 3).cast("long"), "cites more")
    return c.select(line.alias("line")).select(fault.alias("fault")).filter("fault is not null").groupBy("fault").agg(F.count("*").alias("n"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))


@checked("html_to_markdown")
def html_to_markdown(spark, sf_dir):
    """Every page as Markdown; tests hold it against a plain version."""
    return convert.convert(_pages(spark, sf_dir)).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("page_id"), "status", "text", F.size("warnings").alias("warnings"))


@checked("html_noise_count")
def html_noise_count(spark, sf_dir):
    """How many opening tags of elements that are no content each page has."""
    names = "|".join(sorted(convert.NOISE))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.size(F.regexp_extract_all(F.lower(F.coalesce("html", F.lit(""))), F.lit(rf"<(?:{names})(?=[\s>/])"), F.lit(0))).cast("long").alias("noise"))


_N = "(select doc_id n, regexp_replace(coalesce(text, ''), 'TODO', 'todo', 'g') t from documents)"
_KIND = "case when n < 50 then 'Iniciativa' when n < 100 then 'Persona' when n % 97 = 3 then 'Cosa' when n % 97 in (20, 21) then 'Iniciativa' when n % 97 = 9 then 'Persona' when n % 97 = 22 then 'Pregunta' else 'Decision' end"
_PATH = f"""case when n >= 100 and n % 97 = 12 then 'otra/parte/d' || n || '.md' when n < 50 then '01-proyectos/p' || n || '/CONTEXT.md' when {_KIND} = 'Iniciativa' then '01-proyectos/px' || n || '/CONTEXT.md' when {_KIND} = 'Persona' then '02-areas/personas/d' || n || '.md'
    when {_KIND} = 'Pregunta' then '01-proyectos/p' || n % 50 || '/04-preguntas/d' || n || '.md' else '01-proyectos/p' || n % 50 || '/02-decisiones/d' || n || '.md' end"""
#: Which keys have a finding of each rule, and its severity.
_HIT = {
    "V1": ("n % 97 = 1", "error"), "V2": ("n % 97 = 2", "error"), "V4": ("n % 97 = 3", "warning"), "V5": ("n % 97 = 4", "error"), "V6": ("n % 97 = 5", "error"), "V7": ("n % 97 = 22", "error"), "V8": ("n % 97 = 6", "warning"), "V9": ("n % 97 = 7", "error"), "V11": ("n % 97 = 9", "error"),
    "V15": ("n % 97 = 19", "warning"), "V16": ("n % 97 = 18", "error"), "V17": ("n % 97 = 10", "warning"), "V18": ("n % 97 = 11", "error"), "V19": ("n % 97 = 12", "warning"), "V20": ("n % 97 = 13", "warning"), "V21": ("n % 97 = 21", "warning"), "V22": ("n % 97 = 14", "error"), "V23": ("n % 97 = 15", "warning"),
    "V24": ("n % 97 = 16", "error"), "V25": ("n % 97 = 17", "warning"), "V27": ("n % 97 = 20", "error"),
}
_hits = {r: f"select {_PATH} path, '{severity}' severity from {_N} where n >= 100 and {where}" for r, (where, severity) in _HIT.items()}
# a link to nowhere is a finding of V10 wherever it stands
_hits["V10"] = f"select {_PATH} path, 'info' severity from {_N} where n >= 100 and n % 97 in (8, 14)"
_BODY = "'# Documento ' || n || chr(10) || chr(10) || translate(t, '<>[]()`~#|' || chr(13), '') || chr(10) || case when n < 100 then 'Ver [x](/01-proyectos/p1/CONTEXT.md)' when n % 97 = 7 then 'Queda <por escribir>' when n % 97 = 8 then 'Ver [eso](/no/hay.md)' when n % 97 = 14 then '## Citations' || chr(10) || chr(10) || '[eso](/no/hay.md)' else 'Ver [x](/01-proyectos/p1/CONTEXT.md)' end"

SQL = {f"rule_v{int(r[1:]):02}": _hits[r] for r in SHOWN} | {
    "rules_on_bundle": "select rule, severity, count(*) n from (" + " union all ".join(f"select '{r}' as rule, severity from ({sql})" for r, sql in _hits.items()) + ") group by all",
    "findings_by_severity": "select rule, count(*) filter (severity = 'error') error, count(*) filter (severity = 'warning') warning, count(*) filter (severity = 'info') info, count(*) total from (" + " union all ".join(f"select '{r}' as rule, severity from ({sql})" for r, sql in _hits.items()) + ") group by rule",
    "frontmatter_parse": f"""select {_PATH} path, case when n >= 100 and n % 97 in (1, 2) then null else {_KIND} end as type, not (n >= 100 and n % 97 = 1) has_front, case when n >= 100 and n % 97 = 1 then null else 'Documento ' || n end title,
        cast(case when n >= 100 and n % 97 = 1 then 0 else 9 + case {_KIND} when 'Iniciativa' then 4 when 'Persona' then 1 when 'Pregunta' then 4 else 4 end
        + case when n < 100 then 0 when n % 97 in (2, 4) then -1 when n % 97 in (6, 9) then 1 when n % 97 in (16, 19) then 2 else 0 end end as int) n_keys, n >= 100 and n % 97 = 1 broken from {_N}""",
    "body_sha256": f"select {_PATH} path, sha256(trim({_BODY}, ' ' || chr(9) || chr(10) || chr(11) || chr(12)) || chr(10)) body_hash from {_N} where not (n >= 100 and n % 97 = 1)",
    "bundle_decision": f"""select {_PATH} doc, case when n % 97 = 13 then 'nadie' else 'p' || n % 50 end proyecto, 'aceptada' estado, case when n % 97 = 5 then 'ayer' else '2026-01-02' end fecha, case when n % 97 = 16 then '2026-02-01' end valido_desde,
        case when n % 97 = 16 then '2026-01-01' end valido_hasta, cast(null as varchar) reemplazada_por from {_N} where {_KIND} = 'Decision' and n % 97 not in (1, 2)""",
    "apply_incremental": "select doc, idx, value from documentos_tags",
    "querylog_parse": "select linea * 2 + 1 linea, fecha, docs, completos, citados, modo, archivada from consultas where linea % 13 <> 4",
    "querylog_malformed": "select 'shape' fault, count(*) n from consultas where linea % 13 in (4, 5) having count(*) > 0 union all select 'cites more', count(*) from consultas where linea % 13 not in (4, 5) and citados > completos having count(*) > 0",
    "html_noise_count": f"select page_id, cast(len(regexp_extract_all(lower(coalesce(html, '')), '<({'|'.join(sorted(convert.NOISE))})[\\s>/]')) as bigint) noise from pages",
}
