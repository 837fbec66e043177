"""Search, rules, reports, derived tables, cost and integrity as queries over a corpus, each with its name in EXTRAS."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..operators import search
from . import constraints
from .contract import LEVELS, PERIODS
from .questions import _blank, _human, _titled, bare, matching
from .views import documento_proyecto

EXTRAS: dict = {}


def extra(name: str):
    def put(f):
        EXTRAS[name] = f
        return f

    return put


for _name, _check in constraints.CHECKS.items():
    EXTRAS[_name] = lambda c, p, f=_check: f(c)


# ------------------------------------------------ search

@extra("fts_match")
def _match(c, p):
    return matching(c, p["termino"])


@extra("fts_prefix")
def prefix(c, p):
    return matching(c, "urg*")


@extra("fts_column")
def in_a_column(c, p):
    return matching(c, "title:pregunta NOT urgent")


@extra("fts_phrase")
def phrase(c, p):
    return matching(c, '"of the"')


@extra("fts_topk")
def topk(c, p):
    found = c.stored.ranked(p["termino"], 10) if c.stored else search.ranked(c.busqueda, p["termino"], 10)
    return found.select("path", F.round("relevancia", 6).alias("relevancia"))


@extra("fts_postings")
def postings(c, p):
    """The whole inverted index: in which column of which document each word is, and how often."""
    return c.stored.postings() if c.stored else search.postings(c.busqueda)


@extra("fts_terms")
def terms(c, p):
    """How many documents have each word of titles and descriptions, and how often."""
    words = c["documentos"].select("path", F.explode(F.concat(tokens(F.col("title")), tokens(F.col("description")))).alias("term"))
    return words.groupBy("term").agg(F.countDistinct("path").alias("docs"), F.count("*").alias("tf"))


# ------------------------------------------------ rules over the tables: (path, what)

def _finding(rows: DataFrame, path: str | Column, what: str | Column) -> DataFrame:
    return rows.select((F.col(path) if isinstance(path, str) else path).alias("path"), (F.lit(what) if isinstance(what, str) else what).alias("what"))


@extra("rule_v15")
def past_its_date(c, p):
    """As instants, where the text comparison of cq_24 may differ."""
    d = c["documentos"].filter(F.coalesce("status", F.lit("stable")) == "stable")
    return _finding(d.filter(F.try_to_timestamp("stale_after") < F.try_to_timestamp(F.lit(p["ahora"]))), "path", F.col("stale_after"))


@extra("rule_v16")
def below_its_floor(c, p):
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("classification"))
    floor = F.when(F.col("type").isin("Persona", "Insumo"), 3).otherwise(2)
    d = c["documentos"].withColumn("r", F.coalesce(rank, F.lit(0)))
    return _finding(d.filter("r = 0"), "path", "unknown level").unionByName(_finding(d.filter((F.col("r") > 0) & (F.col("r") < floor)), "path", "below the floor"))


def _references(c) -> DataFrame:
    """doc, field, value of every reference to a person."""
    one = [("pregunta", "responsable"), ("pregunta", "respondida_por"), ("sistema", "owner"), ("persona", "reports_to")]
    many = [("decision_decisores", "decisores"), ("iniciativa_personas", "personas"), ("reunion_asistentes", "asistentes")]
    singles = (c[t].select("doc", F.lit(f).alias("field"), F.col(f).alias("value")) for t, f in one)
    lists = (c[t].select("doc", F.lit(f).alias("field"), "value") for t, f in many)
    return reduce(DataFrame.unionByName, [*singles, *lists]).filter(~_blank(F.col("value")))


@extra("rule_v17")
def people(c, p):
    """References to people by how they end: free text, nowhere, or at a document of another type; those at a Persona are left out."""
    docs = c["documentos"].select(F.col("path").alias("target"), "type")
    refs = _references(c).withColumn("target", F.when(F.col("value").startswith("/"), bare(F.col("value"))))
    state = F.when(F.col("target").isNull(), "free text").when(F.col("type").isNull(), "missing").when(F.col("type") != "Persona", F.col("type"))
    return refs.join(docs, "target", "left").withColumn("state", state).filter("state is not null").groupBy("field", "state").agg(F.count("*").alias("n"))


@extra("rule_v20")
def projects_without_initiative(c, p):
    known = c["iniciativa"].select("proyecto")
    return documento_proyecto(c).filter("proyecto <> 'transversal'").join(known, "proyecto", "left_anti").select(F.col("doc").alias("path"), F.col("proyecto").alias("what"))


@extra("rule_v21")
def periods(c, p):
    return c["iniciativa"].filter(~F.col("periodo").rlike("^(" + "|".join(PERIODS.values()) + ")$")).select(F.col("doc").alias("path"), F.col("periodo").alias("what"))


@extra("rule_v24")
def intervals(c, p):
    """Ends before begins, successors without an end, and two documents that replace each other."""
    from .views import vigencia

    v = vigencia(c).select("doc", "valido_desde", "valido_hasta", bare(F.col("reemplazada_por")).alias("next"))
    back = v.select(F.col("next").alias("doc"), F.col("doc").alias("next"))
    return reduce(DataFrame.unionByName, [_finding(v.filter("valido_hasta < valido_desde"), "doc", "inverted"), _finding(v.filter("next is not null and valido_hasta is null"), "doc", "no end"), _finding(v.join(back, ["doc", "next"], "left_semi"), "doc", "cycle")])


@extra("rule_v25")
def no_source(c, p):
    sourced = c["documentos_sources"].select(F.col("doc").alias("path")).unionByName(c["insumo"].filter(~_blank(F.col("original"))).select(F.col("doc").alias("path")))
    return c["documentos"].filter("procedencia = 'fuente'").join(sourced, "path", "left_anti").select("path", F.col("type").alias("what"))


@extra("rule_v07")
def conditional(c, p):
    a = c["pregunta"].filter((F.col("estado") == "respondida") & _blank(F.col("respondida_por")))
    b = c["plan"].filter((F.col("source_of_truth") == "externa") & _blank(F.col("external_tracker")))
    return _finding(a, "doc", "respondida_por").unionByName(_finding(b, "doc", "external_tracker"))


@extra("rule_v26")
def cites_unopened(c, p):
    return c["consultas"].filter("citados > completos").select("linea", "citados", "completos")


# ------------------------------------------------ reports

@extra("gov_classification_mix")
def classification_mix(c, p):
    rows = c["documentos"].groupBy("type", "classification").agg(F.count("*").alias("n"))
    return rows.withColumn("pct", F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy("type"))).cast("long"))


@extra("gov_trust")
def trust(c, p):
    """One pass: how many documents agents wrote, and how many of them no human has confirmed."""
    ok = c["documentos_verified"].filter(_human(F.col("by"))).select(F.col("doc").alias("path")).distinct().withColumn("ok", F.lit(True))
    agent = ~_human(F.col("generated_by"))
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    return c["documentos"].join(ok, "path", "left").agg(F.count("*").alias("documents"), n(F.col("ok").isNotNull()).alias("confirmed"), n(F.coalesce(agent, F.lit(False))).alias("by_agents"), n(F.coalesce(agent, F.lit(False)) & F.col("ok").isNull()).alias("by_agents_unconfirmed"))


@extra("gov_lifecycle")
def lifecycle(c, p):
    late = F.coalesce(F.col("stale_after") < p["ahora"], F.lit(False))
    return c["documentos"].groupBy(F.coalesce("status", F.lit("-")).alias("status")).agg(F.count("*").alias("n"), F.sum(late.cast("long")).alias("stale"))


def _all_findings(c, p) -> DataFrame:
    rules = ("rule_v15", "rule_v16", "rule_v20", "rule_v21", "rule_v24", "rule_v25", "rule_v07")
    return reduce(DataFrame.unionByName, (EXTRAS[r](c, p).select(F.lit(r[5:].upper()).alias("check"), "path", "what") for r in rules))


@extra("findings_summary")
def findings_summary(c, p):
    return _all_findings(c, p).groupBy("check").agg(F.count("*").alias("n"))


@extra("findings_top_n")
def findings_top(c, p):
    """The first eight of each check by path, and how many more there are."""
    part, order = Window.partitionBy("check", "part"), ("path", "what")
    # the first eight of each part of a check come before those of the check, so no task has all of them; a part's size goes with its first row
    rows = _all_findings(c, p).withColumn("part", F.pmod(F.xxhash64(*order), F.lit(256)))
    some = rows.withColumn("rank", F.row_number().over(part.orderBy(*order))).withColumn("size", F.count("*").over(part)).filter("rank <= 8")
    own = Window.partitionBy("check")
    first = some.withColumn("n", F.sum(F.when(F.col("rank") == 1, F.col("size"))).over(own)).withColumn("rank", F.row_number().over(own.orderBy(*order))).filter("rank <= 8")
    return first.select("check", "rank", "path", "what", F.greatest(F.col("n") - 8, F.lit(0)).alias("more"))


# ------------------------------------------------ derived

@extra("derive_open_questions")
def derive_open(c, p):
    """Open questions with their owner's title in place of the link, or the link where it ends nowhere, and days since."""
    who = c["documentos"].select(F.col("path").alias("who"), F.col("title").alias("owner"))
    rows = _titled(c, "pregunta").filter("estado = 'abierta'").withColumn("who", bare(F.trim("responsable")))
    age = F.datediff(F.lit(p["hoy"]).try_cast("date"), F.col("created").try_cast("date"))
    link = F.concat(F.lit("["), "title", F.lit("](/"), "doc", F.lit(")"))
    return rows.join(who, "who", "left").select(link.alias("pregunta"), "proyecto", F.coalesce("owner", F.trim("responsable"), F.lit("")).alias("responsable"), "bloqueante", age.alias("dias"))


@extra("derive_goals_grouped")
def derive_goals(c, p):
    """Initiatives by their declared kinds in order, others last, and positions in each."""
    order = F.array(*map(F.lit, ["proyecto-asignado", "objetivo-personal", "objetivo-equipo"]))
    rows = _titled(c, "iniciativa").withColumn("g", F.when(F.array_position(order, F.col("origen")) > 0, F.array_position(order, F.col("origen"))).otherwise(F.lit(99)).cast("int"))
    # positions in parts that follow each other in the order, and the sizes of the parts before: no task has a whole kind
    part = ["g", "periodo", "head"]
    rows = rows.withColumn("head", F.substring("title", 1, 3))
    sizes = rows.groupBy(*part).agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("g").orderBy("periodo", "head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy(*part).orderBy("title", "doc"))).join(sizes, part)
    return rows.select("g", "origen", (F.col("before") + F.col("own")).alias("pos"), "title", "periodo", "estado")


@extra("derive_org_nodes")
def org_nodes(c, p):
    return _titled(c, "persona").select(F.regexp_replace("doc", "[^A-Za-z0-9_]", "_").alias("id"), "title", "rol")


@extra("derive_org_edges")
def org_edges(c, p):
    ident = lambda x: F.regexp_replace(x, "[^A-Za-z0-9_]", "_")
    rows = c["persona"].filter(~_blank(F.col("reports_to"))).withColumn("boss", bare(F.col("reports_to")))
    return rows.join(c["persona"].select(F.col("doc").alias("boss")), "boss").select(ident(F.col("doc")).alias("a"), ident(F.col("boss")).alias("b"))


@extra("derive_org_gaps")
def org_gaps(c, p):
    return _titled(c, "persona").filter(_blank(F.col("reports_to"))).select("doc", "title")


@extra("index_by_directory")
def directory_index(c, p):
    """For each folder how many documents it holds, how many folders below it, and a digest of its lines: a sum, so that it needs no list in memory."""
    folder = lambda x: F.regexp_extract(x, "^(.*)/[^/]*$", 1)
    docs = c["documentos"].select(folder(F.col("path")).alias("dir"), F.substring_index("path", "/", -1).alias("file"), "title", "description")
    line = F.concat(F.lit("* ["), "title", F.lit("]("), "file", F.lit(") - "), "description")
    lists = docs.groupBy("dir").agg(F.count("*").alias("docs"), F.sum(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")).alias("digest"))
    below = docs.select("dir").distinct().select(folder(F.col("dir")).alias("dir")).groupBy("dir").agg(F.count("*").alias("subdirs"))
    return lists.join(below, "dir", "left").select("dir", "docs", F.coalesce("subdirs", F.lit(0)).alias("subdirs"), "digest")


# ------------------------------------------------ cost

@extra("survey_types")
def survey_types(c, p):
    return c.busqueda.join(c["documentos"].select("path", "type"), "path").groupBy("type").agg(F.count("*").alias("n"), F.sum(F.floor(F.length("cuerpo") / 4)).alias("tokens"))


@extra("survey_totals")
def survey_totals(c, p):
    size = F.floor(F.length("cuerpo") / 4)
    rows = c.busqueda.select(size.alias("t"), F.size(F.split("path", "/")).alias("depth"))
    return rows.agg(F.count("*").alias("docs"), F.sum("t").alias("tokens"), F.max("t").alias("largest"), F.max("depth").alias("depth"))


@extra("survey_cost")
def survey_cost(c, p):
    """Reading all against navigating: twice all tokens for derived files, and the five largest documents for a query."""
    t = c.busqueda.select(F.floor(F.length("cuerpo") / 4).alias("t"), "path")
    top = t.orderBy(F.desc("t"), "path").limit(5).agg(F.sum("t"))
    return t.agg((2 * F.sum("t")).alias("derived"), F.count("*").alias("docs")).select("derived", top.scalar().alias("top5"), "docs", F.when(F.col("docs") < 200, "unreliable").otherwise("measured").alias("verdict"))


@extra("survey_link_classes")
def link_classes(c, p):
    """Sources and successors by where they point."""
    links = c["documentos_sources"].select(F.trim("resource").alias("to"))
    for t in ("decision", "lineamiento"):
        links = links.unionByName(c[t].select(F.col("reemplazada_por").alias("to")))
    docs = c["documentos"].select(F.col("path").alias("target"), F.lit(True).alias("there"))
    rows = links.filter("to <> ''").withColumn("target", F.when(F.col("to").startswith("/"), bare(F.col("to"))))
    kind = F.when(F.col("to").contains("://"), "external").when(F.col("there"), "bundle").when(F.col("target").isNotNull(), "missing").otherwise("relative")
    return rows.join(docs, "target", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# ------------------------------------------------ integrity, routing, difference

@extra("content_sha256")
def content_sha256(c, p):
    return c.busqueda.select("path", F.sha2("cuerpo", 256).alias("sha256"))


@extra("raw_manifest_check")
def manifest(c, p):
    """What a manifest of inputs (here made of their rows, some left out or changed) says against the inputs there are."""
    real = c["insumo"].join(c["documentos"].select(F.col("path").alias("doc"), "hash"), "doc").select("doc", "hash")
    n = F.regexp_extract("doc", r"(\d+)\.md$", 1).try_cast("long") % 10
    stated = real.filter(n != 0).select(F.when(n == 1, F.concat("doc", F.lit(".old"))).otherwise(F.col("doc")).alias("doc"), F.when(n == 2, "").when(n == 3, F.reverse("hash")).otherwise(F.col("hash")).alias("stated"))
    state = F.when(F.col("stated").isNull(), "orphan").when(F.col("hash").isNull(), "missing").when(F.col("stated") == "", "no hash").when(F.col("stated") == F.col("hash"), "ok").otherwise("changed")
    return stated.join(real, "doc", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@extra("diff_new_changed_gone")
def diff(c, p):
    from .incremental import difference

    now = c["documentos"].select("path", "hash", (F.length("title") % 4).alias("n"))
    n = F.col("n")
    before = now.filter(n != 0).select(F.when(n == 1, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"), F.when(n == 2, "x").otherwise(F.col("hash")).alias("hash"))
    return difference(before, now.drop("n")).groupBy("state").agg(F.count("*").alias("n"))


@extra("place_documents")
def places(c, p):
    """Documents of a type by whether the contract names their folder."""
    from .contract import Contract

    contract = Contract()
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    fits = reduce(Column.__or__, ((F.col("type") == k) & folder.rlike("|".join(contract.place_shapes(k))) for k in contract.types))
    return c["documentos"].groupBy("type", fits.alias("placed")).agg(F.count("*").alias("n"))


# ------------------------------------------------ costs, governance and depth

@extra("survey_verdict")
def verdict(c, p):
    """The model of costs over all documents."""
    from .cost import model

    line = F.length("title") + F.length("description") + F.length(F.substring_index("path", "/", -1)) + 9
    return model(c.busqueda.select("path", F.length(F.coalesce("cuerpo", F.lit(""))).alias("chars"), line.alias("line")))


@extra("survey_fields")
def fields(c, p):
    """How many documents of each type have a value in each field."""
    from .cost import filled

    return filled(c)


@extra("gov_personal")
def personal(c, p):
    """Documents about persons by classification, and how many of them are below confidential."""
    from .contract import PERSONAL

    rows = c["documentos"].filter(F.col("type").isin(*PERSONAL))
    return rows.groupBy("type", "classification").agg(F.count("*").alias("n"), F.sum(F.col("classification").isin("public", "internal").cast("long")).alias("exposed"))


@extra("gov_stewardship")
def stewardship(c, p):
    """Who has confirmed how many documents of each type; those that nobody has confirmed under -."""
    by = c["documentos_verified"].filter(_human(F.col("by"))).select(F.col("doc").alias("path"), "by").distinct()
    return c["documentos"].select("path", "type").join(by, "path", "left").groupBy("type", F.coalesce("by", F.lit("-")).alias("steward")).agg(F.count("*").alias("n"))


@extra("gov_unset")
def unset(c, p):
    """Documents without a state, a maker or a date to be looked at again, by type; deprecated ones apart."""
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    return c["documentos"].groupBy("type").agg(F.count("*").alias("n"), n(F.col("status").isNull()).alias("no_status"), n(F.col("generated_by").isNull()).alias("no_maker"), n(F.col("stale_after").isNull()).alias("no_date"), n(F.col("status") == "deprecated").alias("deprecated"))


@extra("archive_periods")
def archived_periods(c, p):
    """Periods that archived copies of delivered initiatives would lie under, each once."""
    from .upkeep import archive_periods

    rows = c["iniciativa"].filter("estado = 'entregada'")
    return archive_periods(rows.select(F.concat(F.lit("04-archivo/"), "periodo", F.lit("/"), "proyecto", F.lit("/04-archivo/"), "periodo", F.lit("/CONTEXT.md")).alias("path")))


@extra("org_depth")
def org_depth(c, p):
    """How far below a person without a superior everybody is; those in a ring, or below one, are left out. A level is a join, written before the next."""
    from ..scratch import saved

    rows = saved(c["persona"].select("doc", F.when(~_blank(F.col("reports_to")), bare(F.col("reports_to"))).alias("boss")), "people")
    level, out = rows.filter("boss is null").select("doc", F.lit(0).alias("depth")), []
    while not (level := saved(level, "level")).isEmpty():
        out.append(level)
        level = rows.join(level.withColumnRenamed("doc", "boss"), "boss").select("doc", (F.col("depth") + 1).alias("depth"))
    return reduce(DataFrame.unionByName, out, rows.limit(0).select("doc", F.lit(0).alias("depth")))
