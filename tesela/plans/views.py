"""The three views of the model, each generated from a list of what its arms read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dated fields by table: an event for each, not for each document. Fixed values.
DATED = [("analisis", "fecha"), ("decision", "fecha"), ("decision", "valido_desde"), ("decision", "valido_hasta"), ("lineamiento", "fecha"), ("lineamiento", "valido_desde"), ("lineamiento", "valido_hasta"), ("plan", "last_review"), ("pregunta", "created"), ("reunion", "fecha")]
SCOPED = ["analisis", "decision", "diagrama", "iniciativa", "insumo", "plan", "playbook", "pregunta", "reunion"]
RULED = ["decision", "lineamiento"]


def _titled(corpus, name: str) -> DataFrame:
    return corpus[name].join(corpus["documentos"].filter(F.col("type") == name.capitalize()).select(F.col("path").alias("doc"), "title"), "doc")


def eventos(corpus) -> DataFrame:
    """fecha, tipo, campo, doc, title, proyecto: a row for each dated field, also where the date is null. A guideline has no project."""
    by_table: dict[str, list[str]] = {}
    for name, field in DATED:
        by_table.setdefault(name, []).append(field)
    arms = []
    for name, fields in by_table.items():  # one read of a table for all its dates
        rows = _titled(corpus, name)
        scope = F.col("proyecto") if "proyecto" in rows.columns else F.lit(None).cast("string")
        dates = F.array(*(F.struct(F.col(f).alias("fecha"), F.lit(f).alias("campo")) for f in fields))
        arms.append(rows.select("doc", "title", scope.alias("proyecto"), F.explode(dates).alias("e")).select("e.fecha", F.lit(name.capitalize()).alias("tipo"), "e.campo", "doc", "title", "proyecto"))
    return reduce(DataFrame.unionByName, arms)


def documento_proyecto(corpus) -> DataFrame:
    return reduce(DataFrame.unionByName, (corpus[name].select("doc", "proyecto") for name in SCOPED))


def vigencia(corpus) -> DataFrame:
    """Whether a decision or guideline is in force, from which of its dates are null alone: today's date plays no part."""
    state = F.when(F.col("valido_hasta").isNull(), "vigente").otherwise(F.when(F.col("reemplazada_por").isNull(), "caducada").otherwise("reemplazada"))
    arms = (_titled(corpus, name).select("doc", F.lit(name.capitalize()).alias("tipo"), "title", "valido_desde", "valido_hasta", "reemplazada_por", "estado", state.alias("vigencia")) for name in RULED)
    return reduce(DataFrame.unionByName, arms)


VIEWS = {"eventos": eventos, "documento_proyecto": documento_proyecto, "vigencia": vigencia}
