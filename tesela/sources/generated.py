"""A bundle of Markdown files made of the documents table: front matter by arithmetic on keys, with a defect for each rule at some remainders, and the
text as body. Through it the parser and the rules run at the size of the table.

Documents 0 to 49 are initiatives, 50 to 99 persons, all others decisions of these initiatives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bundle import Bundle

#: Remainder modulo 97 of a decision's key to the defect it has.
DEFECTS = {"V1": 1, "V2": 2, "V4": 3, "V5": 4, "V6": 5, "V8": 6, "V9": 7, "V10": 8, "V11": 9, "V17": 10, "V18": 11, "V19": 12, "V20": 13, "V22": 14, "V23": 15, "V24": 16, "V25": 17, "V16": 18, "V15": 19, "V27": 20, "V21": 21, "V7": 22}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of each document; several rows of one key give a file each, told apart by a number."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.col("doc_id")
    at = lambda rule: (n >= 100) & (n % 97 == DEFECTS[rule])
    kind = F.when(n < 50, "Iniciativa").when(n < 100, "Persona").when(at("V4"), "Cosa").when(at("V27") | at("V21"), "Iniciativa").when(at("V11"), "Persona").when(at("V7"), "Pregunta").otherwise("Decision")
    project = (n % 50).cast("string")
    folder = F.when(at("V19"), "otra/parte").when(kind == "Persona", "02-areas/personas").when(kind == "Iniciativa", F.concat(F.lit("01-proyectos/p"), F.when(n < 50, n.cast("string")).otherwise(F.concat(F.lit("x"), n.cast("string"))))).when(kind == "Pregunta", F.concat(F.lit("01-proyectos/p"), project, F.lit("/04-preguntas"))).otherwise(F.concat(F.lit("01-proyectos/p"), project, F.lit("/02-decisiones")))
    path = F.concat(folder, F.when(kind == "Iniciativa", "/CONTEXT.md").otherwise(F.concat(F.lit("/d"), n.cast("string"), F.lit(".md"))))
    # no sign of Markdown or of a slot in the body but those of the defects
    body = F.concat(
        F.lit("# Documento "), n.cast("string"), F.lit("\n\n"), F.translate(F.regexp_replace("text", "TODO", "todo"), "<>[]()`~#|\r", ""), F.lit("\n"),
        F.when(at("V9"), "Queda <por escribir>\n").when(at("V10"), "Ver [eso](/no/hay.md)\n").when(at("V22"), "## Citations\n\n[eso](/no/hay.md)\n").otherwise("Ver [x](/01-proyectos/p1/CONTEXT.md)\n"),
    )
    plain = F.concat(F.trim(F.regexp_replace(body, r"\r\n?", "\n"), F.lit(" \t\n\r\u000b\u000c")), F.lit("\n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value if not isinstance(value, str) else F.lit(value), F.lit("\n"))
    own = (
        F.when(kind == "Iniciativa", F.concat(line("proyecto", F.concat(F.lit("p"), F.when(at("V27"), F.lit("1")).otherwise(n.cast("string")))), line("origen", "objetivo-equipo"), line("periodo", F.when(at("V21"), "Q1-2026").otherwise("2026-Q1")), line("estado", "iniciando")))
        .when(kind == "Persona", F.concat(line("rol", "analista"), F.when(at("V11"), line("reports_to", "/01-proyectos/p1/CONTEXT.md")).otherwise(F.lit(""))))
        .when(kind == "Pregunta", F.concat(line("proyecto", F.concat(F.lit("p"), project)), line("estado", "respondida"), line("bloqueante", "false"), line("created", "2026-01-02")))
        .otherwise(F.concat(
            line("proyecto", F.when(at("V20"), "nadie").otherwise(F.concat(F.lit("p"), project))), line("estado", "aceptada"), line("fecha", F.when(at("V6"), "ayer").otherwise("2026-01-02")),
            line("decisores", F.when(at("V17"), "[el comité]").otherwise(F.concat(F.lit("[/02-areas/personas/d"), (50 + n % 50).cast("string"), F.lit(".md]")))),
            F.when(at("V24"), F.lit("valido_desde: 2026-02-01\nvalido_hasta: 2026-01-01\n")).when(at("V8"), F.lit("raro: sí\n")).otherwise(F.lit("")),
        ))
    )
    front = F.concat(
        F.when(at("V2"), F.lit("")).otherwise(line("type", kind)), line("title", F.concat(F.lit("Documento "), n.cast("string"))), line("description", F.when(at("V18"), "una: dos").otherwise("una descripción")), F.lit("tags: [a, b]\n"),
        line("classification", F.when(at("V16"), "public").when(kind == "Persona", "confidential").otherwise("internal")), F.lit("generated: {by: human:ana, at: 2026-01-01T00:00:00Z}\n"), F.when(at("V5"), F.lit("")).otherwise(F.lit("resumen: algo\n")),
        line("resumen_hash", F.when(at("V23"), "otro").otherwise(F.sha2(plain, 256))), line("procedencia", F.when(at("V25"), "fuente").otherwise("manual")), F.when(at("V15"), F.lit("status: stable\nstale_after: 2026-01-01T00:00:00Z\n")).otherwise(F.lit("")), own,
    )
    text = F.concat(F.lit("---\n"), front, F.when(at("V1"), F.lit("")).otherwise(F.lit("---\n")), F.lit("\n"), body)
    return docs.select(path.alias("path"), text.cast("binary").alias("content"))


def bundle(spark: SparkSession, sf_dir: str) -> Bundle:
    return Bundle(files(spark, sf_dir))
