"""A folder of Markdown documents as the tables of the corpus model.

The files are read by executors through Spark's own reader, and parsed once into one row for each document, which is written to the shared folder;
tables, lists and rules are projections of those rows by the contract. Spark's file sources leave out names that begin with _: those alone are
found by a walk over the listing, and read on the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.contract import EXEMPT, LOG_LINE, RESERVED, SCHEMA, Contract
from ..scratch import saved
from . import markdown

DOCUMENT = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("text", T.StringType()), T.StructField("has_front", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("error_line", T.IntegerType()), T.StructField("type", T.StringType()),
    T.StructField("meta", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("body", T.StringType()), T.StructField("body_hash", T.StringType()),
    T.StructField("lines", T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType())]))),
    T.StructField("hazards", T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("why", T.StringType()), T.StructField("breaks", T.BooleanType())]))),
])


def _text(v) -> str | None:
    return None if v is None else ("1" if v else "0") if isinstance(v, bool) else str(v)


def shaped(meta: dict, contract: Contract) -> dict:
    """The front matter in the shapes of the contract: a single entry counts as a list of one, a list where a map stands gives its first,
    true and false are 1 and 0; a list's entry that is no map has no members."""
    kind = meta.get("type") if isinstance(meta.get("type"), str) else ""
    out = {}
    for name, f in contract.fields(kind).items():
        v = meta.get(name)
        if f.kind == "list":
            v = [] if v is None else v if isinstance(v, list) else [v]
            out[name] = [{m: _text(x.get(m)) if isinstance(x, dict) else None for m, _ in f.members} for x in v] if f.of == "map" else [_text(x) if not isinstance(x, dict) else json.dumps(x) for x in v]
        elif f.kind == "map":
            v = v[0] if isinstance(v, list) and v else v
            out[name] = {m: _text(v.get(m)) if isinstance(v, dict) else None for m, _ in f.members}
        else:
            out[name] = _text(v) if not isinstance(v, (list, dict)) else json.dumps(v)
    return out


def _parser(contract: Contract):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                content = bytes(content)
                text = content.decode("utf-8", "replace")
                doc = markdown.parsed(text)
                kind = doc.meta.get("type")
                kind = kind if isinstance(kind, str) and kind.strip() else None
                kinds = {n: f.kind for n, f in contract.fields(kind or "").items()}
                found = [{"line": n + 1, "key": k, "why": w, "breaks": b} for n, k, w, b in markdown.hazards(doc.lines[1 : max(doc.body_start - 1, 1)], kinds)] if doc.has_front else []
                rows.append((path, hashlib.sha256(content).hexdigest(), text, doc.has_front, doc.error, doc.error_line, kind, json.dumps(shaped(doc.meta, contract), ensure_ascii=False), list(doc.meta), "\n".join(doc.lines[doc.body_start :]), markdown.body_hash(text), [{"line": n, "text": x} for n, x in doc.body], found))
            yield pd.DataFrame(rows, columns=DOCUMENT.names).astype({"error_line": "Int32"})

    return run


def _walk(spark: SparkSession, root: str) -> Iterator[str]:
    """Paths of all .md files below root, without those that have a part beginning with a dot."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    walk = fs.listFiles(top, True)
    while walk.hasNext():
        path = walk.next().getPath().toString().removeprefix(base)
        if path.endswith(".md") and not any(p.startswith(".") for p in path.split("/")):
            yield path


def listed(spark: SparkSession, root: str) -> list[str]:
    """Those paths in order."""
    return sorted(_walk(spark, root))


def _read_here(spark: SparkSession, full: str) -> bytes:
    path = spark._jvm.org.apache.hadoop.fs.Path(full)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and content of each document and generated schema file, read by executors; names with _, which Spark's readers drop, are read here."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    base = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    hidden = (p for p in _walk(spark, root) if p.rsplit("/", 1)[-1].startswith("_"))
    rows = spark.createDataFrame([(p, bytearray(_read_here(spark, base + p))) for p in hidden], "path string, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,json,sql}").load(root)
    after = F.lit(base.split(":", 1)[-1].lstrip("/"))  # a file comes back with its whole name, in one of several spellings of the scheme
    found = found.select(F.substring("path", F.instr("path", after) + F.char_length(after), F.char_length("path")).alias("path"), "content")
    return rows.unionByName(found.filter(~F.col("path").rlike(r"(^|/)\.") & (F.col("path").endswith(".md") | F.col("path").startswith(SCHEMA))))


class Bundle:
    """The model over documents given as rows (path, content)."""

    def __init__(self, content: DataFrame, contract: Contract | None = None):
        self.contract = contract or Contract()
        self.content = content.select("path", "content")

    @cached_property
    def parsed(self) -> DataFrame:
        """A row for each document, parsed in one pass and written: all tables and rules read these rows."""
        return saved(self.content.mapInPandas(_parser(self.contract), DOCUMENT), "parsed")

    @classmethod
    def at(cls, spark: SparkSession, root: str, contract: Contract | None = None) -> Bundle:
        return cls(files(spark, root), contract)

    @classmethod
    def of_texts(cls, spark: SparkSession, texts: dict[str, str], contract: Contract | None = None) -> Bundle:
        rows = [(p, bytearray(t.encode())) for p, t in texts.items()]
        return cls(spark.createDataFrame(rows, "path string, content binary"), contract)

    # ------------------------------------------------ which rows are what

    @staticmethod
    def name(path: Column) -> Column:
        return F.element_at(F.split(path, "/"), -1)

    @property
    def documents(self) -> DataFrame:
        """Rows that tables are made of: of a known type, not reserved, not exempt, readable."""
        return self.parsed.filter(F.col("has_front") & F.col("error").isNull() & F.col("type").isin(*self.contract.types) & ~self.name(F.col("path")).isin(*RESERVED, *EXEMPT) & F.col("path").endswith(".md") & ~F.col("path").startswith(SCHEMA))

    def _of(self, kind: str | None) -> DataFrame:
        rows = self.documents if kind is None else self.documents.filter(F.col("type") == kind)
        schema = self.contract.json_struct(kind or "")
        return rows.select("path", "hash", "body", F.from_json("meta", schema).alias("m"))

    @staticmethod
    def _kind(name: str, contract: Contract) -> str | None:
        return next((k for k in contract.types if k.lower() == name), None)

    # ------------------------------------------------ tables

    def table(self, name: str) -> DataFrame:
        if name == "consultas":
            return self.consultas
        head, _, tail = name.partition("_")
        kind = None if head == "documentos" else self._kind(head, self.contract)
        if head != "documentos" and kind is None:
            raise KeyError(name)
        rows = self._of(kind)
        if tail:
            f = self.contract.lists(kind)[tail]
            items = rows.select(F.col("path").alias("doc"), F.posexplode(f"m.{tail}").alias("idx", "v"))
            return items.select("doc", "idx", *(F.col(f"v.{m}").alias(m) for m, _ in f.members)) if f.of == "map" else items.select("doc", "idx", F.col("v").alias("value"))
        fields, out = self.contract.common if kind is None else self.contract.types[kind], []
        for column, (data, _) in self.contract.columns(kind).items():
            if column in ("path", "hash", "doc"):
                out.append(F.col("path" if column != "hash" else "hash").alias(column))
            else:
                source = next((f"{n}.{m}" for n, f in fields.items() if f.kind == "map" for m, _ in f.members if f"{n}_{m}" == column), None) or next(n for n in fields if n.lower().replace("-", "_") == column)
                out.append(F.col(f"m.{source}").cast(data).alias(column))
        return rows.select(*out)

    __getitem__ = table

    #: Bundles are searched in one pass.
    stored = None

    def texts(self, kind: str | None = None) -> list[tuple[DataFrame, dict]]:
        """key (the path), path and texts of documents; no column is known to be made of others."""
        rows = self.textos.filter(F.col("type") == kind) if kind else self.textos
        return [(rows.drop("type").withColumn("key", F.col("path")), {})]

    def fields(self, kind: str) -> DataFrame:
        """A type's table with `key`, its documents' path."""
        return self[kind.lower()].withColumn("key", F.col("doc"))

    @property
    def busqueda(self) -> DataFrame:
        return self.textos.drop("type")

    @property
    def textos(self) -> DataFrame:
        return self._of(None).select("path", F.col("m.type").alias("type"), F.col("m.title").alias("title"), F.col("m.description").alias("description"), F.col("m.resumen").alias("resumen"), F.col("body").alias("cuerpo"))

    @cached_property
    def consultas(self) -> DataFrame:
        """The query log: lines under a dated heading; those that have another shape, or stand before any date, are left out."""
        rows = self.parsed.filter(self.name(F.col("path")) == "log-consultas.md").select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("n", "line"))
        return query_log(rows.withColumn("linea", F.col("n") + 1))


def query_log(lines: DataFrame) -> DataFrame:
    """linea, fecha and counts from rows (path, linea, line): the heading's date holds for the lines below it."""
    from pyspark.sql.window import Window

    dated = F.when(F.col("line").rlike(r"^##\s+\d{4}-\d{2}-\d{2}\s*$"), F.regexp_extract("line", r"(\d{4}-\d{2}-\d{2})", 1))
    upto = Window.partitionBy("path").orderBy("linea").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("fecha", F.last(dated, ignorenulls=True).over(upto)).filter(F.col("line").rlike(LOG_LINE) & F.col("fecha").isNotNull())
    part = lambda i: F.regexp_extract("line", LOG_LINE, i)
    return rows.select("linea", "fecha", part(2).cast("int").alias("docs"), part(3).cast("int").alias("completos"), part(4).cast("int").alias("citados"), part(5).alias("modo"), (part(6) == "archivada").cast("int").alias("archivada"))
