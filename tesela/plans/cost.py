"""What it costs to read a corpus and to keep its derived files, in tokens (characters / 4): a scan that never fails, the model of costs with its verdict, and
a catalogue of types and fields."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.star import COLUMNS

#: Documents that an ingest touches, those that a query reads whole, and under how many documents the verdict is no measurement. Fixed values.
TOUCHED, READ, FEW = 4, 5, 200
_FIELD = re.compile(r"([A-Za-z_][\w.-]*)\s*:\s*(.*)")


def scanned(content: DataFrame) -> DataFrame:
    """path, chars, type (null where none can be told) and keys of every file (path, content), whatever is in it: front matter is taken line by line, and
    what is not understood passed over."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                text = bytes(data or b"").decode("utf-8", "replace")
                lines = text.split("\n")
                found: dict[str, str] = {}
                if lines[0].strip() == "---":
                    for line in lines[1:]:
                        if line.strip() == "---":
                            break
                        if m := _FIELD.match(line):
                            found.setdefault(m[1], m[2].strip().strip("\"'"))
                rows.append((path, len(text), found.get("type") or None, list(found)))
            yield pd.DataFrame(rows, columns=["path", "chars", "type", "keys"])

    return content.select("path", "content").mapInPandas(run, "path string, chars long, type string, keys array<string>")


def _folder(path: str):
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def model(docs: DataFrame) -> DataFrame:
    """One row of costs from (path, chars, line): line is how many characters a document has in its folder's index.

    derived: all tokens, written and read again; indexes: as much of an average index for each document an ingest touches; navigation: the top
    folder's index and an average one for each further level; reading: the largest documents whole. Upkeep is what an ingest costs, asking what a
    question costs; the verdict says which is over twice the other, where there are documents enough to tell."""
    t = docs.select("path", F.floor(F.col("chars") / 4).alias("t"), "line", _folder("path").alias("dir"))
    lists = t.groupBy("dir").agg(F.floor(F.sum("line") / 4).alias("index"))
    top = F.substring_index("dir", "/", 1)
    roots = lists.select(top.alias("top")).distinct()
    means = lists.agg(F.count("*").alias("folders"), F.sum("index").alias("all"))
    largest = t.orderBy(F.desc("t"), "path").limit(READ).agg(F.sum("t"))
    row = t.agg(F.count("*").alias("docs"), F.sum("t").alias("tokens"), F.max(F.size(F.split("path", "/"))).alias("depth"))
    row = row.select("docs", "tokens", "depth", means.select(F.col("all") / F.col("folders")).scalar().alias("index"), roots.agg(F.count("*")).scalar().alias("roots"), largest.scalar().alias("reading"))
    row = row.withColumn("derived", 2 * F.col("tokens")).withColumn("indexes", F.floor(2 * F.col("index") * TOUCHED))
    row = row.withColumn("navigation", F.floor(F.col("roots") * 8 + F.col("index") * F.greatest(F.col("depth") - 1, F.lit(1))))
    row = row.withColumn("upkeep", F.col("derived") + F.col("indexes")).withColumn("asking", F.col("navigation") + F.col("reading"))
    verdict = F.when(F.col("docs") < FEW, "unreliable").when(F.col("upkeep") > 2 * F.col("asking"), "upkeep").when(F.col("asking") > 2 * F.col("upkeep"), "asking").otherwise("comparable")
    return row.select("docs", "tokens", "depth", "derived", "indexes", "navigation", "reading", "upkeep", "asking", verdict.alias("verdict"))


def catalogue(scan: DataFrame) -> DataFrame:
    """type, field and how many documents of the type have it; documents without a type under -."""
    kind = F.coalesce("type", F.lit("-")).alias("type")
    return scan.select(kind, F.explode(F.array_distinct("keys")).alias("field")).groupBy("type", "field").agg(F.count("*").alias("n"))


def without_index(scan: DataFrame) -> DataFrame:
    """Folders that hold documents but no index."""
    rows = scan.filter(F.col("path").endswith(".md")).select(_folder("path").alias("dir"), F.col("path").rlike("(^|/)index\\.md$").alias("is"))
    return rows.groupBy("dir").agg(F.max("is").alias("has"), F.sum((~F.col("is")).cast("long")).alias("docs")).filter("not has and docs > 0").select("dir", "docs")


def filled(corpus) -> DataFrame:
    """type, field, documents and how many have a value, over the tables of types; one pass for each."""
    out = []
    for name, columns in COLUMNS.items():
        fields = [c for c in columns.split() if c != "doc"]
        if fields:
            one = corpus[name].agg(F.count("*").alias("docs"), *(F.count(c).alias(c) for c in fields))
            out.append(one.select(F.lit(name).alias("type"), "docs", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in fields))).alias("x")).select("type", "x.field", "docs", "x.n"))
    return reduce(DataFrame.unionByName, out)
