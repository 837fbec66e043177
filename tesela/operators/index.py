"""A stored inverted index, kept up to date by document, for the query language and ranking of `search`.

postings: segment, initial, term, path, field, places (positions in the field), length (of the document). They lie in folders by segment and the
term's first letter and are sorted by term, so a query reads the row groups of its terms alone, a prefix a range of them. documents: segment, path,
length and columns that results show, sorted by path.

A change adds a segment with the new documents; what it replaces or drops is named in `dead` (path, segment), and passed over by readers until
`compacted` writes all anew. META, replaced by one renaming, names the segments that are valid with the counts that ranking needs.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..scratch import read_text, replace_text
from .search import COLUMNS, Term, parse, relevance

_POSTINGS = "segment string, initial string, term string, path string, field int, places array<int>, length int"


def _initial(term: Column) -> Column:
    return F.when(F.substring(term, 1, 1).rlike("[a-z0-9]"), F.substring(term, 1, 1)).otherwise("_")


def _letter(word: str) -> str:
    return word[0] if word[0].isascii() and word[0].isalnum() else "_"


class Index:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------ state

    def meta(self) -> dict:
        found = read_text(self.spark, f"{self.root}/META")
        if found is None:
            raise LookupError("no index yet")
        return json.loads(found)

    def exists(self) -> bool:
        return read_text(self.spark, f"{self.root}/META") is not None

    def _put(self, meta: dict) -> None:
        replace_text(self.spark, f"{self.root}/META", json.dumps(meta))

    # ------------------------------------------------ writing

    def _written(self, docs: DataFrame, keep: list[str]) -> str:
        """A segment with the documents (path, COLUMNS and the kept columns)."""
        name = f"s-{uuid.uuid4().hex}"
        arrays = docs.select("path", *(tokens(F.col(c)).alias(f"__{c}") for c in COLUMNS), *keep)
        length = sum((F.size(f"__{c}") for c in COLUMNS), F.lit(0)).alias("length")
        fields = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.col(f"__{c}").alias("words")) for i, c in enumerate(COLUMNS)))).alias("f")
        places = arrays.select("path", length, fields).select("path", "length", "f.field", F.posexplode("f.words").alias("at", "term"))
        # a document's words are in one partition, so they are put together before they are dealt
        postings = places.groupBy("term", "path", "field", "length").agg(F.array_sort(F.collect_list("at")).alias("places")).withColumn("initial", _initial(F.col("term")))
        postings.select("initial", "term", "path", "field", "places", "length").repartitionByRange("initial", "term", "path").sortWithinPartitions("initial", "term").write.partitionBy("initial").parquet(f"{self.root}/postings/segment={name}")
        arrays.select("path", length, *keep).sort("path").write.parquet(f"{self.root}/documents/segment={name}")
        return name

    def build(self, docs: DataFrame, keep: list[str] | None = None) -> Index:
        """The index of all documents, in place of what was there. Null texts have no word; paths are taken to be one for each document."""
        keep = keep or []
        name = self._written(docs, keep)
        n, length = self._sizes(self._documents([name]))
        self._put({"segments": [name], "dead": None, "n_docs": n, "length": length, "keep": keep})
        return self

    def _documents(self, segments: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.root}/documents/segment={s}").withColumn("segment", F.lit(s)) for s in segments))

    @staticmethod
    def _sizes(documents: DataFrame) -> tuple[int, int]:
        r = documents.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        return r.n, r.length

    def _dead(self, meta: dict) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{meta['dead']}") if meta["dead"] else None

    def _alive(self, rows: DataFrame, meta: dict) -> DataFrame:
        dead = self._dead(meta)
        return rows if dead is None else rows.join(dead, ["path", "segment"], "left_anti")

    def change(self, docs: DataFrame, gone: DataFrame) -> Index:
        """Brings the index up to date: docs are new or changed documents, gone holds the paths that are no more."""
        meta = self.meta()
        name = self._written(docs, meta["keep"])
        came = self._documents([name])
        leave = came.select("path").unionByName(gone.select("path")).distinct()
        old = self._alive(self._documents(meta["segments"]), meta).join(leave, "path", "left_semi").select("path", "segment", "length")
        at = f"dead-{uuid.uuid4().hex}"
        before = self._dead(meta)
        rows = old.select("path", "segment")
        (rows if before is None else rows.unionByName(before)).write.parquet(f"{self.root}/{at}")
        (n, length), (out, less) = self._sizes(came), self._sizes(old)
        self._put(meta | {"segments": [*meta["segments"], name], "dead": at, "n_docs": meta["n_docs"] + n - out, "length": meta["length"] + length - less})
        return self

    def compacted(self) -> Index:
        """All living postings as one segment."""
        meta, name = self.meta(), f"s-{uuid.uuid4().hex}"
        rows = self._postings(meta).drop("segment")
        rows.repartitionByRange("initial", "term", "path").sortWithinPartitions("initial", "term").write.partitionBy("initial").parquet(f"{self.root}/postings/segment={name}")
        self.documents().drop("segment").sort("path").write.parquet(f"{self.root}/documents/segment={name}")
        self._put(meta | {"segments": [name], "dead": None})
        return self

    # ------------------------------------------------ reading

    def documents(self) -> DataFrame:
        meta = self.meta()
        return self._alive(self._documents(meta["segments"]), meta)

    def _postings(self, meta: dict) -> DataFrame:
        rows = self.spark.read.schema(_POSTINGS).parquet(f"{self.root}/postings").filter(F.col("segment").isin(*meta["segments"]))
        return self._alive(rows, meta)

    def postings(self) -> DataFrame:
        """term, path, field (its name), tf of all documents."""
        names = F.array(*map(F.lit, COLUMNS))
        return self._postings(self.meta()).select("term", "path", F.get(names, F.col("field")).alias("field"), F.size("places").cast("long").alias("tf"))

    def _word(self, rows: DataFrame, word: str, prefix: bool, column: str | None) -> DataFrame:
        rows = rows.filter((F.col("initial") == _letter(word)) & (F.col("term").startswith(word) if prefix else F.col("term") == word))
        return rows if column is None else rows.filter(F.col("field") == COLUMNS.index(column))

    def _found(self, rows: DataFrame, term: Term) -> DataFrame:
        """path, length and tf of the documents with a term."""
        last = len(term.words) - 1
        if not last:
            hits = self._word(rows, term.words[0], term.prefix, term.column)
            return hits.groupBy("path", "length").agg(F.sum(F.size("places")).alias("tf"))
        parts = [self._word(rows, w, term.prefix and i == last, term.column).select("path", "length", "field", F.explode("places").alias("at")).select("path", "length", "field", (F.col("at") - i).alias("start"), F.lit(i).alias("i")) for i, w in enumerate(term.words)]
        starts = reduce(DataFrame.unionByName, parts).groupBy("path", "length", "field", "start").agg(F.count_distinct("i").alias("n"))
        return starts.filter(F.col("n") == last + 1).groupBy("path", "length").agg(F.count("*").alias("tf"))

    def _counted(self, query: str) -> tuple[DataFrame, list[Term], Column]:
        """path, length, tf0.. of each document with any of the query's terms, and the condition that it matches."""
        groups, rows = parse(query), self._postings(self.meta())
        terms = list(dict.fromkeys(t for g in groups for t in g))
        found = reduce(DataFrame.unionByName, (self._found(rows, t).withColumn("i", F.lit(i)) for i, t in enumerate(terms)))
        counted = found.groupBy("path", "length").agg(*(F.coalesce(F.sum(F.when(F.col("i") == i, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i in range(len(terms))))
        holds = lambda t: (F.col(f"tf{terms.index(t)}") > 0) != F.lit(t.negated)
        return counted, terms, reduce(Column.__or__, (reduce(Column.__and__, map(holds, g)) for g in groups))

    def matching(self, query: str) -> DataFrame:
        """The paths of documents that match."""
        counted, _, match = self._counted(query)
        return counted.filter(match).select("path")

    def scored(self, query: str) -> DataFrame:
        """path and relevancia (below 0, less is better) of every document that matches."""
        counted, terms, match = self._counted(query)
        positive = [i for i, t in enumerate(terms) if not t.negated]
        meta, n = self.meta(), counted.agg(*(F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("long")), F.lit(0)).alias(f"n{i}") for i in positive)).first()
        mean = meta["length"] / meta["n_docs"] if meta["n_docs"] else 0.0
        return counted.filter(match).select("path", relevance({i: F.lit(n[f"n{i}"]) for i in positive}, F.lit(meta["n_docs"]), F.lit(mean)).alias("relevancia"))

    def ranked(self, query: str, limit: int = 10) -> DataFrame:
        """The best `limit` matches with the kept columns; ties by path."""
        best = self.scored(query).orderBy(F.round("relevancia", 9), "path").limit(limit)
        keep = self.meta()["keep"]
        if not keep:
            return best
        top = {r.path: r.relevancia for r in best.collect()}  # `limit` rows at most
        if not top:
            return best.join(self.documents().limit(0).select("path", *keep), "path")
        shown = self.documents().filter(F.col("path").isin(*top)).select("path", *keep)
        scores = self.spark.createDataFrame(list(top.items()), "path string, relevancia double")
        return shown.join(F.broadcast(scores), "path").orderBy(F.round("relevancia", 9), "path").select("path", "relevancia", *keep)
