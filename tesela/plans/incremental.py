"""Projection by difference: what a new scan changes in the tables of the last one. Any sequence of these equals a projection of all."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import read_text, replace_text


def difference(old: DataFrame, new: DataFrame, key: str = "path", mark: str = "hash") -> DataFrame:
    """key and state (new, changed, same, gone) from two tables of keys and content hashes."""
    a, b = old.select(key, F.col(mark).alias("__old")), new.select(key, F.col(mark).alias("__new"))
    state = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "gone").when(F.col("__old") == F.col("__new"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def applied(old: DataFrame, fresh: DataFrame, states: DataFrame, doc: str = "doc", key: str = "path") -> DataFrame:
    """old without the rows of changed and gone documents, and the fresh rows of new and changed ones."""
    left = states.filter(F.col("state").isin("changed", "gone")).select(F.col(key).alias(doc))
    came = states.filter(F.col("state").isin("changed", "new")).select(F.col(key).alias(doc))
    return old.join(left, doc, "left_anti").select(*old.columns).unionByName(fresh.join(came, doc, "left_semi"))


class Snapshots:
    """Tables of a corpus under one folder, each set whole in a folder of its own; a pointer file names the one that is valid.

    A set is written beside the valid one and its constraints are checked before the pointer moves, so readers never see half of it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}" if name else self.root)

    def current(self) -> str | None:
        return read_text(self.spark, f"{self.root}/CURRENT")

    def table(self, name: str) -> DataFrame:
        if (at := self.current()) is None:
            raise LookupError("no projection yet")
        return self.spark.read.parquet(f"{self.root}/{at}/{name}")

    __getitem__ = table

    def publish(self, corpus, names: Iterable[str], full: bool = False) -> str:
        from .constraints import violations

        names, old, name = list(names), self.current(), f"v-{uuid.uuid4().hex}"
        # states are written first: all tables then follow one reading of the corpus
        head = corpus["documentos"]
        states = None if full or old is None else difference(self.table("documentos"), head)
        if states is not None:
            states.write.parquet(f"{self.root}/{name}/_states")
            states = self.spark.read.parquet(f"{self.root}/{name}/_states")
        for t in names:
            rows = corpus[t]
            if states is not None and t != "consultas":
                rows = applied(self.table(t), rows, states, "path" if t == "documentos" else "doc")
            rows.write.parquet(f"{self.root}/{name}/{t}")
        written = {t: self.spark.read.parquet(f"{self.root}/{name}/{t}") for t in names}
        if broken := violations(written).limit(5).collect():
            self._files(name).delete(self._path(name), True)
            raise ValueError(f"not published: {[tuple(r) for r in broken]}")
        replace_text(self.spark, f"{self.root}/CURRENT", name)
        return name

    def _files(self, name: str):
        return self._path(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def dropped(self, keep: int = 2) -> list[str]:
        """Deletes all sets but the valid one and the `keep - 1` before it (readers may still be at them); gives the names of those deleted."""
        fs, valid = self._files(""), self.current()
        found = sorted((s for s in fs.listStatus(self._path("")) if s.getPath().getName().startswith("v-")), key=lambda s: -s.getModificationTime())
        old = [s.getPath() for s in found if s.getPath().getName() != valid][max(0, keep - 1) :]
        for at in old:
            fs.delete(at, True)
        return [at.getName() for at in old]
