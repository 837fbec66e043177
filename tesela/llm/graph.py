"""Connected components of an edge table: forests of bounded chunks of edges, then alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import saved

#: Edges that a task makes a forest of at a time (16 bytes each).
CHUNK = 500_000


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex that it reaches) for the vertices that reach a smaller one."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, root = at[: len(u)], at[len(u) :], np.arange(len(names))
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            break
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a root hangs on a smaller one
        while (further := root[root] != root).any():
            root[further] = root[root[further]]
    below = np.flatnonzero(root != np.arange(len(root)))
    return names[below], names[root[below]]


def _forests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            u, v = _forest(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                if sum(len(x) for x, _ in held) >= size:
                    yield out()
        if held:
            yield out()

    return run


def _observed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges written and read again, and three numbers that tell whether they are others than before."""
    seen = Observation()
    out = saved(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40))).alias("s")), "edges")
    return out, tuple(seen.get[k] for k in "nxs")


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least v of each u.

    The least ones are added up before they are dealt, and written, so that the join's sides are both dealt for it alone and the
    edges of a vertex that very many have can be split among tasks.
    """
    return edges.join(saved(edges.groupBy("u").agg(F.min("v").alias("m")), "least"), "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of edges (a, b), both long: root is the smallest vertex that v reaches.

    Edges are first put as forests of at most CHUNK edges each; where there is one alone, it is the result. Otherwise the steps on
    the forests' edges go on until nothing changes, O(log n) times in practice; more than `rounds` raise. Nothing is gathered on
    the driver but three numbers of a step.
    """
    e, (n, *_) = _observed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    parts = -(-n // CHUNK)  # of the tables that are no longer than the edges: no more files than they need
    e, was = _observed((e.coalesce(1) if n <= CHUNK else e).mapInArrow(_forests(CHUNK), "u long, v long"))
    for _ in range(rounds):
        if n <= CHUNK:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).withColumn("m", F.least("u", "m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.filter("u <> v").distinct(), "edges")
        small = _with_least(large)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        e, now = _observed(small.filter("u <> v").distinct())
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return saved(e.unionByName(roots).select(F.col("u").alias("v"), F.col("v").alias("root")).coalesce(4 * max(1, parts)), "roots")
