"""Exact Jaccard self-join of documents on word n-grams, and the groups that its links form.

Prefix filtering after Xiao et al. (PPJoin+, 2008): two sets can only reach the threshold if they share one of their
rarest n-grams, so each set is listed under a short prefix of them alone.

* Rare first. The order is by a count sketch of all documents, ties by hash. The sketch has a fixed size (`SLOTS` counters, so
  a fixed broadcast); its errors change only how short the lists are, never what is found, as any order that all
  documents share gives whole results.
* Length and position filters drop pairs under a shared n-gram, the suffix filter drops pairs before they are compared: each class has
  a signature of at least `SIGN_BITS` bits and a bit for each of its n-grams, bit i the parity of how many of them fall to part i of the
  hash range. Two signatures of one width never differ in more bits than the sets differ in n-grams; the wider one is folded to the
  other's width. So a pair of long sets that have little in common goes without its sets being sent anywhere.
* Each remaining pair is compared once, on its whole sets: first those with the first class of a list, then those whose classes
  are not in one group by then.
* Equal sets are one class from the start, so copies never meet as pairs. In a list of over `LIST_LIMIT` classes, first each
  class meets the one nearest to what most signatures of its block and length band have; then, while groups still join, the nearest
  class of another group; at last all classes of other groups that the filters leave. Lists are dealt in blocks of `BLOCK`.
  So a large group of near copies costs in proportion to its size, and no link that would join two groups is lost.
* A class is known by 64 bits of its set's digest. Where two sets share them, which the 64 bits after those tell, all steps know both by the
  latter, so that classes are as distinct as 128 bits make them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, saved, shingle_sets, steps
from .graph import components

SLOTS, SIGN_BITS = 1 << 20, 512
#: Bits of a signature in the lists, at most; wider ones are asked after them.
LIST_BITS = 4096
#: Classes that a task remembers in order not to describe them twice; after so many it begins anew.
SEEN = 200_000
#: Lists up to this length give all their pairs at once.
LIST_LIMIT = 24
#: Postings for each bucket of the join, and classes in a block of a long list. An n-gram of over BUCKET classes by the sketch is long
#: before its list is gathered: its postings are dealt by class.
BUCKET, BLOCK = 100_000, 2_000
#: Pairs, and bytes of text, that one numpy step works on: workers have little memory.
PAIRS, TEXT_BYTES = 100_000, 500_000
#: Pairs of whole sets that a task compares, at least where there are many.
PAIRS_IN_TASK = 2_000
#: Rounds of meeting the nearest class of another group, at most.
NEAREST_ROUNDS = 3
#: Bits of the map that says which classes take part in a comparison: at least, and at most (32 MB, broadcast). Other classes' sets that
#: a full map lets through are dropped by the join.
MAP_BITS, MOST_MAP_BITS = 1 << 24, 1 << 28


def _digest(sorted_set: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(sorted_set.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _key(sorted_set: np.ndarray, shared: frozenset[int]) -> int:
    """The class of a set; shared: the first halves that several sets have."""
    first, second = _digest(sorted_set)
    return second if first in shared else first


class _Seen:
    """Tells which classes are new, of the last SEEN at least."""

    def __init__(self):
        self.held: set[int] = set()

    def new(self, c: int) -> bool:
        if c in self.held:
            return False
        if len(self.held) >= SEEN:
            self.held.clear()
        self.held.add(c)
        return True


def _least_common(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """The overlap that sets of n and m need: den * o >= num * (n + m - o)."""
    return -(-(num * (n + m)) // (den + num))


# ---------------------------------------------------------------- the sketch

def _pack(counts: np.ndarray) -> bytes:
    full = np.flatnonzero(counts)
    if len(full) * 6 < len(counts) * 4:
        return b"s" + full.astype(np.uint16).tobytes() + counts[full].astype(np.uint32).tobytes()
    return b"d" + counts.astype(np.uint32).tobytes()


def _unpack(blob: bytes, into: np.ndarray) -> None:
    if blob[:1] == b"d":
        into += np.frombuffer(blob, np.uint32, offset=1)
    else:
        n = (len(blob) - 1) // 6
        into[np.frombuffer(blob, np.uint16, n, 1)] += np.frombuffer(blob[1 + 2 * n :], np.uint32, n)


SEGMENTS = SLOTS >> 16


_LISTS = pa.list_(pa.int64())


def _words_column(rows: list[np.ndarray | None]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([0 if r is None else len(r) for r in rows])])
    flat = [r for r in rows if r is not None and len(r)]
    values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values), mask=pa.array([r is None for r in rows]))


def _describe(text: str, key: str, k: int) -> Callable:
    names = [key, "n", "cid", "chk", "sign", "wide", "seg", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            for i, j, data, at in steps(batch.column(batch.schema.get_field_index(text)), TEXT_BYTES):
                n, cid, chk, new, sign, wide = [], [], [], [], [], []
                for u in shingle_sets(data, at, k):
                    n.append(len(u))
                    c, x = _digest(u) if len(u) else (None, None)
                    cid.append(c)
                    chk.append(x)
                    full = _sign(u)
                    sign.append(_folded(full, min(len(full), LIST_BITS // 64)))
                    wide.append(full if len(full) > LIST_BITS // 64 else None)
                    if c is not None and seen.new(c):
                        new.append(u)
                if new:
                    counts += np.bincount((np.concatenate(new) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
                m = j - i
                yield pa.RecordBatch.from_arrays([keys.slice(i, m), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(chk, pa.int64()), _words_column(sign), _words_column(wide), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        for s in range(SEGMENTS):
            part = counts[s << 16 : (s + 1) << 16]
            if part.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (keys.type, *[pa.int64()] * 3, _LISTS, _LISTS)), pa.array([s], pa.int32()), pa.array([_pack(part)], pa.binary())], names=names)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One blob for each segment; holds the sketch and a batch."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            _unpack(blob.as_buffer().to_pybytes(), sums.setdefault(s, np.zeros(1 << 16, np.uint32)))
    for s, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_pack(x)], pa.binary())], names=["seg", "blob"])


def _sketch(described: DataFrame) -> np.ndarray:
    """The summed sketch on the driver: SLOTS counters, whatever the input."""
    rows = described.filter("seg is not null").select("seg", "blob").mapInArrow(_added, "seg int, blob binary")
    out = np.zeros(SLOTS, np.uint32)
    for r in rows.repartition(SEGMENTS, "seg").mapInArrow(_added, "seg int, blob binary").collect():
        _unpack(bytes(r.blob), out[r.seg << 16 : (r.seg + 1) << 16])
    return out


# ---------------------------------------------------------------- postings

_POSTING = np.dtype([("h", np.uint64), ("cid", np.int64), ("n", np.uint32), ("pos", np.uint32)])


def _sign(u: np.ndarray) -> np.ndarray:
    """As many bits as the set has n-grams, a power of two, SIGN_BITS at least."""
    bits = max(SIGN_BITS, 1 << (len(u) - 1).bit_length()) if len(u) else SIGN_BITS
    part = np.bincount(((u >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((part & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(sign: np.ndarray, size: int) -> np.ndarray:
    """The signature (or a row for each) in `size` words: parts that fall together have the parity of their sum."""
    while sign.shape[-1] > size:
        half = sign.shape[-1] // 2
        sign = sign[..., :half] ^ sign[..., half:]
    return sign


def _list_prefixes(text: str, k: int, num: int, den: int, sketch, buckets: int, shared: frozenset[int]) -> Callable:
    """Rows (bucket, blob): postings, those of hot n-grams dealt by class in as many more buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        hot = BUCKET + 2 * counts.mean()  # as the sketch adds other n-grams to each
        seen = _Seen()
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            p = np.concatenate(held)
            by_class = mix(p["cid"].view(np.uint64)) % np.uint64(buckets) + np.uint64(buckets)
            b = np.where(counts[(p["h"] & np.uint64(SLOTS - 1)).astype(np.int64)] > hot, by_class, (p["h"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            p, b = p[order], b[order]
            cut = np.flatnonzero(np.diff(b)) + 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(b[np.concatenate([[0], cut])], pa.int32()), pa.array([x.tobytes() for x in np.split(p, cut)], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for _, _, data, at in steps(batch.column(batch.schema.get_field_index(text)), TEXT_BYTES):
                for u in shingle_sets(data, at, k):
                    if not len(u) or not seen.new(c := _key(u, shared)):
                        continue
                    n = len(u)
                    p = np.zeros(n - -(-num * n // den) + 1, _POSTING)
                    often = counts[(u & np.uint64(SLOTS - 1)).astype(np.int64)]
                    if len(p) * 4 < n:  # u is sorted, so equal counts stay in the order of the hashes
                        most = np.partition(often, len(p) - 1)[len(p) - 1]
                        few = np.flatnonzero(often <= most)
                        p["h"] = u[few[np.argsort(often[few], kind="stable")[: len(p)]]]
                    else:
                        p["h"] = u[np.argsort(often, kind="stable")[: len(p)]]
                    p["cid"], p["n"], p["pos"] = c, n, np.arange(len(p))
                    held.append(p)
                if held and sum(map(len, held)) > 200_000:
                    yield out()
        if held:
            yield out()

    return run


def _survivors(p: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of postings i, j under one n-gram that length and position leave."""
    n, m = p["n"][i].astype(np.int64), p["n"][j].astype(np.int64)
    ok = np.minimum(n, m) * den >= np.maximum(n, m) * num
    i, j, n, m = i[ok], j[ok], n[ok], m[ok]
    need = _least_common(n, m, num, den)
    # the n-gram at these positions need not be the first that both share, so those before it may be common too
    a, b = p["pos"][i].astype(np.int64), p["pos"][j].astype(np.int64)
    ok = np.minimum(a, b) + 1 + np.minimum(n - a - 1, m - b - 1) >= need
    return i[ok], j[ok]


def _pairs_frame(p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = p["cid"][i], p["cid"][j]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """Each pair once, of its rows (a, b, later) that with the smallest third."""
    pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate([[True], (pairs[1:, 0] != pairs[:-1, 0]) | (pairs[1:, 1] != pairs[:-1, 1])])] if len(pairs) else pairs


_CANDIDATES = "a long, b long, lead boolean, h long, cid long, n int, pos int"


def _first_pairs(num: int, den: int, buckets: int) -> Callable:
    """The pairs of short lists, `lead` if with the list's first class, and the rows of long ones; of hot n-grams (buckets from `buckets` on) rows alone."""

    def run(bucket: tuple, group: pa.Table) -> pa.Table:
        limit = LIST_LIMIT if bucket[0].as_py() < buckets else 0
        p = np.concatenate([np.frombuffer(x.as_buffer(), _POSTING) for x in group["blob"]])
        p = p[np.lexsort((p["cid"], p["h"]))]
        keep = np.ones(len(p), bool)
        keep[1:] = (p["h"][1:] != p["h"][:-1]) | (p["cid"][1:] != p["cid"][:-1])
        p = p[keep]
        first = np.flatnonzero(np.concatenate([[True], p["h"][1:] != p["h"][:-1]]))
        size = np.diff(np.concatenate([first, [len(p)]]))
        pairs = np.zeros((0, 3), np.int64)
        held, rows = [pairs], 0
        for m in range(2, limit + 1):
            at = first[size == m]
            if len(at):
                x, y = np.triu_indices(m, 1)
                for part in np.array_split(at, -(-len(at) * len(x) // PAIRS)):
                    i, j = _survivors(p, (part[:, None] + x).ravel(), (part[:, None] + y).ravel(), num, den)
                    held.append(np.column_stack([_pairs_frame(p, i, j), (i > 0) & (p["h"][i] == p["h"][i - 1])]))  # 0 if i begins its list
                    rows += len(i)
                    if rows > len(pairs) + 5 * PAIRS:  # copies meet in many lists
                        pairs = _distinct(np.concatenate([pairs, *held]))
                        held, rows = [], 0
        long = [np.arange(f, f + m) for f, m in zip(first[size > limit], size[size > limit], strict=True)]
        pairs = _distinct(np.concatenate([pairs, *held]))
        rest = p[np.concatenate(long)] if long else p[:0]
        none = pa.nulls
        ends = lambda x: pa.chunked_array([pa.array(x, pa.int64()), none(len(rest), pa.int64())])
        tail = lambda x, kind: pa.chunked_array([none(len(pairs), kind), pa.array(x, kind)])
        lead = pa.chunked_array([pa.array(pairs[:, 2] == 0), none(len(rest), pa.bool_())])
        out = [ends(pairs[:, 0]), ends(pairs[:, 1]), lead, tail(rest["h"].astype(np.int64), pa.int64()), tail(rest["cid"], pa.int64()), tail(rest["n"].astype(np.int32), pa.int32()), tail(rest["pos"].astype(np.int32), pa.int32())]
        return pa.Table.from_arrays(out, names=["a", "b", "lead", "h", "cid", "n", "pos"])

    return run


def _block(group: pa.Table) -> tuple[pa.Table, np.ndarray, list[np.ndarray]]:
    group = group.sort_by("cid").combine_chunks()
    p = np.zeros(len(group), _POSTING)
    p["cid"], p["n"], p["pos"] = group["cid"], group["n"], group["pos"]
    sign = group["sign"].combine_chunks()
    at, flat = sign.offsets.to_numpy(), sign.values.to_numpy().view(np.uint64)
    return group, p, [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _near(p: np.ndarray, sign: list[np.ndarray], i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that all filters leave, and in how many bits of a thousand their signatures differ."""
    i, j = _survivors(p, i, j, num, den)
    n, m = p["n"][i].astype(np.int64), p["n"][j].astype(np.int64)
    size = np.array([len(s) for s in sign])
    narrow, apart = np.minimum(size[i], size[j]), np.zeros(len(i), np.int64)
    for w in np.unique(narrow).tolist():
        rows = np.flatnonzero(size >= w)
        at = np.zeros(len(sign), np.int64)
        at[rows] = np.arange(len(rows))
        folded = np.stack([_folded(sign[r], w) for r in rows.tolist()])
        pick = np.flatnonzero(narrow == w)
        for part in np.array_split(pick, -(-len(pick) * w // (8 * PAIRS))):
            apart[part] = np.bitwise_count(folded[at[i[part]]] ^ folded[at[j[part]]]).sum(1, dtype=np.int64)
    ok = apart <= n + m - 2 * _least_common(n, m, num, den)
    return i[ok], j[ok], apart[ok] * 1000 // (64 * narrow[ok])


def _as_table(found: list[np.ndarray]) -> pa.Table:
    both = np.concatenate([np.zeros((0, 2), np.int64), *found])
    pairs = _distinct(np.column_stack([both, np.zeros(len(both), np.int64)]))
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _central_pairs(num: int, den: int) -> Callable:
    """Each class of a block with the central one of its length band, and of the band below."""
    step = log(den / num)

    def run(group: pa.Table) -> pa.Table:
        _, p, sign = _block(group)
        bits = np.unpackbits(np.stack([_folded(s, SIGN_BITS // 64) for s in sign]).view(np.uint8), axis=1, bitorder="little")
        band = (np.log(p["n"]) / step).astype(np.int64)
        found = []
        for b in np.unique(band).tolist():
            own = np.flatnonzero(band == b)
            most = bits[own].mean(0) > 0.5
            lead = own[(bits[own] != most).sum(1).argmin()]
            other = np.flatnonzero((band == b) | (band == b + 1))
            other = other[other != lead]
            i, j, _ = _near(p, sign, np.full(len(other), lead), other, num, den)
            found.append(_pairs_frame(p, i, j))
        return _as_table(found)

    return run


def _cross_pairs(num: int, den: int, nearest: bool) -> Callable:
    """Pairs of classes from different groups in two blocks of a list (side -1 and 1) or in one (0): of each class of the first with
    its nearest only, or all that the filters leave."""

    def run(group: pa.Table) -> pa.Table:
        group, p, sign = _block(group)
        side, comp = group["side"].to_numpy(), group["comp"].to_numpy()
        found = []
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        for part in np.array_split(left, max(1, -(-len(left) * len(right) // PAIRS))):
            x, y = np.nonzero(comp[part][:, None] != comp[right][None, :])
            i, j = part[x], right[y]
            ok = (side[i] != 0) | (i < j)
            i, j, apart = _near(p, sign, i[ok], j[ok], num, den)
            if nearest and len(i):
                order = np.lexsort((j, apart, i))
                i, j = i[order], j[order]
                first = np.concatenate([[True], i[1:] != i[:-1]])
                i, j = i[first], j[first]
            found.append(_pairs_frame(p, i, j))
        return _as_table(found)

    return run


# ---------------------------------------------------------------- comparison

def _sets_of(text: str, k: int, wanted, shared: frozenset[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        last = len(bits) * 8 - 1
        seen = _Seen()
        for batch in batches:
            for _, _, data, at in steps(batch.column(batch.schema.get_field_index(text)), TEXT_BYTES):
                cid, blob = [], []
                for u in shingle_sets(data, at, k):
                    if len(u) and bits[(s := (c := _key(u, shared)) & last) >> 3] >> (s & 7) & 1 and seen.new(c):
                        cid.append(c)
                        blob.append(u.tobytes())
                if cid:
                    yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(blob, pa.binary())], names=["cid", "blob"])

    return run


def _linked(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            x, y = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                a, b = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(docs: DataFrame, pairs: DataFrame, text: str, k: int, num: int, den: int, shared: frozenset[int]) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold on their whole sets."""
    sc = docs.sparkSession.sparkContext
    n = pairs.count()
    size = min(MOST_MAP_BITS, max(MAP_BITS, 1 << (32 * n).bit_length()))
    slot = F.col("c").bitwiseAND(F.lit(size - 1))
    used = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy(F.shiftright(slot, 15).alias("s")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("m"))
    bits = bytearray(size >> 3)
    for r in used.collect():  # at most the map itself
        bits[r.s << 12 : (r.s + 1) << 12] = r.m
    sets = docs.select(text).mapInArrow(_sets_of(text, k, sc.broadcast(bytes(bits)), shared), "cid long, blob binary").dropDuplicates(["cid"])
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("blob").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("blob").alias("y")), "b")
    found = both.select("a", "b", "x", "y").mapInArrow(_linked(num, den), "a long, b long")
    return saved(found.coalesce(max(12, n // PAIRS_IN_TASK)), "links")  # no more files than the pairs need


def _described(docs: DataFrame, text: str, key: str, k: int) -> tuple[DataFrame, DataFrame, frozenset[int], np.ndarray]:
    """Rows (key, n, cid), classes (cid, n, least key, sign, wide), the first halves of digests that sets share, the sketch."""
    types = [("n", T.LongType()), ("cid", T.LongType()), ("chk", T.LongType()), ("sign", T.ArrayType(T.LongType())), ("wide", T.ArrayType(T.LongType())), ("seg", T.IntegerType()), ("blob", T.BinaryType())]
    described = saved(docs.mapInArrow(_describe(text, key, k), T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(*t) for t in types)])), "sets")
    rows = described.filter("seg is null")
    twice = rows.filter("cid is not null").groupBy("cid").agg(F.min("chk").alias("lo"), F.max("chk").alias("hi")).filter("lo <> hi").select("cid")
    shared = frozenset(r.cid for r in twice.collect())  # of n classes n * n / 2**65 are expected: 3 of ten billion
    if shared:
        rows = rows.withColumn("cid", F.when(F.col("cid").isin(*shared), F.col("chk")).otherwise(F.col("cid")))
    classes = rows.filter("cid is not null").groupBy("cid").agg(F.min(key).alias("least"), F.first("n").alias("n"), F.first("sign").alias("sign"), F.first("wide").alias("wide"))
    return rows.select(key, "n", "cid"), saved(classes, "classes"), shared, _sketch(described)


def jaccard_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each row of docs: key, n_shingles, cid (class of equal sets), component_id.

    Rows link when den * |A & B| >= num * |A | B| for their sets of k-word shingles (lower-case words between white
    space; fewer than k words give one shingle of them all). component_id is the smallest key that a row reaches by links,
    itself included; nulls among keys are passed over. Null or wordless text has no shingle, links with nothing and has a
    null cid. Repeated rows and ties stay as they are, an empty table gives none, other columns of docs are not used.
    The key is of any type that can be ordered.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold is a share above 0, at most 1")
    sc = docs.sparkSession.sparkContext
    docs = docs.select(key, text)
    rows, classes, shared, sketch = _described(docs, text, key, k)
    listed = classes.agg(F.sum(F.col("n") * (1 - num / den) + 1)).first()[0] or 0
    buckets = max(16, ceil(listed / BUCKET))
    postings = docs.select(text).mapInArrow(_list_prefixes(text, k, num, den, sc.broadcast(sketch), buckets, shared), "bucket int, blob binary")
    found = saved(postings.groupBy("bucket").applyInArrow(_first_pairs(num, den, buckets), _CANDIDATES), "candidates")
    pairs = saved(_suffix_filtered(found.filter("a is not null").groupBy("a", "b").agg(F.max("lead").alias("lead")), classes, num, den), "pairs")
    done, other = pairs.filter("lead").select("a", "b"), pairs.filter("not lead").select("a", "b")
    long = found.filter("h is not null").select("h", "cid", "n", "pos")
    any_long = not long.isEmpty()
    if any_long:
        sizes = saved(long.groupBy("h").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("m")).filter("m > 1").drop("m"), "sizes")
        long = long.join(classes.select("cid", "sign"), "cid").join(sizes, "h").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        long = saved(long, "lists")
        central = long.groupBy("h", "own").applyInArrow(_central_pairs(num, den), "a long, b long").distinct()
        done = saved(done.unionByName(_suffix_filtered(central, classes, num, den)).distinct(), "pairs")
    links = _verify(docs, done, text, k, num, den, shared)
    roots, rounds, first = components(links), 0 if any_long else NEAREST_ROUNDS, True
    while rounds <= NEAREST_ROUNDS:  # the last one leaves nothing out
        parts = [_apart(other, roots)] * first
        if any_long:
            parts.append(_suffix_filtered(_between(long, roots, num, den, nearest=rounds < NEAREST_ROUNDS), classes, num, den))
        tried, first = saved(reduce(DataFrame.unionByName, parts).distinct(), "pairs"), False
        more = saved(tried.join(done, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():  # of each class the nearest are all known; the last round looks beyond them
            rounds = max(rounds + 1, NEAREST_ROUNDS)
            continue
        new = _verify(docs, more, text, k, num, den, shared)
        done = done.unionByName(more)
        if new.isEmpty():
            rounds = max(rounds + 1, NEAREST_ROUNDS)
        else:
            links, rounds = links.unionByName(new), rounds + 1
            roots = components(links)
    # the smallest keys are added up before they are dealt, and written: both sides of the joins with them can be split
    own = classes.select("cid", "least").join(roots.withColumnRenamed("v", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    reached = saved(own.groupBy("root").agg(F.min("least").alias("component_id")), "reached")
    named = saved(own.join(reached, "root").select("cid", "component_id"), "named")
    # a row without a set is its own group: no class to look up
    alone = rows.filter("cid is null").select(key, F.col("n").alias("n_shingles"), "cid", F.col(key).alias("component_id"))
    return rows.filter("cid is not null").join(named, "cid").select(key, F.col("n").alias("n_shingles"), "cid", "component_id").unionByName(alone)


def _suffix_filtered(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose signatures, at the narrower one's width, differ in no more bits than their sets may."""
    x, y = (classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.coalesce("wide", "sign").alias(f"s{c}")) for c in "ab")
    width = F.least(F.size("sa"), F.size("sb"))

    def part(sign: str, i):
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(sign) / width).cast("int") - 1), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(F.col(sign), i + j * width)))

    differ = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
    places = F.sequence(F.lit(0), width - 1)
    alike = differ(F.col("sa"), F.col("sb"))
    folded = differ(F.transform(places, lambda i: part("sa", i)), F.transform(places, lambda i: part("sb", i)))
    apart = F.when(F.size("sa") == F.size("sb"), alike).otherwise(folded)
    need = F.expr(f"({num} * (na + nb) + {den + num - 1}) div {den + num}")
    return pairs.join(x, "a").join(y, "b").filter(apart <= F.col("na") + F.col("nb") - 2 * need).select(*pairs.columns)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different groups yet."""
    x, y = (roots.select(F.col("v").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _between(long: DataFrame, roots: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Pairs of classes that share a long list and are in different groups yet."""
    long = long.join(roots.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")
    still = long.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h")
    dealt = long.join(saved(still, "lists"), "h").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("side", F.signum(F.col("own") - F.col("other")).cast("int"))
    dealt = dealt.select("h", "cid", "n", "pos", "sign", "comp", "side", F.least("own", "other").alias("s1"), F.greatest("own", "other").alias("s2"))
    return dealt.groupBy("h", "s1", "s2").applyInArrow(_cross_pairs(num, den, nearest), "a long, b long").distinct()
