"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007), and exact unigram scores beside them.

An n-gram seen c times has the quantised count q = 1 + floor(log2 c); the filter holds the pairs (n-gram, 1) to (n-gram, q).
Reading a count is a chain of membership probes that ends at the first pair that is missing, so an error can only raise
a count, with a chance that halves (or better) at each step. The filter holds words and pairs of words, with the marks of
begin and end.

Size. The filter is cut into segments by hash; each is built in one task from about `SEGMENT_TOKENS` tokens' n-grams, so
tasks stay alike at any size. A segment has as many bits as its counted n-grams need to leave it 30 % full, so the filter
grows with the corpus and holds every n-gram. It is broadcast in blocks of segments, of `BLOCK_BITS` (64 MB) or one segment at
most; a task has one block in memory at a time and reads the counts of `HOLD` words from each in turn before it scores them.

The exact counts never go to the driver or a broadcast as a whole: the `HEAD` most frequent words at most are broadcast;
the others of a text are joined with the table of counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, mix, saved, steps, words

BLOCK_BITS = 1 << 29
#: Words that a task gathers before it goes through the blocks, where there is more than one.
HOLD = 2_000_000
#: Bits to set for each bit of a segment: 30 % of its bits are set then, and an n-gram passes a level that it lacks with a chance of 9 %.
FULL = 0.35
SEGMENT_TOKENS, LEAST_SEGMENTS = 1_000_000, 64
PROBES = 2
HEAD = 1 << 19
#: Words gathered before a task passes on what it counted.
FLUSH = 1_500_000

BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_PAIR, _WORD = np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)
_LOW = np.uint64((1 << 48) - 1)


def _sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of BEGIN, the words and END for each row, offsets of the rows)."""
    h, w = words(data, at)
    n = len(at) - 1
    first = w[:-1] + 2 * np.arange(n)
    off = np.concatenate([first, [len(h) + 2 * n]])
    out = np.empty(len(h) + 2 * n, np.uint64)
    marks = np.zeros(len(out), bool)
    marks[first] = marks[off[1:] - 1] = True
    out[~marks] = h
    out[first], out[off[1:] - 1] = BEGIN, END
    return out, off


def _word_keys(h: np.ndarray) -> np.ndarray:
    return mix(h ^ _WORD)


def _pair_keys(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each word or END with the one before it; len(s) less one for each row."""
    keys = mix(s[:-1] * _PAIR + s[1:])
    return np.delete(keys, off[1:-1] - 1)


def _counted(text: str, held_out: str) -> Callable:
    """Rows (h, c): the words of the training rows, counted over parts of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for batch in batches:
            train = pa.array(~batch.column(batch.schema.get_field_index(held_out)).to_numpy(zero_copy_only=False))
            for _, _, data, at in steps(batch.column(batch.schema.get_field_index(text)).filter(train)):
                h, _ = words(data, at)
                held += [h, np.full(len(at) - 1, END)]
                if sum(map(len, held)) > FLUSH:
                    yield out()
        if held:
            yield out()

    return run


def _ngrams(text: str, held_out: str, segments: int) -> Callable:
    """Rows (segment, blob): n-gram keys and counts of a part of a partition, dealt by the top bits of the key."""
    shift = np.uint64(64 - int(log2(segments)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            k, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            s = (k >> shift).astype(np.int64)
            cut = np.searchsorted(s, np.arange(segments + 1))
            low = (k & _LOW).view(np.uint8).reshape(-1, 8)[:, :6]
            c = c.astype(np.uint32)
            full = np.flatnonzero(np.diff(cut))
            blobs = [low[cut[x] : cut[x + 1]].tobytes() + c[cut[x] : cut[x + 1]].tobytes() for x in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["segment", "blob"])

        for batch in batches:
            train = pa.array(~batch.column(batch.schema.get_field_index(held_out)).to_numpy(zero_copy_only=False))
            for _, _, data, at in steps(batch.column(batch.schema.get_field_index(text)).filter(train)):
                s, off = _sentences(data, at)
                held += [_word_keys(s), _pair_keys(s, off)]
                if sum(map(len, held)) > FLUSH:
                    yield out()
        if held:
            yield out()

    return run


def _positions(low: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    """bits: of the segment, or of each key's; under 2**32."""
    return (mix(low + np.uint64(level * 2 + probe << 48)) >> np.uint64(32)) * np.asarray(bits, np.uint64) >> np.uint64(32)


def _levels(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(c)).astype(np.int64)


def _built(least: int = 64) -> Callable:
    """Segments of as many bits as their n-grams need, and least at least, so all start at level 1."""

    def run(group: pa.Table) -> pa.Table:
        low, count = [], []
        for x in group["blob"]:
            b = x.as_buffer()
            n = b.size // 10
            k = np.zeros((n, 8), np.uint8)
            k[:, :6] = np.frombuffer(b, np.uint8, 6 * n).reshape(n, 6)
            low.append(k.view(np.uint64).ravel())
            count.append(np.frombuffer(b, np.uint8, offset=6 * n).view(np.uint32))
        keys, which = np.unique(np.concatenate(low), return_inverse=True)
        counts = np.bincount(which, np.concatenate(count))
        q = _levels(counts)
        above = np.cumsum(np.bincount(q)[::-1])[::-1]  # how many have a level
        pairs = np.cumsum(above[::-1])[::-1] * PROBES  # bits to set from a level on
        bits = max(least, 64 * ceil(pairs[1] / FULL / 64))
        have = np.zeros(bits, bool)
        for j in range(1, len(above)):
            k = keys[q >= j]
            for i in range(PROBES):
                have[_positions(k, j, i, bits).astype(np.int64)] = True
        return pa.table({"segment": group["segment"][:1], "start": pa.array([1], pa.int32()), "once": pa.array([int((counts == 1).sum())], pa.int64()), "bits": pa.array([np.packbits(have, bitorder="little").tobytes()], pa.binary())})

    return run


class Filter:
    """A block of the filter as workers hold it: one byte array, the bits of each segment (0 if in another block) and where they begin, and the first level of each."""

    def __init__(self, segments: int, bits: int | np.ndarray):
        self.segments, self.bits = segments, np.broadcast_to(np.asarray(bits, np.int64), segments)
        self.at = np.concatenate([[0], np.cumsum(self.bits)])
        self.start = np.ones(segments, np.int64)
        self.have = np.zeros(self.at[-1] >> 3, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The quantised counts; 0 for keys that are unseen or of another block's segments."""
        seg = (keys >> np.uint64(64 - int(log2(self.segments)))).astype(np.int64)
        low, level = keys & _LOW, np.zeros(len(keys), np.uint8)
        first = self.start[seg]
        alive = np.flatnonzero(self.bits[seg])
        for j in range(int(first.min(initial=1)), 64):
            if not len(alive):
                break
            late = first[alive] > j
            go = alive[~late]
            for i in range(PROBES):
                p = self.at[seg[go]] + _positions(low[go], j, i, self.bits[seg[go]]).astype(np.int64)
                go = go[(self.have[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)]
            level[go] = j
            alive = np.concatenate([go, alive[late]])
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return _middle(self.levels(keys))


def _middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that a quantised count stands for."""
    return np.where(level > 0, 1.5 * np.exp2(level - 1.0) - 0.5, 0.0)


def _blocks(bits: np.ndarray) -> list[tuple[int, int]]:
    """(first segment, segment after the last) of each block: BLOCK_BITS or one segment at most."""
    out, first, size = [], 0, 0
    for s, n in enumerate(bits.tolist()):
        if size + n > BLOCK_BITS and s > first:
            out.append((first, s))
            first, size = s, 0
        size += n
    return [*out, (first, len(bits))]


class _Held:
    """A step's rows until their n-grams' levels are known."""

    def __init__(self, data: np.ndarray, at: np.ndarray, *columns: pa.Array):
        s, self.off = _sentences(data, at)
        self.columns, self.size = columns, len(s)
        self.uniq, which = np.unique(s, return_inverse=True)
        self.pairs, pair_of = np.unique(_pair_keys(s, self.off), return_inverse=True)
        self.which, self.pair_of = which.astype(np.int32), pair_of.astype(np.int32)
        self.word_level, self.pair_level = np.zeros(len(self.uniq), np.uint8), np.zeros(len(self.pairs), np.uint8)

    def read(self, f: Filter) -> None:
        """Each key is in one block, and adds 0 in the others."""
        self.word_level += f.levels(_word_keys(self.uniq))
        self.pair_level += f.levels(self.pairs)


def _scored(text: str, key: str, held_out: str, filters: list, head, total: int, distinct: int, weight: float) -> Callable:
    room = float(total + distinct + 1)

    def scores(x: _Held, rid: int) -> pa.RecordBatch:
        common, common_c = head.value
        uniq, which, off = x.uniq, x.which, x.off
        n = len(off) - 1
        word, pair = _middle(x.word_level), _middle(x.pair_level)[x.pair_of]
        last, first = np.ones(x.size, bool), np.ones(x.size, bool)
        last[off[1:] - 1] = first[off[:-1]] = False  # before[t] precedes now[t]
        before, now = word[which[last]], word[which[first]]
        own = (now + 1) / room
        of_pair = np.where(before > 0, weight, 0.0)
        p = of_pair * np.minimum(pair, before) / np.maximum(before, 1.0) + (1 - of_pair) * own
        row = np.repeat(np.arange(n), np.diff(off) - 1)
        score = np.bincount(row, np.log10(p), n)
        # exact counts: those of the head here, the others later
        spot = np.minimum(np.searchsorted(common, uniq), max(0, len(common) - 1))
        known = common[spot] == uniq if len(common) else np.zeros(len(uniq), bool)
        c = np.where(known, common_c[spot] if len(common) else 0, 0)
        tok = which[first]
        n_head = np.bincount(row, known[tok], n).astype(np.int64)
        log_head = np.bincount(row, np.log10(c + 1.0)[tok], n)
        rare = np.flatnonzero(~known[tok])
        r_row, r_h = row[rare], uniq[tok[rare]].view(np.int64)
        cut = np.searchsorted(r_row, np.arange(n + 1))
        return pa.RecordBatch.from_arrays([
            pa.array(np.arange(rid, rid + n)), *x.columns, pa.array(np.diff(off) - 1), pa.array(n_head), pa.array(log_head), pa.array(score),
            pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(r_h)),
        ], names=["rid", key, held_out, "n_tokens", "n_head", "log_head", "score", "rare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        held: list[_Held] = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal rid
            for b in filters:
                f = b.value
                for x in held:
                    x.read(f)
                if len(filters) > 1:  # the next block takes its place
                    del f
                    b.__dict__.pop("_value", None)
            for x in held:
                yield scores(x, rid)
                rid += len(x.off) - 1
            held.clear()

        for batch in batches:
            keys, outs = (batch.column(batch.schema.get_field_index(c)) for c in (key, held_out))
            for i, j, data, at in steps(batch.column(batch.schema.get_field_index(text))):
                held.append(_Held(data, at, keys.slice(i, j - i), outs.slice(i, j - i)))
                if len(filters) == 1 or sum(x.size for x in held) > HOLD:
                    yield from out()
        if held:
            yield from out()

    return run


def lm_scores(docs: DataFrame, held_out, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a boolean Column of docs; the model learns from the rows where it is false. score: sum of log10 P(word | word
    before), END included, P(w | u) = r c(u, w) / c(u) + (1 - r) P(w), P(w) = (c(w) + 1) / (N + V + 1), with counts read
    from the filter. r is the chance that a pair has been seen before, by Good and Turing: 1 less the share of the training
    pairs that are seen once; 0 where c(u) is 0. base_score: exact unigrams. Null and empty text is END alone. Without training
    rows N = V = 0 and every P(w) is 1. Repeated rows each count; other columns are not used.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select(key, F.coalesce(held_out, F.lit(False)).alias("held_out"), text)
    counts = docs.select("held_out", text).mapInArrow(_counted(text, "held_out"), "h long, c long")
    vocab = saved(counts.groupBy("h").agg(F.sum("c").alias("c")), "words")
    spread = vocab.groupBy(F.floor(F.log2("c") * 4).alias("b")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()  # a few hundred rows
    total, distinct = sum(r.n for r in spread), sum(r.v for r in spread)
    taken, least = 0, None
    for r in sorted(spread, key=lambda r: -r.b):
        taken += r.v
        if taken > HEAD:
            break
        least = r.b
    head = vocab.filter(F.floor(F.log2("c") * 4) >= (2**31 if least is None else least)).toArrow()
    h, c = head["h"].to_numpy().view(np.uint64), head["c"].to_numpy()
    order = np.argsort(h)

    segments = max(LEAST_SEGMENTS, 1 << ceil(log2(max(1, total / SEGMENT_TOKENS))))
    parts = docs.select("held_out", text).mapInArrow(_ngrams(text, "held_out", segments), "segment int, blob binary")
    built = parts.groupBy("segment").applyInArrow(_built(), "segment int, start int, once long, bits binary")
    built = saved(built, "filter")
    bits = np.zeros(segments, np.int64)
    once = -vocab.filter("c = 1").count()  # the segments hold words and pairs
    for r in built.select("segment", "once", (F.length("bits") * 8).alias("n")).collect():  # a row for each segment
        bits[r.segment] = r.n
        once += r.once
    weight = min(1.0, max(0.0, 1 - once / total)) if total else 0.0
    filters = []
    for a, b in _blocks(bits):
        filt = Filter(segments, np.where((np.arange(segments) >= a) & (np.arange(segments) < b), bits, 0))
        for r in built.filter(F.col("segment").between(a, b - 1)).toLocalIterator():
            filt.have[filt.at[r.segment] >> 3 : filt.at[r.segment + 1] >> 3] = np.frombuffer(r.bits, np.uint8)
        filters.append(sc.broadcast(filt))

    out = T.StructType([T.StructField("rid", T.LongType()), T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, t()) for n, t in (("held_out", T.BooleanType), ("n_tokens", T.LongType), ("n_head", T.LongType), ("log_head", T.DoubleType), ("score", T.DoubleType))), T.StructField("rare", T.ArrayType(T.LongType()))])
    scored = saved(docs.mapInArrow(_scored(text, key, "held_out", filters, sc.broadcast((h[order], c[order])), total, distinct, weight), out), "scored")
    rare = scored.select("rid", F.explode("rare").alias("h")).join(vocab, "h")
    rare = rare.groupBy("rid").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("log_rare"))
    return scored.drop("rare").join(rare, "rid", "left").select(
        key, "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_head") + F.coalesce("log_rare", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"), "score",
    )


def corpus_scores(docs: DataFrame) -> DataFrame:
    return lm_scores(docs, fold(F.col("doc_id"), 7) == 2)
