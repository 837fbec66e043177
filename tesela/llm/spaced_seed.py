"""Benchmark decontamination with spaced seeds (after Ma et al., PatternHunter, 2002).

Texts become words: runs of ASCII letters and digits and of bytes above 127, A-Z folded. A mask such as 110101 hashes the words where it has 1 and
ignores those at 0, so a changed word does not hide a passage. Hashes of the items and of the texts are joined; around each hit
the item lies on the text at one offset, and the best run of that alignment (one point for a word that matches, less
`PENALTY` for one that does not) decides; where that is too short, the longest stretch with `LIKE` of its words equal does. So up
to a fifth of the words may be other ones, at the ends too.

Items of fewer than `SHORTEST` words are too short for masks: one is a leak where a whole line of the text has its words and no others.

The items are read in blocks of at most `BLOCK_WORDS` words, a proven bound of the driver's memory and of the broadcast;
every text meets every block. Items with the same words are one item until their rows are written, and hits are followed up in steps
of `STEP_HITS`, so that a phrase in many items and many places of a text costs time but not memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import mix, steps

#: Weight 6 over 8 to 10 words, and one of weight 5 for the ends of passages with many changes.
MASKS = ("11011011", "1110010111", "110101011", "101101001")
#: Items of SHORTEST to SHORT words, for which MASKS are too long or too few, have masks of their own: whichever word is another one, a mask ignores it.
SHORTEST, SHORT = 5, 8
#: A leak: at least MATCHES words, or WHOLE of the item's words if that is fewer, on a run with LIKE of its words equal.
MATCHES, WHOLE, LIKE, PENALTY = 10, 0.8, 0.8, 2.0
BLOCK_WORDS = 4_000_000
_TABLE = 1 << 22
STEP_HITS = 500_000

_INK = np.zeros(256, bool)
_INK[48:58] = _INK[65:91] = _INK[97:123] = _INK[128:] = True


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain = np.where(_INK[data], data, np.uint8(32))
    return common.words(plain, at)


def _hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Of each place where the mask fits."""
    n = len(h) - len(mask) + 1
    out = np.full(max(0, n), len(mask), np.uint64)
    if n > 0:
        for j, bit in enumerate(mask):
            if bit == "1":
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def _inside(n: int, at: np.ndarray, span: int) -> np.ndarray:
    """Which of n places leave span words inside their row."""
    end = np.repeat(at[1:], np.diff(at))[:n]
    return np.arange(n) + span <= end


def _longest(same: np.ndarray) -> tuple[int, int]:
    """Start and end of the longest stretch with LIKE of its words equal; none has more that match, as stretches with fewer other words can be made longer."""
    gain = np.concatenate([[0.0], np.cumsum(same - LIKE)])
    start = np.searchsorted(-np.minimum.accumulate(gain), -gain - 1e-9)  # the first place not above each end
    end = int((np.arange(len(gain)) - start).argmax())
    return int(start[end]), end


def _need(words: int) -> float:
    """How many words of an item of so many must match; the shortest have lines of their own."""
    return max(min(MATCHES, WHOLE * words), SHORTEST * WHOLE)


def _short_masks(n: int) -> list[str]:
    """For items of n words: all but the first or the last, and all but each of the others."""
    return ["1" * (n - 1), *("1" * i + "0" + "1" * (n - 1 - i) for i in range(1, n - 1))]


class Items:
    """A block of items as workers hold it; items of the same words are one, with all their ids."""

    def __init__(self, ids: list, texts: list[str]):
        raw = [(t or "").encode() for t in texts]
        h, at = _words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
        same: dict[bytes, list] = {}
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if b > a:
                same.setdefault(h[a:b].tobytes(), []).append(ids[i])
        self.ids = list(same.values())
        self.h = np.frombuffer(b"".join(same), np.uint64)
        self.at = np.concatenate([[0], np.cumsum([len(x) // 8 for x in same])]).astype(np.int64)
        size = np.diff(self.at)
        own = [(mask, n) for n in range(SHORTEST, SHORT + 1) if (size == n).any() for mask in _short_masks(n)]
        self.masks = [*MASKS, *(mask for mask, _ in own)]
        self.keys, self.places = [], []
        self.seen = np.zeros(_TABLE, bool)
        for mask, only in [*((mask, None) for mask in MASKS), *own]:
            k = _hashes(self.h, mask)
            ok = _inside(len(k), self.at, len(mask))
            if only:
                ok &= np.repeat(size == only, size)[: len(k)]
            place = np.flatnonzero(ok)
            order = np.argsort(k[place], kind="stable")
            self.keys.append(k[place][order])
            self.places.append(place[order])
            self.seen[(self.keys[-1] >> np.uint64(42)).astype(np.int64)] = True
        self.lines = {n: {_hashes(self.h[a : a + n], "1" * n)[0].item(): i for i, a in enumerate(self.at[:-1].tolist()) if size[i] == n} for n in range(1, SHORTEST)}

    def hits(self, h: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """(row, item, offset of the item's start in the text's words), distinct in each step of STEP_HITS hits or those of one place of a text."""
        for mask, keys, places in zip(self.masks, self.keys, self.places, strict=True):
            k = _hashes(h, mask)
            spot = np.flatnonzero(self.seen[(k >> np.uint64(42)).astype(np.int64)] & _inside(len(k), at, len(mask)))
            a, b = np.searchsorted(keys, k[spot], "left"), np.searchsorted(keys, k[spot], "right")
            spot, a, n = spot[b > a], a[b > a], (b - a)[b > a]
            total = np.cumsum(n)
            first = 0
            while first < len(spot):
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + STEP_HITS, "right")))
                c = n[first:last]
                t = np.repeat(spot[first:last], c)
                i = places[np.repeat(a[first:last], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
                item, row = np.searchsorted(self.at, i, "right") - 1, np.searchsorted(at, t, "right") - 1
                yield np.unique(np.stack([row, item, (t - at[row]) - (i - self.at[item])], 1), axis=0)
                first = last

    def _equal(self, h: np.ndarray, at: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """How many words of the item lie on the same words of the text, for each hit."""
        row, item, off = hits.T
        size, out = np.diff(self.at)[item], np.zeros(len(hits), np.int64)
        for part in np.array_split(np.arange(len(hits)), -(-int(size.sum()) // 4_000_000) or 1):
            n = size[part]
            own = np.repeat(self.at[item[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = own - np.repeat(self.at[item[part]] - off[part] - at[row[part]], n)
            inside = (place >= np.repeat(at[row[part]], n)) & (place < np.repeat(at[row[part] + 1], n))
            same = inside & (h[np.clip(place, 0, len(h) - 1)] == self.h[own])
            out[part] = np.bincount(np.repeat(np.arange(len(part)), n), same, len(part)).astype(np.int64)
        return out

    def _run(self, text: np.ndarray, item: int, off: int) -> tuple[int, int, int] | None:
        """(first word in the text, words, words that match) of the best run of an alignment, if it is a leak."""
        own = self.h[self.at[item] : self.at[item + 1]]
        lo, hi = max(0, -off), min(len(own), len(text) - off)
        same = text[off + lo : off + hi] == own[lo:hi]
        gain = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -PENALTY))])
        rise = gain - np.minimum.accumulate(gain)
        end = int(rise.argmax())
        start = int(gain[: end + 1].argmin())
        match, need = int(same[start:end].sum()), _need(len(own))
        if not (match >= need and match >= LIKE * (end - start)) and same.sum() >= need:
            start, end = _longest(same)
            match = int(same[start:end].sum())
        return (off + lo + start, end - start, match) if match >= need and match >= LIKE * (end - start) else None

    def verified(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, first word in the text, words of the run, words that match): of each row and item that leak the run with most matches, the first of several."""
        best: dict[tuple[int, int], tuple] = {}
        need = np.array([_need(n) for n in np.diff(self.at).tolist()])
        for hits in self.hits(h, at):
            equal = self._equal(h, at, hits)
            pick = np.flatnonzero(equal >= need[hits[:, 1]])
            for x in pick[np.lexsort((hits[pick, 2], -equal[pick]))].tolist():  # an alignment has no more matches than equal words
                row, item, off = hits[x].tolist()
                if (row, item) in best and (int(equal[x]), -off) <= best[row, item][0]:
                    continue
                found = self._run(h[at[row] : at[row + 1]], item, off)
                if found and (row, item) not in best or found and (found[2], -off) > best[row, item][0]:
                    best[row, item] = (found[2], -off), *found
        for (row, item), (_, start, n, match) in best.items():
            yield row, item, start, n, match

    def as_lines(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """The same for items of fewer than SHORTEST words: the first line of a row that has an item's words and no others."""
        if not any(self.lines.values()):
            return
        breaks = np.flatnonzero(data == 10) + 1
        cuts = np.unique(np.concatenate([at, breaks]))
        h, w = _words(data, cuts)
        count, row = np.diff(w), np.searchsorted(at, cuts[:-1], "right") - 1
        begin = w[np.searchsorted(cuts, at[:-1])]  # the first word of each row
        seen = set()
        for n, wanted in self.lines.items():
            line = np.flatnonzero(count == n)
            if not wanted or not len(line):
                continue
            found = _hashes(h, "1" * n)[w[line]]
            known = np.isin(found, np.fromiter(wanted, np.uint64))
            for i, k in zip(line[known].tolist(), found[known].tolist(), strict=True):
                x = int(row[i]), wanted[k]
                if x not in seen:
                    seen.add(x)
                    yield *x, int(w[i] - begin[x[0]]), n, n

    def found(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        yield from self.verified(*_words(data, at))
        yield from self.as_lines(data, at)


def _blocks(items: DataFrame, text: str, key: str) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for r in items.select(key, text).filter(F.col(text).isNotNull()).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1]) // 2 + 1
        if size > BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs and item of which it holds a passage: key, item_key, first_word, run_words, matched, item_words.

    Null and empty texts leak nothing, nor do items without a word. Repeated rows and repeated items each count, null keys stay, empty tables
    give none, other columns are not used. Of a row and an item the run with most matches is given, the first of several.
    """
    spark = docs.sparkSession
    schema = T.StructType([docs.schema[key], items.schema[item_key], *(T.StructField(n, T.LongType()) for n in ("first_word", "run_words", "matched", "item_words"))])
    out = None
    for block in _blocks(items, item_text, item_key):
        part = docs.select(key, text).mapInArrow(_found(spark.sparkContext.broadcast(block), text, key, item_key, schema), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _found(block, text: str, key: str, item_key: str, schema: T.StructType) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            for i, _, data, at in steps(batch.column(batch.schema.get_field_index(text))):
                rows = [(keys[i + row].as_py(), own, start, n, match, int(items.at[item + 1] - items.at[item])) for row, item, start, n, match in items.found(data, at) for own in items.ids[item]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return run


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no passage of any item, with all their columns. Null and empty texts stay, as do repeated rows and null keys."""

    def keep(block) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                for i, _, data, at in steps(batch.column(batch.schema.get_field_index(text))):
                    for row, *_ in block.value.found(data, at):
                        ok[i + row] = False
                yield batch.filter(pa.array(ok))

        return run

    for block in _blocks(items, item_text, item_key):
        docs = docs.mapInArrow(keep(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs
