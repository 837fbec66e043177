"""Text quality by a generalised additive model with pairwise interactions (after Lou et al., 2013).

Features of a text are cut into bins. Shallow trees are boosted on the log-loss, one feature after another in turn, and summed into
one lookup table for each feature; then trees on two features, for the pairs whose cells explain most of what is left, into
one table for each such pair. A score adds one table value for each feature and pair: all rows at once, by bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chained, steps, words

#: Bound of the sample of labelled rows that the model is fitted on, drawn by hash of their keys; all of them if fewer. Of several documents
#: of one key the one whose features sort first counts.
LABELLED = 20_000
BINS, COARSE, PAIRS = 48, 12, 8
#: LEAST_LEAF: the weight (sum of p (1 - p)) under which a leaf counts for nothing when cuts are compared.
ROUNDS, PAIR_ROUNDS, RATE, LEAST_LEAF, RIDGE = 60, 30, 0.15, 0.8, 2.0

FEATURES = ("chars", "words", "word_length", "upper", "digit", "space", "stop", "pipe", "bang", "symbol", "bracket", "beyond_ascii", "lines", "line_length", "distinct_words", "distinct_pairs", "commonest_word", "distinct_lines")

_SETS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "stop": b".,;:?", "pipe": b"|", "bang": b"!", "symbol": b"#$%&*+=@^_~`\\/", "bracket": b"()[]{}<>\"'"}
_KIND = np.zeros(256, np.int64)
for _i, _s in enumerate(_SETS.values(), 1):
    _KIND[list(_s)] = _i
_KIND[128:192] = 10
_KIND[192:] = 9


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 11 + _KIND[data], minlength=n * 11).reshape(n, 11)
    chars = size - kinds[:, 10]
    share = kinds[:, 1:10] / np.maximum(chars, 1)[:, None]
    h, w = words(data, at)
    n_words = np.diff(w)
    pairs = chained(h, 2)
    breaks = np.flatnonzero(data == 10)
    lines = np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1]) + 1
    distinct = np.ones((n, 4))
    raw, ends = data.tobytes(), at.tolist()
    for i, (a, b) in enumerate(zip(w[:-1].tolist(), w[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(h[a:b])
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[i, 0] = (len(cut) - 1) / (b - a)
            distinct[i, 2] = np.diff(cut).max() / (b - a)
            if b - a > 1:
                distinct[i, 1] = len(np.unique(pairs[a : b - 1])) / (b - a - 1)
        if lines[i] > 1:
            distinct[i, 3] = len(set(raw[ends[i] : ends[i + 1]].split(b"\n"))) / lines[i]
    return np.column_stack([np.log1p(chars), np.log1p(n_words), (chars - kinds[:, 3]) / np.maximum(n_words, 1), share[:, :8], share[:, 8], np.log1p(lines), chars / lines, distinct])


class Model:
    """prior, cuts and tables of the features, tables of the pairs."""

    def __init__(self, prior: float, cuts: list[np.ndarray]):
        self.prior, self.cuts = prior, cuts
        self.one = [np.zeros(len(c) + 1) for c in cuts]
        self.two: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)])

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.prior)
        for f, t in enumerate(self.one):
            z += t[b[:, f]]
        for f, g, cf, cg, t in self.two:
            z += t[cf[b[:, f]], cg[b[:, g]]]
        return 1 / (1 + np.exp(-z))


def _leaf(g, h):
    return g / (h + RIDGE)


def _gain(g, h):
    return np.where(h >= LEAST_LEAF, g * g / (h + RIDGE), 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of the best tree with up to three leaves over ordered bins with gradients g and weights h."""
    value = np.zeros(len(g))
    ends = [0, len(g)]
    for _ in range(2):
        found = None
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            if len(cg) > 1:
                gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
                k = int(gains.argmax())
                if gains[k] > 1e-9 and (found is None or gains[k] > found[0]):
                    found = gains[k], a + k + 1
        if found is None:
            break
        ends = sorted([*ends, found[1]])
    if len(ends) > 2:
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            value[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return value


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree that cuts one feature, then each side by the other: (gain, values by cell)."""
    best, out = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        ca, cb = np.cumsum(a, 0), np.cumsum(b, 0)
        for k in range(len(a) - 1):
            value, gain = np.zeros_like(a), -_gain(a.sum(), b.sum())
            for part, sg, sh in ((slice(0, k + 1), ca[k], cb[k]), (slice(k + 1, None), ca[-1] - ca[k], cb[-1] - cb[k])):
                lg, lh = np.cumsum(sg), np.cumsum(sh)
                both = _gain(lg[:-1], lh[:-1]) + _gain(lg[-1] - lg[:-1], lh[-1] - lh[:-1])
                c = int(both.argmax()) if len(both) else 0
                gain += both[c] if len(both) else _gain(lg[-1], lh[-1])
                value[part, : c + 1] = _leaf(lg[c], lh[c])
                value[part, c + 1 :] = _leaf(lg[-1] - lg[c], lh[-1] - lh[c])
            if gain > best:
                best, out = float(gain), value.T if flip else value
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: rows of features; y: 0 or 1. No rows give 0.5 for all; a single label gives a constant on its side."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    model = Model(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), cuts)
    if not 0 < y.sum() < len(y):
        return model
    bins = model.bins(x)
    z = np.full(len(y), model.prior)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, t in enumerate(model.one):
            g, h = (np.bincount(bins[:, f], v, len(t)) for v in slopes())
            step = RATE * _tree(g, h)
            t += step
            z += step[bins[:, f]]
    coarse = [np.arange(len(t)) * COARSE // len(t) for t in model.one]

    def cells(f: int, g: int) -> np.ndarray:
        return coarse[f][bins[:, f]] * COARSE + coarse[g][bins[:, g]]

    def grid(cell: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in slopes()]

    ranked = sorted(((_cross(*grid(cells(f, g)))[0], f, g) for f in range(len(FEATURES)) for g in range(f)), reverse=True)[:PAIRS]
    model.two = [(f, g, coarse[f], coarse[g], np.zeros((COARSE, COARSE))) for _, f, g in ranked]
    for _ in range(PAIR_ROUNDS):
        for f, g, _, _, t in model.two:
            cell = cells(f, g)
            step = RATE * _cross(*grid(cell))[1]
            t += step
            z += step.ravel()[cell]
    return model


def _described(text: str, key: str, label: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, y = (batch.column(batch.schema.get_field_index(c)) for c in (key, label))
            for i, j, data, at in steps(batch.column(batch.schema.get_field_index(text))):
                x = features(data, at)
                yield pa.RecordBatch.from_arrays([k.slice(i, j - i), y.slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["k", "y", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id") -> Model:
    """Fitted on labelled texts: labels has key and label (0 or 1; rows with nulls are left out, several of a key go by their mean,
    a half as 1). At most about LABELLED keys, drawn by hash, so the join's labelled side has a bound and is broadcast, and one row for
    each of them comes to the driver."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("__y"))
    n = known.count()
    share = min(1.0, LABELLED / max(n, 1))
    drawn = known.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = docs.select(key, text).join(F.broadcast(drawn), key)
    rows = rows.mapInArrow(_described(text, key, "__y"), T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())]))
    rows = rows.groupBy("k").agg(F.first("y").alias("y"), F.min("x").alias("x")).toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # the same sums in the same order, however rows arrive
    return fit(x[order], rows["y"].to_numpy().astype(np.float64)[order])


def _applied(text: str, keep: list[str], model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for i, j, data, at in steps(batch.column(batch.schema.get_field_index(text))):
                s = m.score(features(data, at))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return run


def classify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with score (0 to 1) and predicted (1 from 0.5), which take the place of columns of these names.

    Null text counts as empty, which has a score too. Repeated rows each count, null keys stay, an empty table gives none."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_applied(text, keep, docs.sparkSession.sparkContext.broadcast(model)), schema)


def quality(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column]) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of held-out keys are not read."""
    out = held_out(F.col("doc_id"))
    model = train(docs, labels.filter(~out), "quality")
    return classify(docs.withColumn("held_out", out), model, keep=["doc_id", "held_out"])
