"""Language identification by a convolutional network over bytes, trained in numpy and applied to windows that tile whole texts.

Bytes (A-Z as a-z) are embedded; filters of widths 2, 3 and 4 slide over a window, the maximum of each over the window
(max pooling, then ReLU) goes to a softmax layer. For applying it, embedding and filters are folded into tables for pairs of
bytes, so a filter's response is one or two table rows added. A text's prediction is the mean of its windows', by length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_text, steps

WINDOW, WIDTHS, FILTERS, EMBED = 96, (2, 3, 4), 16, 8
#: Bounds of the sample that the network is trained on: texts of each language (more or less, drawn by hash), windows of a text.
TEXTS, WINDOWS = 800, 4
#: Languages at most, those with most texts.
LANGUAGES = 500
EPOCHS, BATCH, RATE = 6, 128, 0.004
#: What texts without a letter are, and what has letters but no language (if the network is trained to tell).
UNKNOWN, JUNK = "und", "zxx"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = 1
_EDGE = WIDTHS[-1] - 1


def _windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of WINDOW + _EDGE bytes that tile each text, 0 after its end; the text of each; the bytes each holds."""
    n = -(-np.diff(at) // WINDOW)
    row = np.repeat(np.arange(len(n)), n)
    start = at[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    spot = start[:, None] + np.arange(WINDOW + _EDGE)
    out = np.where(spot < at[row + 1][:, None], _FOLD[data[np.minimum(spot, max(0, len(data) - 1))]], 0).astype(np.uint8)
    return out, row, np.minimum(at[row + 1] - start, WINDOW)


class Network:
    def __init__(self, names: list[str], seed: int = 3):
        r = np.random.default_rng(seed)
        self.names = names
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)), "w": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names))), "c": np.zeros(len(names)), "b": np.zeros(len(WIDTHS) * FILTERS)}
        for w in WIDTHS:
            self.p[f"f{w}"] = r.normal(0, (EMBED * w) ** -0.5, (w, EMBED, FILTERS))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
        """Adam on the cross-entropy, languages weighed alike."""
        r, p = np.random.default_rng(seed), self.p
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        weight = len(y) / (len(self.names) * np.maximum(np.bincount(y, minlength=len(self.names)), 1))
        t = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for i in range(0, len(x), BATCH):
                pick = order[i : i + BATCH]
                xb, yb, n = x[pick].astype(np.int64), y[pick], len(pick)
                top, arg = [], []
                for w in WIDTHS:
                    s = sum((p["e"] @ p[f"f{w}"][j])[xb[:, j : j + WINDOW]] for j in range(w))
                    arg.append(a := s.argmax(1))
                    top.append(np.take_along_axis(s, a[:, None], 1)[:, 0])
                z = np.concatenate(top, 1) + p["b"]
                h = np.maximum(z, 0)
                q = h @ p["w"] + p["c"]
                q = np.exp(q - q.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(n), yb] -= 1
                q *= (weight[yb] / n)[:, None].astype(np.float32)
                g = {"w": h.T @ q, "c": q.sum(0), "e": np.zeros_like(p["e"])}
                dz = (q @ p["w"].T) * (z > 0)
                g["b"] = dz.sum(0)
                for k, w in enumerate(WIDTHS):
                    d = dz[:, k * FILTERS : (k + 1) * FILTERS]
                    g[f"f{w}"] = np.zeros_like(p[f"f{w}"])
                    for j in range(w):
                        byte = np.take_along_axis(xb, arg[k] + j, 1)  # what each filter saw at its maximum
                        g[f"f{w}"][j] = np.einsum("nf,nfe->ef", d, p["e"][byte])
                        np.add.at(g["e"], byte, d[:, :, None] * p[f"f{w}"][j].T[None])
                t += 1
                for k in p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    p[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def folded(self) -> Network:
        """Ready to apply: tables[0] has the responses to pairs of bytes at offsets 0 and 1, tables[1] what is added from offset 2."""
        e, pairs = self.p["e"], lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        one = {(w, j): e @ self.p[f"f{w}"][j] for w in WIDTHS for j in range(w)}
        self.first = [np.ascontiguousarray(pairs(one[w, 0], one[w, 1])) for w in WIDTHS]
        self.then = [None, one[3, 2], np.ascontiguousarray(pairs(one[4, 2], one[4, 3]))]
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        top = [
            self.first[0].take(pair[:, :WINDOW], 0).max(1),
            (self.first[1].take(pair[:, :WINDOW], 0) + self.then[1].take(x[:, 2 : 2 + WINDOW], 0)).max(1),
            (self.first[2].take(pair[:, :WINDOW], 0) + self.then[2].take(pair[:, 2 : 2 + WINDOW], 0)).max(1),
        ]
        q = np.maximum(np.concatenate(top, 1) + self.p["b"], 0) @ self.p["w"] + self.p["c"]
        q = np.exp(q - q.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)


def noise(windows: np.ndarray, n: int, seed: int = 13) -> np.ndarray:
    """n windows of no language: half of them given ones with their bytes in another order, the others random letters with spaces, random printable
    characters, random bytes."""
    r = np.random.default_rng(seed)
    mixed = windows[r.integers(0, len(windows), n)].copy()
    place = np.where(mixed > 0, r.random(mixed.shape), 2.0 + np.arange(mixed.shape[1]))  # what is after the end stays there
    mixed = np.take_along_axis(mixed, place.argsort(1), 1)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 2 + b"        ", np.uint8)
    made = [letters[r.integers(0, len(letters), mixed.shape)], r.integers(33, 127, mixed.shape).astype(np.uint8), r.integers(1, 256, mixed.shape).astype(np.uint8)]
    kind = r.choice(4, n, p=[0.5, 0.25, 0.125, 0.125])
    return np.where(mixed > 0, np.stack([mixed, *(_FOLD[m] for m in made)])[kind, np.arange(n)], 0).astype(np.uint8)


def _sampled(text: str, lang: str, key: str) -> Callable:
    """Rows (lang, window): WINDOWS windows spread over each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index(lang))
            for i, j, data, at in steps(batch.column(batch.schema.get_field_index(text))):
                x, row, _ = _windows(data, at)
                n = np.bincount(row, minlength=j - i)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                size = n[row]
                pick = (nth * WINDOWS // size) != ((nth - 1) * WINDOWS // size)  # the first window of each of WINDOWS parts
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(i + row[pick])), pa.array([w.tobytes() for w in x[pick]], pa.binary())], names=["lang", "window"])

    return run


def train(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", junk: bool = False) -> Network | None:
    """A network that knows the languages of the rows not held out; None if none has a language and a text.

    Trained on about TEXTS texts of each language (all, if fewer), drawn by a hash of text and key. With junk it also knows the class JUNK, from
    made-up windows, as many as a language has on average.
    """
    known = docs.filter(~held_out & F.col(lang).isNotNull() & (F.length(text) > 0)).select(key, text, lang)
    sizes = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang).limit(LANGUAGES).collect()}
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, TEXTS / n))))
    drawn = known.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), text), F.lit(1 << 30)) < share[F.col(lang)] * (1 << 30))
    rows = drawn.mapInArrow(_sampled(text, lang, key), "lang string, window binary").toArrow().sort_by([("lang", "ascending"), ("window", "ascending")])
    names = sorted(set(rows["lang"].to_pylist()))
    x, langs = raw_text(rows["window"])[0].reshape(-1, WINDOW + _EDGE), rows["lang"].to_pylist()
    if junk:
        made = noise(x, -(-len(x) // len(names)))
        x, langs, names = np.concatenate([x, made]), langs + [JUNK] * len(made), sorted({*names, JUNK})
    y = np.searchsorted(np.array(names), np.array(langs))
    return Network(names).fit(x, y).folded()


def _predicted(text: str, keep: list[str], network, names: tuple[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        for batch in batches:
            for i, j, data, at in steps(batch.column(batch.schema.get_field_index(text)), 250_000):
                n = j - i
                letters = np.concatenate([[0], np.cumsum(_LETTER[data])])[at]
                named = np.diff(letters) > 0
                for x in np.flatnonzero(~named & (np.diff(at) > 0)).tolist():
                    named[x] = any(map(str.isalpha, data[at[x] : at[x + 1]].tobytes().decode("utf-8", "replace")))
                best, score = np.full(n, -1), np.zeros(n)
                if net is not None and named.any():
                    x, row, size = _windows(data, at)
                    q = np.concatenate([net.probabilities(x[a : a + 2_000]) for a in range(0, len(x), 2_000)])
                    total = np.stack([np.bincount(row, q[:, c] * size, n) for c in range(len(net.names))], 1) / np.maximum(np.diff(at), 1)[:, None]
                    best, score = np.where(named, total.argmax(1), -1), np.where(named, np.clip(total.max(1), 0, 1), 0.0)
                found = pa.array([net.names[b] if b >= 0 else UNKNOWN for b in best.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(i, n) for c in keep), found, pa.array(score)], names=[*keep, *names])

    return run


def predict(docs: DataFrame, network: Network | None, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns of docs (all by default) with lang_pred and score, the mean probability of that language.

    A null text or one without a letter is `und` with score 0, as is every text if there is no network. Ties go to the
    name that sorts first. names are those of the two new columns, which take the place of kept ones of these names. Repeated rows each
    count, null keys stay, an empty table gives none.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    need = list(dict.fromkeys([*keep, text]))
    return docs.select(*need).mapInArrow(_predicted(text, keep, docs.sparkSession.sparkContext.broadcast(network), names), schema)
