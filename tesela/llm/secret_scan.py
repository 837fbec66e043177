"""Secrets in texts: three kinds of fixed patterns, and strings that a Markov model of random strings explains better.

Two character Markov models of first order, with add-one smoothing, are trained from labelled samples: one of random strings, one of
ordinary identifiers. A run of at least `RUN` characters of the alphabet that touches no span of the patterns becomes a span of kind
`markov` if its log-likelihood ratio for each character reaches the model's rate, which is the lowest that finds `RECALL` of the held-out random
samples of every mix of upper case, lower case, digits and signs. Shorter runs are not looked at: too few characters to tell by.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import steps

KINDS = ("assign", "access", "hex", "markov")
RUN, RECALL = 20, 0.97
#: One labelled sample in so many is held out of the counts and sets the rate.
HELD_OUT = 4


def _either_case(words: list[str]) -> str:
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


_ASSIGN = re.compile("(" + _either_case(["password", "passwd", "secret", "token"]) + "|" + _either_case(["api"]) + "_?" + _either_case(["key"]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_STEMS = (b"passw", b"secret", b"token", b"key")
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(256, 255, np.uint8)
_CODE[[ord(c) for c in _CHARS]] = np.arange(len(_CHARS))
_RUN_RE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % RUN)

#: Words that the ordinary samples are made of. Fixed values.
_WORDS = "account action address agent array async backup base batch block buffer build byte cache call case channel char check class client close cluster code column command commit common config connect content context control copy core count create cursor data date debug default delete device dir document domain driver edge element email empty end engine entry error event exec export factory field file filter first flag flow folder form format frame function gateway global graph group handler hash head health host image import index init input insert instance int item java job join kernel key label last layer length level limit line link list loader local lock log main manager map mask match memory merge message meta method metric mode model module monitor mutex name network node null number object offset open option order output owner packet page param parent parse path payload pipe plan plugin point policy pool port process profile project prop proxy public query queue range rank read record region register remote report request reset resource response result role root route row rule run sample schema scope score script search section segment select send server service session set shard shape signal size slot source space spark spec stage start state static status step storage store stream string struct style sum sync system table tag target task template test text thread time timer tool total trace track train tree type unit update upload url user value vector version view wait web window worker write zone".split()


def samples(n: int = 4_000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled strings: 1 for random ones of the alphabets that secrets use, 0 for identifiers made of words and for ruled lines."""
    r = random.Random(seed)
    upper, digits = _CHARS[:26], _CHARS[52:62]
    alphabets = [digits + "abcdef", _CHARS[:62], _CHARS[:64], upper + digits, _CHARS[26:62], _CHARS[:62] + "_-", _CHARS[:52], _CHARS[26:52], upper]
    out = [("".join(r.choices(r.choice(alphabets), k=r.randint(20, 64))), 1) for _ in range(n)]
    for _ in range(n):
        w, kind = r.choices(_WORDS, k=r.randint(3, 7)), r.randrange(7)
        tail = r.choice(["", "", str(r.randint(0, 99)), str(r.randint(1990, 2030)), f"v{r.randint(1, 9)}"])
        date = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
        out.append(([w[0] + "".join(x.title() for x in w[1:]) + tail, "_".join(w) + "_" * bool(tail) + tail, "_".join(w).upper() + tail, "/".join(w) + "/" + date, "-".join(w) + "-" + date, "".join(w) + tail, r.choice(["-", "=", "_", "+", "/", "=-", "+-", "_/"]) * r.randint(20, 40)][kind], 0))
    return out


class Model:
    """table[a, b]: log P(b | a) among random strings less that among ordinary ones, the last row for the first character; rate: the least ratio
    for each character of a secret."""

    def __init__(self, table: np.ndarray, rate: float = 0.0):
        self.table, self.rate = table, rate

    def ratio(self, run: str) -> float:
        c = _CODE[np.frombuffer(run.encode(), np.uint8)].astype(np.int64)
        return float(self.table[np.concatenate([[len(_CHARS)], c[:-1]]), c].sum())

    def secret(self, run: str) -> bool:
        return self.ratio(run) >= self.rate * len(run)


def _mix(run: str) -> tuple:
    return any(map(str.isupper, run)), any(map(str.islower, run)), any(map(str.isdigit, run)), not run.isalnum()


def train(labelled: list[tuple[str, int]]) -> Model:
    """From (string, 1 if random or 0 if ordinary). Every HELD_OUT-th sample only serves to set the rate, which is no lower than any held-out ordinary string's."""
    m = len(_CHARS)
    logs = []
    for label in (1, 0):
        counts = np.ones((m + 1, m))
        for i, (s, y) in enumerate(labelled):
            if y == label and i % HELD_OUT:
                c = _CODE[np.frombuffer(s.encode(), np.uint8)]
                c = c[c < m].astype(np.int64)
                np.add.at(counts, (np.concatenate([[m], c[:-1]]), c), 1)
        logs.append(np.log(counts / counts.sum(1, keepdims=True)))
    model, rates = Model(logs[0] - logs[1]), defaultdict(list)
    for s, y in labelled[::HELD_OUT]:
        if len(s) >= RUN and _RUN_RE.fullmatch(s):
            rates[_mix(s) if y else None].append(model.ratio(s[:RUN]) / RUN if y else model.ratio(s) / len(s))  # the shortest are the hardest
    ordinary = max(rates.pop(None, [0.0]))
    model.rate = max(ordinary, min((float(np.quantile(x, 1 - RECALL)) for x in rates.values() if len(x) > 20), default=0.0))
    return model


def find(model: Model, text: str, runs: bool = True, assigned: bool = True) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) in order; runs and assigned tell what the text may hold at all."""
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if assigned else []
    if runs:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        base.sort()
        starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
        for m in _RUN_RE.finditer(text):
            before = bisect_left(starts, m.end())  # spans that begin before the run ends
            if not (before and reach[before - 1] > m.start()) and model.secret(m[0]):
                base.append((m.start(), 3, m.end()))
    return sorted(base)


def _suspects(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bool], bytes]:
    """Which rows have a run of RUN characters, and which a stem of an assignment's name."""
    inside = np.concatenate([[0], (_CODE[data] < 255).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    first = start[end - start >= RUN]
    last = end[end - start >= RUN]
    long = np.searchsorted(last, at[:-1], "right") < np.searchsorted(first, at[1:])  # a run across rows suspects both
    raw = data.tobytes()
    low, at = raw.lower(), at.tolist()
    return long, [any(s in x for s in _STEMS) for a, b in zip(at[:-1], at[1:], strict=True) for x in (low[a:b],)], raw


def _scan(text: str, keep: list[str], model: Model, row: Callable, names: list[str], types: list) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in steps(batch.column(batch.schema.get_field_index(text))):
                long, named, raw = _suspects(data, at)
                out, at = [], at.tolist()
                for x in range(j - i):
                    if long[x] or named[x]:
                        s = raw[at[x] : at[x + 1]].decode("utf-8", "replace")
                        out.append(row(s, find(model, s, bool(long[x]), named[x])))
                    else:
                        out.append(row(None, []))
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in keep), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*keep, *names])

    return run


def _spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _report(_: str | None, spans: list) -> tuple:
    n = [sum(k == x for _, k, _ in spans) for x in range(4)]
    return *n[:3], hashlib.sha256(_spans([s for s in spans if s[1] < 3]).encode()).hexdigest(), _spans(spans), n[3]


def secret_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_markov for each row of docs.

    Spans are kind:start:end in code points, by start, then kind. A null or empty text has none; repeated rows each count, null keys stay, an
    empty table gives none, other columns are not used. The work grows with the text's length times the logarithm of its spans.
    """
    kinds = [("n_assign", T.LongType(), pa.int64()), ("n_access", T.LongType(), pa.int64()), ("n_hex", T.LongType(), pa.int64()), ("base_sha256", T.StringType(), pa.string()), ("spans", T.StringType(), pa.string()), ("n_markov", T.LongType(), pa.int64())]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, t) for n, t, _ in kinds)])
    return docs.select(key, text).mapInArrow(_scan(text, [key], train(labelled or samples()), _report, [k[0] for k in kinds], [k[2] for k in kinds]), schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlapping ones as one, put as [SECRET]."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars", labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """docs with every span of its texts masked, and the length column (if any) put right where a text has changed.

    Every row stays, with all its columns; null and empty texts stay as they are. A column __changed must not be there.
    """
    from pyspark.sql import functions as F

    model, at_text = train(labelled or samples()), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in steps(batch.column(at_text)):
                long, named, raw = _suspects(data, at)
                part, at = batch.slice(i, j - i), at.tolist()
                new: dict[int, str] = {}
                for x in np.flatnonzero(long | np.array(named)).tolist():
                    s = raw[at[x] : at[x + 1]].decode("utf-8", "replace")
                    if found := find(model, s, bool(long[x]), named[x]):
                        new[x] = masked(s, found)
                if new:
                    kept = part.column(at_text).to_pylist()
                    for x, s in new.items():
                        kept[x] = s
                    part = part.set_column(at_text, part.schema.field(at_text), pa.array(kept, part.schema.field(at_text).type))
                changed = np.zeros(j - i, bool)
                changed[list(new)] = True
                yield part.append_column("__changed", pa.array(changed))

    schema = T.StructType([*docs.schema.fields, T.StructField("__changed", T.BooleanType())])
    out = docs.mapInArrow(run, schema)
    if length and length in docs.columns:
        out = out.withColumn(length, F.when(F.col("__changed"), F.char_length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.drop("__changed")
