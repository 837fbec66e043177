"""Byte-level BPE with the tiktoken library and a local rank file: encoding, decoding to raw bytes, and digests of both.

The rank file is read on the driver and its bytes (fixed size) are broadcast, so workers need no copy of it. A text of over
`PIECE` characters is encoded in pieces that begin at safe places: the pattern matches white space only at the start of
a match or in matches of white space alone, so between an ASCII letter or digit and a space or line feed two matches always meet.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import steps

PIECE = 50_000
_SAFE = re.compile(r"(?<=[A-Za-z0-9])[ \n]")
_made: dict[str, tuple[tiktoken.Encoding, list[str]]] = {}


def encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, list[str]]:
    """The encoding, made once for a process, and the decimal form of each id."""
    name = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if name not in _made:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _made[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={}), [str(i) for i in range(max(table.values()) + 1)]
    return _made[name]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text cut at safe places, each piece up to the first such place after `size` characters."""
    a = 0
    while len(text) - a > size and (m := _SAFE.search(text, a + size)):
        yield text[a : m.start()]
        a = m.start()
    yield text[a:] if a else text


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for x in pieces(text) for i in enc.encode_ordinary(x)]


def _run(ranks, pattern: str, text: str, key: str, of: Callable, names: list[str], types: list) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, decimal = encoding(ranks.value, pattern)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            for i, j, data, at in steps(batch.column(batch.schema.get_field_index(text)), 1_000_000):
                raw, at = data.tobytes(), at.tolist()
                rows = [of(enc, decimal, raw[a:b].decode("utf-8", "replace")) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], names=[key, *names])

    return run


def _digests(enc: tiktoken.Encoding, decimal: list[str], text: str) -> tuple:
    ids = encode(enc, text)
    return len(ids), hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()


def _ids(enc: tiktoken.Encoding, decimal: list[str], text: str) -> tuple:
    ids = encode(enc, text)
    return len(ids), ids


def _applied(docs: DataFrame, ranks_file: str, pattern: str, text: str, key: str, of: Callable, columns: list[tuple]) -> DataFrame:
    with open(ranks_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, t) for n, t, _ in columns)])
    return docs.select(key, text).mapInArrow(_run(ranks, pattern, text, key, of, [n for n, _, _ in columns], [x for _, _, x in columns]), schema)


def bpe_digests(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the bytes the ids decode to).

    One row for each row of docs; null text is empty text, which has no token. Other columns are not used.
    """
    return _applied(docs, ranks_file, pattern, text, key, _digests, [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())])


def bpe_encode(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens and ids (array of int) for each row of docs; null text gives an empty array."""
    return _applied(docs, ranks_file, pattern, text, key, _ids, [("n_tokens", T.LongType(), pa.int64()), ("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))])


def bpe_decode(encoded: DataFrame, ranks_file: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and content: the raw bytes that the ids stand for, which need not be whole characters. Null ids give no bytes."""
    with open(ranks_file, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoding(ranks.value, pattern)
        for batch in batches:
            content = [enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=[key, "content"])

    return encoded.select(key, ids).mapInArrow(run, T.StructType([T.StructField(key, encoded.schema[key].dataType), T.StructField("content", T.BinaryType())]))
