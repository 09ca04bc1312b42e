"""Fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text wherever it hits a value; each chunk
gives one character. A fingerprint is "block:signature:signature at twice the
block", the block chosen so that the first has about 64 characters. Signatures at
equal blocks are compared by edit distance, so fingerprints of blocks that differ
by a factor of two can be compared too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldseam.llm.common import cut, whole

WINDOW = 7
LENGTH = 64
SMALLEST = 3
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_TIMES = [np.uint32(pow(0x01000193, i, 2**32)) for i in range(WINDOW)]


def rolling(data: bytes) -> np.ndarray:
    """A hash of the seven bytes that end at each byte (fewer at the start)."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    out = x.copy()
    for i in range(1, WINDOW):
        out[i:] += x[:-i] * _TIMES[i]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(13))


def _signature(data: bytes, rolled: np.ndarray, block: int) -> str:
    ends = (np.flatnonzero(rolled % np.uint32(block) == block - 1) + 1).tolist()
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    at, letters = 0, []
    for end in ends:
        letters.append(_LETTERS[zlib.crc32(data[at:end]) & 63])
        at = end
    return "".join(letters)


def fingerprint(text: str) -> str:
    """block:signature:signature. The block is the smallest of 3, 6, 12, ... whose 64 chunks hold the text, doubled
    while the signature has over 128 characters (as that of a periodic text may), or halved while
    it has under 32 and stays within 128. An empty text has "3::"."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return f"{SMALLEST}::"
    rolled, block = rolling(data), SMALLEST
    while block * LENGTH < len(data):
        block *= 2
    signature, coarse = _signature(data, rolled, block), None
    while len(signature) > 2 * LENGTH:
        block *= 2
        signature = _signature(data, rolled, block)
    while len(signature) < LENGTH // 2 and block > SMALLEST:
        finer = _signature(data, rolled, block // 2)
        if len(finer) > 2 * LENGTH:
            break
        block, coarse, signature = block // 2, signature, finer
    return f"{block}:{signature}:{coarse if coarse is not None else _signature(data, rolled, 2 * block)}"


def likeness(a: Column, b: Column) -> Column:
    """1 - edit distance / the longer length, of the best pair of signatures at equal blocks; 0 without such a pair."""
    x, y = F.split(a, ":"), F.split(b, ":")
    parts = [
        F.when(F.element_at(x, 1).cast("long") * m == F.element_at(y, 1).cast("long") * n,
               _similar(F.element_at(x, i), F.element_at(y, j)))
        for m, n, i, j in ((1, 1, 2, 2), (1, 1, 3, 3), (2, 1, 3, 2), (1, 2, 2, 3))
    ]
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.greatest(*parts), F.lit(0.0)))


def _similar(s: Column, t: Column) -> Column:
    longer = F.greatest(F.length(s), F.length(t))
    return F.coalesce(1 - F.try_divide(F.levenshtein(s, t).cast("double"), longer), F.lit(0.0))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many of the first code points of the next one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(key, text: str, own: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), digest, own, fingerprint(changed), next_print


_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def _batch(rows: list[tuple], kind: pa.DataType, edges: list[tuple]) -> pa.RecordBatch:
    """Rows of the result, then edge rows: part, whether first, key, text, fingerprint."""
    empty = [(None,) * 6] * len(edges)
    columns = [list(c) for c in zip(*(rows + empty), strict=True)]
    blank = [(None, None, None)] * len(rows)
    side = [list(c) for c in zip(*(blank + [(p, f, t) for p, f, _, t, _ in edges]), strict=True)]
    columns[0] = [*(r[0] for r in rows), *(e[2] for e in edges)]
    columns[3] = [*(r[3] for r in rows), *(e[4] for e in edges)]
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()]
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "part", "first", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, *side], types, strict=True)], names)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, each with its next one. The first and the last document come as edges as well."""
    part, held, kind = TaskContext.get().partitionId(), None, None
    for batch in batches:
        kind = batch.schema.field("key").type
        rows, edges = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = fingerprint(text)
            if held is None:
                edges.append((part, True, key, text, own))
            else:
                rows.append(_row(*held, text, own))
            held = key, text, own
        if rows or edges:
            yield _batch(rows, kind, edges)
    if held is not None:
        yield _batch([], kind, [(part, False, *held)])


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            yield _batch(rows, batch.schema.field(0).type, []).select(range(6))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next larger key, a null key coming first and
    equal keys in the order of their texts; the first follows the last, and a single
    document follows itself. A null text is empty. Other columns are not read.

    Documents are dealt in ranges of keys, so that a document's next one is in the same
    task; only the last document of a range meets the first of the next range later.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    ordered = rows.repartitionByRange(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text")
    found = cut(ordered.mapInArrow(_fingerprints, f"key {kind}, {_SCHEMA}, part int, first boolean, text string"))
    # One first and one last document per range.
    edges = found.filter("part is not null")
    heads = edges.filter("first").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    order = Window.orderBy("part")
    numbers = heads.select("part").withColumn(
        "next_part", F.coalesce(F.lead("part").over(order), F.first("part").over(order))
    )
    tails = edges.filter("not first").select("part", "key", "text", "fingerprint").join(numbers, "part")
    pairs = tails.drop("part").withColumnRenamed("next_part", "part").join(heads, "part")
    joined = pairs.select("key", "text", "fingerprint", "next_text", "next_print").mapInArrow(
        _join_edges, f"key {kind}, {_SCHEMA}"
    )
    every = found.filter("part is null").drop("part", "first", "text").unionByName(joined)
    return every.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
