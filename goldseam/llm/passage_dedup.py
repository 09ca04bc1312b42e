"""Substring dedup by hashing lines and the sentences in them.

Texts are tiled with units: a sentence with the marks and white space behind it,
or a line's rest. Units are normalised and hashed, digests are grouped globally,
and the occurrence in the least document (then at the least offset) is kept.
A line of repeated units only goes, whatever its length. In a line that also has
something of its own, repeated sentences go if the run of them that they stand in
has MIN_WORDS words or more: "Dr." or "1." in front of a new sentence stays.
A mark right before a digit or a small letter ends no sentence, so that 3.14 is not
taken for a repeated 3 and a repeated 14. Offsets of what went are kept.

Only hashes and offsets are grouped and joined; the digest of a unit that very
many documents share is pre-aggregated per task, and AQE splits its join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import cut, whole

MIN_WORDS = 5
LAST = 2**63 - 1
_UNIT = re.compile(r"(?:[^.!?\n]|[.!?]++(?=[a-z0-9]))++[.!?]*+\s*+|[.!?\s]++")


def units(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and normalised form (lower case, single spaces) of each unit; they tile the text."""
    for match in _UNIT.finditer(text):
        yield match.start(), match.end(), " ".join(match[0].lower().split())


def _hash_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document two aligned lists: 64 bits of each unit's digest, and its start with 32 further bits."""
    for batch in batches:
        digests, places = [], []
        for text in batch.column("text").to_pylist():
            own, at = [], []
            for start, _, normal in units(text):
                if normal:
                    digest = xxhash.xxh3_128_intdigest(normal)
                    own.append((digest & (2**64 - 1)) - 2**63)
                    at.append(start << 32 | digest >> 96)
            digests.append(own)
            places.append(at)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rank"), batch.column("mark"), pa.array(digests, pa.list_(pa.int64())),
             pa.array(places, pa.list_(pa.int64()))],
            ["rank", "mark", "digests", "places"],
        )


def removed_spans(text: str, repeated: set[int], min_words: int) -> list[tuple[int, int]]:
    """Spans of units whose starts are in ``repeated``: whole lines of them, and runs of at least ``min_words`` words."""
    runs: list[list[list]] = [[]]
    line: list[list] = []
    whole_line = True
    for a, b, normal in units(text):
        if a in repeated or not normal:
            unit = [a, b, len(normal.split()), False]
            line.append(unit)
            if normal or runs[-1]:
                runs[-1].append(unit)
        else:
            whole_line = False
            runs.append([])
        if b == len(text) or "\n" in text[a:b]:
            for unit in line:
                unit[3] = whole_line
            line, whole_line = [], True
    spans: list[tuple[int, int]] = []
    for run in runs:
        long = sum(words for _, _, words, _ in run) >= min_words
        for a, b, _, alone in run:
            if long or alone:
                if spans and spans[-1][1] == a:
                    a = spans.pop()[0]
                spans.append((a, b))
    return spans


def _strip(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, spans, gone = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                removed = removed_spans(text, set(starts), min_words) if starts else []
                at, parts = 0, []
                for a, b in removed:
                    parts.append(text[at:a])
                    at = b
                left.append("".join([*parts, text[at:]]))
                spans.append(",".join(f"{a}:{b}" for a, b in removed))
                gone.append(sum(b - a for a, b in removed))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(left, pa.string()), pa.array(spans, pa.string()), pa.array(gone, pa.int64())],
                ["key", "text", "removed", "n_removed"],
            )

    return run


def _rank(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(LAST))


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: key, text (what is left), removed ("start:end,...", code points), n_removed (code points).

    Occurrences are ranked by key (null last), then offset. A null text is empty;
    an empty text loses nothing. Rows with equal key count as one document: what they
    share at the same place stays in each. No rows in, none out. Other columns are
    not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    marked = docs.select(
        F.col(key).alias("key"), _rank(F.col(key)).alias("rank"), whole(F.col(text)).alias("text")
    ).withColumn("mark", F.xxhash64("text"))
    hashed = marked.select("rank", "mark", "text").mapInArrow(
        _hash_units, "rank long, mark long, digests array<long>, places array<long>"
    )
    rows = hashed.select("rank", "mark", F.inline(F.arrays_zip("digests", "places"))).toDF("rank", "mark", "digest", "place")
    first = cut(
        rows.groupBy("digest")
        .agg(F.min(F.struct("rank", "place")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", F.col("first.rank").alias("first_rank"), F.col("first.place").alias("first_place"))
    )
    repeated = rows.join(first, "digest").filter(
        "(rank != first_rank or place != first_place) and (place & 4294967295) = (first_place & 4294967295)"
    )
    starts = repeated.groupBy("rank", "mark").agg(
        F.collect_set(F.shiftrightunsigned("place", 32).cast("int")).alias("starts")
    )
    return marked.join(starts, ["rank", "mark"], "left").select("key", "text", "starts").mapInArrow(
        _strip(min_words), f"key {kind}, text string, removed string, n_removed long"
    ).withColumnRenamed("key", key)
