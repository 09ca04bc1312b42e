"""Exact duplicates by a sharded cuckoo-filter index of live digests.

The index is a table: one row per stored digest with its shard, bucket and
fingerprint, the number of live rows and the row to keep. A change is dealt to
its shard, where the filter is asked first; a hit is verified against the digest
stored in that slot, so a false hit never joins two texts. When an insertion
finds no free slot after ``MAX_KICKS`` moves, the shard's filter is doubled and
refilled from its stored digests. Shards hold about ``SHARD_ROWS`` digests, so
their number grows with the input and a task's memory does not.

Rows of a text are folded per Arrow batch before they are dealt, so a text that
a third of all rows share sends one row per batch to its shard.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldseam.llm.common import cut, fresh, whole

SLOTS = 4
MAX_KICKS = 200
SHARD_ROWS = 200_000
LOWEST = -(2**63)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INDEX = "shard int, bucket long, fingerprint int, digest binary, live long, keep_rank long, keep_row long"


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; each slot also names the entry whose digest it stands for."""

    def __init__(self, buckets: int = 64):
        self.digests: list[bytes | None] = []
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.entries = array("q", bytes(8 * SLOTS * buckets))
        self.kicks = 0

    def place(self, digest: bytes) -> tuple[int, int]:
        """Fingerprint and first bucket. Fingerprint 0 marks a free slot and is never used."""
        return int.from_bytes(digest[:2], "big") or 1, int.from_bytes(digest[8:16], "big") & self.mask

    def other(self, mark: int, bucket: int) -> int:
        return (bucket ^ (mark * 0x9E3779B97F4A7C15 >> 13)) & self.mask

    def _slot(self, digest: bytes) -> int:
        mark, bucket = self.place(digest)
        for b in (bucket, self.other(mark, bucket)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                # A filter hit counts only if the stored digest is the same.
                if self.prints[slot] == mark and self.digests[self.entries[slot]] == digest:
                    return slot
        return -1

    def find(self, digest: bytes) -> int:
        """The entry of a digest, or -1."""
        slot = self._slot(digest)
        return self.entries[slot] if slot >= 0 else -1

    def insert(self, digest: bytes) -> int:
        """Store a digest that is not there yet; returns its entry."""
        entry = len(self.digests)
        self.digests.append(digest)
        if not self._settle(digest, entry):
            self._grow()
        return entry

    def delete(self, digest: bytes) -> None:
        slot = self._slot(digest)
        if slot >= 0:
            self.digests[self.entries[slot]] = None
            self.prints[slot] = 0

    def _settle(self, digest: bytes, entry: int) -> bool:
        mark, bucket = self.place(digest)
        for b in (bucket, self.other(mark, bucket)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    return True
        for _ in range(MAX_KICKS):
            self.kicks += 1
            slot = bucket * SLOTS + self.kicks % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            entry, self.entries[slot] = self.entries[slot], entry
            bucket = self.other(mark, bucket)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    return True
        return False

    def _grow(self) -> None:
        buckets = 2 * (self.mask + 1)
        while True:
            self._clear(buckets)
            if all(self._settle(d, e) for e, d in enumerate(self.digests) if d is not None):
                return
            buckets *= 2

    def stored(self) -> Iterator[tuple[int, int, int]]:
        """Entry, bucket and fingerprint of every taken slot."""
        for slot, mark in enumerate(self.prints):
            if mark:
                yield self.entries[slot], slot // SLOTS, mark


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as hex. Texts of ASCII only take the quicker lower()."""
    text = whole(text)
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.sha2(lowered.cast("binary"), 256)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per digest of a batch: rows together, and the largest (rank, row)."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).sort_by([("keep_rank", "ascending"), ("keep_row", "ascending")])
        folded = table.group_by(["shard", "digest"], use_threads=False).aggregate(
            [("live", "sum"), ("keep_rank", "last"), ("keep_row", "last")]
        )
        folded = folded.select(["shard", "digest", "live_sum", "keep_rank_last", "keep_row_last"])
        yield from folded.rename_columns(["shard", "digest", "live", "keep_rank", "keep_row"]).to_batches()


def _shard(table: pa.Table) -> pa.Table:
    """Apply the changes of one shard to its stored rows."""
    columns = {name: table[name].to_pylist() for name in ("digest", "live", "keep_rank", "keep_row", "stored")}
    order = sorted(range(table.num_rows), key=lambda i: (not columns["stored"][i], columns["live"][i] < 0))
    held, live, keep = CuckooFilter(), [], []
    for i in order:
        digest, n, row = columns["digest"][i], columns["live"][i], (columns["keep_rank"][i], columns["keep_row"][i])
        entry = held.find(digest)
        if entry < 0:
            if n > 0:
                held.insert(digest)
                live.append(n)
                keep.append(row)
            continue
        live[entry] += n
        if n > 0:
            keep[entry] = max(keep[entry], row)
        elif live[entry] <= 0:
            held.delete(digest)
    rows = sorted((held.digests[e], b, m, live[e], *keep[e]) for e, b, m in held.stored())
    shard = table["shard"][0].as_py()
    return pa.table(
        {
            "shard": pa.array([shard] * len(rows), pa.int32()),
            "bucket": pa.array([r[1] for r in rows], pa.int64()),
            "fingerprint": pa.array([r[2] for r in rows], pa.int32()),
            "digest": pa.array([r[0] for r in rows], pa.binary()),
            "live": pa.array([r[3] for r in rows], pa.int64()),
            "keep_rank": pa.array([r[4] for r in rows], pa.int64()),
            "keep_row": pa.array([r[5] for r in rows], pa.int64()),
        }
    )


def shard_count(rows: int, at_least: int) -> int:
    return max(at_least, -(-rows // SHARD_ROWS))


def update_index(index: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """The index after some changes; ``index=None`` stands for an empty one.

    ``changes`` has digest (binary), live (rows added, or below zero: taken away),
    keep_rank and keep_row (long). Insertions come before deletions; taking away
    more rows than are live, or an absent digest, leaves nothing behind and is no
    error. A digest whose last row goes leaves the filter. The row to keep is the
    largest (rank, row) inserted since the digest came in. ``shards`` must stay the
    same for the life of an index.
    """
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    folded = changes.select(shard, "digest", "live", "keep_rank", "keep_row")
    added = folded.filter("live > 0").mapInArrow(
        _fold, "shard int, digest binary, live long, keep_rank long, keep_row long"
    )
    taken = folded.filter("live < 0").groupBy("shard", "digest").agg(
        F.sum("live").alias("live"), F.max("keep_rank").alias("keep_rank"), F.max("keep_row").alias("keep_row")
    )
    rows = added.unionByName(taken).withColumn("stored", F.lit(False))
    if index is not None:
        rows = rows.unionByName(
            index.select("shard", "digest", "live", "keep_rank", "keep_row").withColumn("stored", F.lit(True))
        )
    return rows.groupBy("shard").applyInArrow(_shard, _INDEX)


def insertions(frame: DataFrame, digest: str, rank: str, row: str) -> DataFrame:
    return frame.select(
        F.unhex(digest).alias("digest"), F.lit(1).cast("long").alias("live"),
        F.col(rank).alias("keep_rank"), F.col(row).alias("keep_row"),
    )


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is an empty text.
    The row with the largest key stays, a null key being the least; of rows with
    equal text and key one stays (which, is fixed within a run). An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = cut(
        docs.select(F.col(key).alias("doc_id"), text_digest(F.col(text)).alias("hex")).select(
            "doc_id", "hex", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("rank"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    shards = shard_count(rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = update_index(None, insertions(rows, "hex", "rank", "row"), shards)
    held = index.select(F.lower(F.hex("digest")).alias("hex"), "live", "keep_rank", "keep_row")
    return rows.join(held, "hex").select(
        F.col("doc_id").alias(key),
        F.when(F.col("keep_rank") != LOWEST, F.col("keep_rank")).alias("keep_id"),
        F.col("live").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("hex").alias("text_sha256"),
    )


def keep_last(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without exact copies, all columns; the same rows stay as in :func:`exact_duplicates`.

    Texts are dealt by (digest, key), so a text that many rows share is spread.
    """
    spark = docs.sparkSession
    hexed, rank, row, number = fresh(docs, "_hex", "_rank", "_row", "_number")
    marked = docs.withColumns(
        {hexed: text_digest(F.col(text)), rank: F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))}
    )
    narrow = cut(marked.select(hexed, rank).withColumn(row, F.lit(0).cast("long")))
    shards = shard_count(narrow.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = update_index(None, insertions(narrow, hexed, rank, row), shards)
    held = index.select(F.lower(F.hex("digest")).alias(hexed), F.col("keep_rank").alias(rank))
    one = Window.partitionBy(hexed, rank).orderBy(rank)
    joined = marked.join(held, [hexed, rank]).withColumn(number, F.row_number().over(one))
    return joined.filter(F.col(number) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
