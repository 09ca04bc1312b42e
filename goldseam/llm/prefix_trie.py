"""A trie of conversations that share their first turns, behind a count-min screen.

A prefix is known by 128 bits: two lanes in which the hashes of (depth, turn) are
added without carry, so the prefix above is one operation away and a conversation
of any length can be cut into chunks. All prefixes go through a count-min sketch.
Where it estimates one, the prefix is a proven singleton: its node is written where
it stands. Only prefixes that may be shared are shuffled and grouped exactly, so
what the sketch takes for shared by mistake costs time, never a result.

What a node says of its subtree is summed from its members instead of walking the
trie level by level. A conversation saves the turns at which it is not the least
member, and it stands for a leaf unless its last node has children or a lesser
member; both are sums over its own later turns, and a node adds up those of its
members.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldseam.llm.common import cut, whole
from goldseam.llm.ranges import places

BORROW, BORROWED = 5, 9
SKETCH_ROWS, BLOCK_BITS = 3, 16
#: A sketch row has twice to four times as many cells as there are prefixes, at most 2 ** MAX_BITS: 48 MB for
#: the marks of all rows. Beyond some 200 million prefixes more of them are shuffled; no result depends on it.
MAX_BITS = 27
CHUNK_BITS = 10
FLUSH = 500_000
NODE = ["depth", "p1", "p2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def cells(p1: np.ndarray, p2: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (p1.view(np.uint64) + np.uint64(row) * p2.view(np.uint64)) >> np.uint64(64 - bits)


def _partial(bits: int):
    """A task's own counts, by block of cells: the places counted once and those counted more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            p1, p2 = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            rows, blocks, once, more = [], [], [], []
            for row in range(SKETCH_ROWS):
                found, count = np.unique(cells(p1, p2, row, bits), return_counts=True)
                ids, starts = np.unique(found >> np.uint64(BLOCK_BITS), return_index=True)
                for block, a, b in zip(ids.tolist(), starts, [*starts[1:], len(found)], strict=True):
                    place, many = found[a:b].astype("<u2"), count[a:b] > 1
                    rows.append(row)
                    blocks.append(block)
                    once.append(place[~many].tobytes())
                    more.append(place[many].tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array(blocks, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
                ["row", "block", "once", "more"],
            )

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("p1", "p2")])
            size += batch.num_rows
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _merged(table: pa.Table) -> pa.Table:
    """One bit per cell of a block: counted twice or more."""
    count = np.zeros(1 << BLOCK_BITS, np.uint8)
    for once, more in zip(table["once"], table["more"], strict=True):
        place = np.frombuffer(once.as_buffer(), "<u2")
        count[place] = np.minimum(count[place] + 1, 2)
        count[np.frombuffer(more.as_buffer(), "<u2")] = 2
    marks = np.packbits(count > 1, bitorder="little").tobytes()
    return pa.table({"row": table["row"][:1], "block": table["block"][:1], "marks": pa.array([marks], pa.binary())})


def sketch(prefixes: DataFrame, rows: int, max_bits: int = MAX_BITS) -> tuple[int, np.ndarray]:
    """Cells per sketch row, as bits, and for every cell whether more than one prefix fell on it."""
    bits = min(max((2 * rows).bit_length(), 3), max_bits)
    marks = np.zeros((SKETCH_ROWS, (1 << bits) // 8), np.uint8)
    partial = prefixes.select("p1", "p2").mapInArrow(_partial(bits), "row int, block int, once binary, more binary")
    merged = partial.groupBy("row", "block").applyInArrow(_merged, "row int, block int, marks binary")
    step = min(1 << BLOCK_BITS, 1 << bits) // 8
    for found in merged.toLocalIterator():
        marks[found.row, found.block * step : (found.block + 1) * step] = np.frombuffer(found.marks, np.uint8)[:step]
    return bits, marks


def _screen(bits: int, marks):
    """Marks prefixes that may be shared, and those whose prefix above may be."""

    def shared(p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        seen = np.ones(len(p1), bool)
        for row in range(SKETCH_ROWS):
            cell = cells(p1, p2, row, bits)
            seen &= (marks.value[row, cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, p1, p2, q1, q2 = (batch.column(c).to_numpy() for c in ("depth", "p1", "p2", "q1", "q2"))
            flags = [pa.array(shared(p1, p2)), pa.array((depth == 1) | shared(q1, q2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], [*batch.schema.names, "shared", "above_shared"])

    return run


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the texts of a node in their order; rows come sorted, and only the state of one hash is held."""
    names = ["depth", "p1", "p2", "ends"]

    def row(key, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()), pa.array([state.hexdigest()])],
            names,
        )

    last, state = None, None
    for batch in batches:
        for *key, text in zip(*(batch.column(c).to_pylist() for c in [*NODE, "text"]), strict=True):
            if key != last:
                if last is not None:
                    yield row(last, state)
                last, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if last is not None:
        yield row(last, state)


def _chunk(at: Column) -> Column:
    return F.shiftright(at, CHUNK_BITS)


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv, k borrowed turns, m turns) and their turns (conv, depth from 1, digest, bytes, m).

    The first h turns come from conversation conv - conv % BORROW, h being crc32(conv) % BORROWED.
    """
    role, text = whole(F.col("role")), whole(F.col("text"))
    word = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = cut(
        conversations.filter("conv_id is not null").select(
            F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(word.cast("binary"), 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("bytes"),
        )
    )
    placed = places(turns, "conv", ["turn", "digest"]).drop("turn")
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % BORROWED
    convs = placed.filter("at = 0").select("conv", (F.col("conv") - F.col("conv") % BORROW).alias("base"), taken.alias("h"), "n")
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    sized = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    sized = cut(sized.select("conv", "base", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("m")))
    own = placed.filter(F.col("at") >= taken).join(sized, "conv").select(
        "conv", (F.col("at") - taken + F.col("k") + 1).alias("depth"), "digest", "bytes", "m"
    )
    first = placed.filter(F.col("at") < BORROWED).select(F.col("conv").alias("base"), "at", "digest", "bytes")
    lent = first.join(sized.filter("k > 0"), "base").filter("at < k").select(
        "conv", (F.col("at") + 1).alias("depth"), "digest", "bytes", "m"
    )
    return sized, own.unionByName(lent)


def prefixes(turns: DataFrame) -> DataFrame:
    """Per turn the lanes of the prefix that ends with it (p1, p2) and of the one above (q1, q2)."""
    lanes = turns.select(
        "conv", "depth", "m", "bytes", F.xxhash64(F.lit(1), "depth", "digest").alias("a1"),
        F.xxhash64(F.lit(2), "depth", "digest").alias("a2"), _chunk(F.col("depth") - 1).alias("chunk"),
    )
    so_far = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = cut(lanes.withColumns({"p1": F.bit_xor("a1").over(so_far), "p2": F.bit_xor("a2").over(so_far)}))
    ends = inside.filter((F.col("depth") < F.col("m")) & (F.col("depth") % (1 << CHUNK_BITS) == 0))
    over = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ends.select(
        "conv", (F.col("chunk") + 1).alias("chunk"), F.bit_xor("p1").over(over).alias("b1"), F.bit_xor("p2").over(over).alias("b2")
    )
    later = inside.filter("chunk > 0").join(before, ["conv", "chunk"]).withColumns(
        {"p1": F.col("p1").bitwiseXOR(F.col("b1")), "p2": F.col("p2").bitwiseXOR(F.col("b2"))}
    )
    rows = inside.filter("chunk = 0").unionByName(later.drop("b1", "b2"))
    return rows.select(
        "conv", "depth", "m", "bytes", "p1", "p2", F.col("p1").bitwiseXOR(F.col("a1")).alias("q1"),
        F.col("p2").bitwiseXOR(F.col("a2")).alias("q2"),
    )


def _suffix_sums(rows: DataFrame, names: list[str]) -> DataFrame:
    """Replaces columns by their sums over the conversation's rows of this depth or more, chunk by chunk."""
    rows = rows.withColumn("chunk", _chunk(F.col("depth") - 1))
    inner = Window.partitionBy("conv", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    long = F.col("m") > (1 << CHUNK_BITS)
    summed = {n: F.sum(n).over(inner) for n in names}
    totals = rows.filter(long).groupBy("conv", "chunk").agg(*(F.sum(n).alias(f"_{n}") for n in names))
    behind = Window.partitionBy("conv").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    after = totals.select("conv", "chunk", *(F.coalesce(F.sum(f"_{n}").over(behind), F.lit(0)).alias(f"_{n}") for n in names))
    far = rows.filter(long).withColumns(summed).join(after, ["conv", "chunk"])
    far = far.withColumns({n: F.col(n) + F.col(f"_{n}") for n in names}).select(*rows.columns)
    return rows.filter(~long).withColumns(summed).unionByName(far)


def _ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the conversations that end in a node, ascending and comma-joined; from (node struct, conv)."""
    placed = places(cut(members), "node", ["conv"])
    texts = placed.groupBy("node", _chunk(F.col("at")).alias("chunk")).agg(F.sort_array(F.collect_list("conv")).alias("convs"))
    texts = texts.select(
        *(F.col(f"node.{c}").alias(c) for c in NODE), "chunk",
        F.array_join(F.transform("convs", lambda c: c.cast("string")), ",").alias("text"),
    )
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInArrow(
        _end_hashes, "depth long, p1 long, p2 long, ends string"
    )


def prefix_trie(conversations: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Columns read: conv_id, turn, role, text. A null role or text is empty, a null turn
    comes first; turns of equal number are ordered by the digest of role and text, so
    repeated rows are turns one after another. Rows without a conv_id belong to no
    conversation and are left out. No conversations, no rows: not even a root.
    """
    spark = conversations.sparkSession
    sized, turns = rebuilt_turns(conversations)
    total, least, rows, with_turns = sized.agg(
        F.count("*"), F.min("conv"), F.coalesce(F.sum("m"), F.lit(0)), F.count_if(F.col("m") > 0)
    ).first()
    every = cut(prefixes(turns))
    bits, marks = sketch(every, rows, max_bits)
    types = ", ".join(f"{c} {t}" for c, t in every.dtypes)
    screened = every.mapInArrow(
        _screen(bits, spark.sparkContext.broadcast(marks)), f"{types}, shared boolean, above_shared boolean"
    )
    some = cut(screened.filter("shared or above_shared"))
    shared, heads = some.filter("shared"), some.filter("not shared")

    nodes = cut(
        shared.groupBy(*NODE).agg(
            F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.first("bytes").alias("bytes"),
            F.first("q1").alias("q1"), F.first("q2").alias("q2"),
        )
    )
    above = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    kids = nodes.select(*above).unionByName(heads.select(*above)).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    kids = cut(kids)
    nodes = cut(nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    known = nodes.select(*NODE, "n_children", F.col("conv_id").alias("least"))
    lesser = F.col("least") < F.col("conv")
    stands = (F.col("n_children") == 0) & ~lesser
    weighed = cut(
        shared.join(known, NODE).select(
            "conv", *NODE, "m", F.when(lesser, F.col("bytes")).otherwise(0).alias("saved"),
            F.when((F.col("depth") == F.col("m")) & ~stands, 1).otherwise(0).alias("missing"),
        )
    )
    sums = _suffix_sums(weighed, ["saved", "missing"]).groupBy(*NODE).agg(
        F.sum("saved").alias("saved_tokens"), F.sum("missing").alias("missing")
    )
    ended = shared.filter("depth = m").unionByName(
        sized.filter("m = 0").select("conv", *(F.lit(0).cast("long").alias(c) for c in NODE)), allowMissingColumns=True
    )
    ends = cut(_ends(ended.select(F.struct(*NODE).alias("node"), "conv")))

    saved, missing = weighed.agg(F.coalesce(F.sum("saved"), F.lit(0)), F.coalesce(F.sum("missing"), F.lit(0))).first()
    first_turns = kids.filter("depth = 0").agg(F.coalesce(F.sum("n_children"), F.lit(0))).first()[0]
    root = spark.range(1 if total else 0).select(
        *(F.lit(v).cast("long").alias(c) for c, v in (
            ("depth", 0), ("p1", 0), ("p2", 0), ("conv_id", least), ("parent_conv_id", None), ("n_convs", total),
            ("n_children", first_turns), ("n_leaves", with_turns - missing if first_turns else 1), ("saved_tokens", saved),
        ))
    ).join(ends.filter("depth = 0"), NODE, "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                           F.col("conv_id").alias("parent"))
    by_parent = ["depth", "q1", "q2"]

    def parent(own: str) -> Column:
        # A parent that was not grouped is a proven singleton: it has the same only member.
        return F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.coalesce("parent", own)).alias("parent_conv_id")

    grouped = nodes.join(sums, NODE).join(ends, NODE, "left").join(parents, by_parent, "left").select(
        "conv_id", "depth", parent("conv_id"), "n_convs", "n_children", (F.col("n_convs") - F.col("missing")).alias("n_leaves"),
        "saved_tokens", "ends",
    )
    # Nodes of proven singletons: nothing is looked up for those below the first.
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = [
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", one.alias("n_convs"),
        F.when(F.col("depth") < F.col("m"), one).otherwise(none).alias("n_children"), one.alias("n_leaves"),
        none.alias("saved_tokens"), F.when(F.col("depth") == F.col("m"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).alias("ends"),
    ]
    tops = heads.join(parents, by_parent, "left").withColumn("parent_conv_id", parent("conv")).select(*alone)
    tails = screened.filter("not shared and not above_shared").withColumn("parent_conv_id", F.col("conv")).select(*alone)
    frames = [root.drop("p1", "p2"), grouped, tops, tails]
    return functools.reduce(DataFrame.unionByName, frames).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
