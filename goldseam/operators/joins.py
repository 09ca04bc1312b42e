"""Joins and numbering that stay balanced when one key holds much of the data."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldseam.session import scratch_path

# A key with more rows than this is spread over several tasks.
ROWS_PER_SPLIT = 2_000_000


def hot_keys(df: DataFrame, keys: list[str], rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """All keys with too many rows for one task, null ones too, and the splits each needs.

    Tasks count before the shuffle. There are fewer such keys than rows / rows_per_split.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > rows_per_split)
        .select(*keys, F.ceil(F.col("_n") / rows_per_split).cast("int").alias("_splits"))
    )


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Inner or left equi-join where single keys of ``left`` may be huge.

    ``right`` should be unique per key, or nearly. Rows whose key is not huge are joined
    as they are. Those of a huge key are first counted by all their values, so that equal
    rows are joined once, and get a split number from their values, so a task that runs
    again deals them out alike; the matching rows of ``right`` are copied once per split.
    Last, counted rows are dealt out in lots and written out again. (AQE cannot split this
    join itself where ``right`` is an aggregate by the same keys.) Keys are counted when
    this is called; where none is huge, which is usual, that is all there is to it.
    """
    path = scratch_path(left.sparkSession, "hot-keys")
    hot_keys(left, keys, rows_per_split).write.parquet(path)
    hot = left.sparkSession.read.parquet(path)
    if hot.isEmpty():
        return left.join(right, keys, how)
    named = hot.toDF(*[f"_hot{i}" for i in range(len(keys))], "_splits")
    same = reduce(operator.and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"_hot{i}")) for i, k in enumerate(keys)])
    mine = [F.col(f"`{c}`") for c in left.columns]
    plain = left.join(named, same, "left_anti").join(right, keys, how)

    counted = left.join(named, same).groupBy(*left.columns, "_splits").agg(F.count("*").alias("_n"))
    split = F.pmod(F.xxhash64(*mine), F.col("_splits")).cast("int").alias("_split")
    copied = right.join(named, same).select(
        *right.columns, F.explode(F.sequence(F.lit(0), F.col("_splits") - 1)).alias("_split")
    )
    met = counted.select(*mine, "_n", split).join(copied, [*keys, "_split"], how).drop("_split")
    lots = met.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / rows_per_split))))
    # Rows that occur once, as most do, are their only lot; the shuffle is of joined rows of huge keys.
    size = F.least(F.lit(rows_per_split), F.col("_n") - F.col("_lot") * rows_per_split).cast("int")
    spread = lots.repartition(*[f"`{c}`" for c in left.columns], "_lot").withColumn("_copy", F.explode(F.sequence(F.lit(1), size)))
    return plain.unionByName(spread.drop("_n", "_lot", "_copy"))


def orphan_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Keys of ``child`` that ``parent`` lacks, with their number of rows; null keys pass.

    Counting first leaves one row per key to be joined, whatever the skew.
    """
    keys = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))
    return keys.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def _blocks(df: DataFrame, order: list[str], blocks: int | None) -> DataFrame:
    """Rows sorted into ranges of about equal size, as a table in the shared folder.

    Writing fixes the range each row is in, so that later reads (also those
    after a lost executor) see the same blocks.
    """
    ranged = df.repartitionByRange(blocks, *order) if blocks else df.repartitionByRange(*order)
    path = scratch_path(df.sparkSession, "ranges")
    (
        ranged.sortWithinPartitions(*order)
        .withColumn("_block", F.spark_partition_id())
        # The lower 33 bits are the position in the partition.
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .write.parquet(path)
    )
    return df.sparkSession.read.parquet(path)


def running_number(df: DataFrame, order: list[str], name: str, blocks: int | None = None) -> DataFrame:
    """Number all rows from 1 in ``order`` without bringing them into one task.

    Rows are numbered in each range; the sizes of the ranges (one row each)
    give the number every range starts at.
    """
    ranged = _blocks(df, order, blocks)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_block")
        .agg(F.count("*").alias("_n"))
        .select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    # One row per range: bounded by the number of partitions, not by the data.
    return ranged.join(F.broadcast(starts), "_block").select(
        *df.columns, (F.col("_start") + F.col("_pos") + 1).alias(name)
    )


def preceding_context(
    df: DataFrame, key: str, order: str, line: Column, depth: int, name: str, blocks: int | None = None
) -> DataFrame:
    """Add the ``depth`` lines before each row of its ``key``, joined with newlines; null is a key like others.

    The table is cut into sorted ranges, so that no key, however large, is one task.
    """
    return _context_by_range(df.withColumn("_line", line), key, order, depth, name, blocks).select(*df.columns, name)


def _context_by_range(
    rows: DataFrame, key: str, order: str, depth: int, name: str, blocks: int | None = None
) -> DataFrame:
    """The window runs per key and range; each range starts with lines of the ranges before it."""
    ranged = _blocks(rows, [key, order], blocks)
    # One row per range, so this table and what is derived from it stay small:
    # it is bounded by the number of partitions.
    edges = (
        ranged.groupBy("_block")
        .agg(
            F.count("*").alias("_n"),
            F.min_by(key, "_pos").alias("_first"),
            F.max_by(key, "_pos").alias("_last"),
        )
        .withColumn("_nth", F.row_number().over(Window.orderBy("_block")))
    )
    # The last lines of a range, if they belong to the key the range ends with.
    tails = (
        ranged.join(F.broadcast(edges), "_block")
        .filter((F.col("_pos") >= F.col("_n") - depth) & F.col(key).eqNullSafe(F.col("_last")))
        .select(F.col("_last").alias("_first"), "_nth", "_pos", "_line")
    )
    # No range is empty, so ``depth`` ranges back hold ``depth`` lines of the key.
    steps = F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("_step")
    carried = (
        tails.select("*", steps)
        .withColumn("_nth", F.col("_nth") + F.col("_step"))
        .join(
            F.broadcast(edges.select(F.col("_first").alias("_head"), F.col("_nth").alias("_at"), "_block")),
            F.col("_first").eqNullSafe(F.col("_head")) & (F.col("_nth") == F.col("_at")),
        )
        .select(F.col("_first").alias(key), "_block", "_pos", "_line", (-F.col("_step")).alias("_step"))
    )
    both = ranged.withColumn("_step", F.lit(0)).unionByName(carried, allowMissingColumns=True)
    window = Window.partitionBy(key, "_block").orderBy("_step", "_pos").rowsBetween(-depth, -1)
    context = F.array_join(F.collect_list("_line").over(window), "\n")
    return both.withColumn(name, context).filter(F.col("_step") == 0)
