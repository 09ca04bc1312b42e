"""Places within ordered groups, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldseam.llm.common import cut, fresh

#: monotonically_increasing_id() holds the partition above, the place in it below this bit.
_PLACE_BITS = 33


def places(frame: DataFrame, group: str, order: list[str], ranked: bool = False) -> DataFrame:
    """Adds ``at`` (place in the group, from 0), ``n`` (rows of the group) and, if asked for, ``rank`` (of the group), longs.

    Rows are dealt to sorted ranges of (group, order), so a group of any size is
    spread over many tasks; only one row per group and range is joined back. Nulls in
    ``order`` come first; ``group`` must not be null. Rows that tie in all of these
    should be interchangeable: they are dealt freely, so that many of them are spread.
    The frame is read twice and should have been cut.
    """
    tie, spot = fresh(frame, "_tie", "_spot")
    keys = [group, *order, tie]
    tied = frame.withColumn(tie, F.xxhash64(F.monotonically_increasing_id()))
    rows = cut(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(spot, F.monotonically_increasing_id()))
    rows = rows.drop(tie).withColumn("range", F.shiftright(spot, _PLACE_BITS))
    parts = rows.groupBy("range", group).agg(F.min(spot).alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy(group)
    so_far = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(
        parts.withColumn("before", F.coalesce(F.sum("held").over(so_far), F.lit(0)))
        .withColumn("n", F.sum("held").over(whole))
    )
    if ranked:
        parts = parts.join(_ranks(parts, group), group)
    parts = parts.drop("held")
    return (
        rows.join(parts, ["range", group])
        .withColumn("at", F.col(spot) - F.col("first") + F.col("before"))
        .drop(spot, "first", "before", "range")
    )


def _ranks(parts: DataFrame, group: str) -> DataFrame:
    """A group's rank: the groups that begin in earlier ranges, and those before it in its own."""
    begun = parts.filter("before = 0")
    # One row per range.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = begun.groupBy("range").agg(F.count("*").alias("groups")).select(
        "range", F.coalesce(F.sum("groups").over(earlier), F.lit(0)).alias("earlier")
    )
    inside = F.row_number().over(Window.partitionBy("range").orderBy(group)) - 1
    return begun.withColumn("inside", inside).join(F.broadcast(ahead), "range").select(
        group, (F.col("earlier") + F.col("inside")).alias("rank")
    )
