"""Keyed control tables: watermarks, seeds, and the run log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WATERMARK_SCHEMA = (
    "source_name string, last_loaded_at timestamp_ntz, last_batch_id string, rows_loaded bigint, "
    "updated_at timestamp_ntz"
)


def upsert(current: DataFrame, updates: DataFrame, key: str, version: Column) -> DataFrame:
    """The current rows with those of ``updates`` replacing or joining them by key.

    Of several updates of a key, the one with the highest ``version`` wins. An
    update beats a current row whatever its version, as in a merge. Tasks keep
    one row per key before the shuffle.
    """
    columns = current.columns
    tagged = current.select(F.struct(*columns).alias("_row"), key, F.lit(0).alias("_new"), F.lit(None).alias("_v"))
    fresh = updates.select(F.struct(*columns).alias("_row"), key, F.lit(1).alias("_new"), version.alias("_v"))
    return (
        tagged.unionByName(fresh)
        .groupBy(key)
        .agg(F.max_by("_row", F.struct("_new", "_v")).alias("_row"))
        .select("_row.*")
    )


def latest(updates: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """One row per key, that with the highest version; tasks keep one of each before the shuffle."""
    row = F.struct(*updates.columns)
    return updates.groupBy(*keys).agg(F.max_by(row, version).alias("_row")).select("_row.*")


def merge_in_buckets(current: DataFrame, updates: DataFrame, columns: list[str], keys: list[str], bucket: str) -> DataFrame:
    """The rows of some buckets with the updates put in, and ``_change``: inserted, updated, deleted or kept.

    Both sides have the keys' bucket and ``updates`` one row per key and ``_gone``. Rows
    are dealt by bucket, once: grouping by (bucket, key) and writing by bucket then need no
    other shuffle.
    """
    rows = [bucket, *keys]
    tagged = current.select(*rows, F.struct(*columns).alias("_old"), F.lit(None).alias("_new"), F.lit(False).alias("_gone"))
    fresh = updates.select(*rows, F.lit(None).alias("_old"), F.struct(*columns).alias("_new"), "_gone")
    met = tagged.unionByName(fresh).repartition(bucket).groupBy(*rows).agg(
        F.first("_old", ignorenulls=True).alias("_old"), F.first("_new", ignorenulls=True).alias("_new"),
        F.bool_or("_gone").alias("_gone"),
    )
    old, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    change = F.when(F.col("_gone"), F.when(old, "deleted")).when(new & old, "updated").when(new, "inserted").otherwise("kept")
    row = F.coalesce("_new", "_old")
    return met.withColumn("_change", change).filter("_change is not null").select(
        *(row[c].alias(c) for c in columns), bucket, "_change"
    )


def absent_seeds(seeds: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Seed rows whose key the table lacks."""
    return seeds.join(table.select(key), key, "left_anti")


def newer_than(df: DataFrame, column: str, watermark, overlap: dt.timedelta | None = None) -> DataFrame:
    """Rows after the watermark, or all rows where there is none yet.

    ``watermark`` is a value, read from one row of the control table, so the
    comparison is pushed down to the scan. With an ``overlap``, rows that arrive
    late by less than it are found as well, and so are those already loaded:
    :func:`unseen` tells them apart. A row without a time is in no load but the first;
    flag such rows before and keep them as dead letters.
    """
    if watermark is None:
        return df
    return df.filter(F.col(column) > F.lit(watermark if overlap is None else watermark - overlap))


def unseen(df: DataFrame, table: DataFrame, key: str, column: str, watermark, overlap: dt.timedelta) -> DataFrame:
    """Rows whose key the table lacks, where only its rows within the overlap can have them."""
    return df if watermark is None else df.join(newer_than(table, column, watermark, overlap).select(key), key, "left_anti")


def summarize_runs(log: DataFrame) -> DataFrame:
    """Per source: number of runs, outcome of the last one, rows and rejected rows."""
    return log.groupBy("source_name").agg(
        F.count("*").alias("n_runs"),
        F.count_if(F.col("status") == "done").alias("n_done"),
        F.max_by("status", "run_no").alias("last_status"),
        F.sum("rows_ingested").alias("rows_ingested"),
        F.sum("dead_letter_count").alias("dead_letter_count"),
    )
