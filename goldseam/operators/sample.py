"""Samples that are the same rows however the table is cut into files and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bottom_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The ``n`` rows with the least hash of all their values; fewer if there are no more.

    Every task keeps its own least ``n`` and these are merged, so samples of parts can be
    merged too. Rows that are equal share a hash, and rows of equal hash are ordered by
    their values as text; a null is a value like others.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    texts = [c.cast("string") for c in columns]
    least = df.orderBy(F.xxhash64(F.lit(seed), *texts), *texts).limit(n)
    # A generator between: expressions of the caller that slip below the limit would make Spark sort all rows.
    return least.select(F.inline(F.array(F.struct(*columns))))
