"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.session import scratch_path, shared_dir

#: A lookup table of at most so many rows is broadcast; beyond that it is joined by a shuffle, where AQE splits hot keys.
SMALL_ROWS = 100_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed once into the shared checkpoint folder, so that lost executors cost no recomputation."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(frame.sparkSession))
    return frame.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever store that is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Tables:
    """Parquet tables in the shared folder that hold an operator's intermediate results.

    Like :func:`cut`, but columns are pruned when they are read, many small parts are
    read by few tasks, and a table can be dropped as soon as what was made of it is
    written. A lost executor costs no recomputation in either.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self.paths: list[tuple[DataFrame, str]] = []

    def put(self, frame: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.label)
        frame.write.parquet(path)
        table = self.spark.read.schema(frame.schema).parquet(path)
        self.paths.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing still to be computed is read from."""
        for table, path in self.paths:
            if any(table is t for t in tables):
                remove(self.spark, path)
        self.paths = [(t, p) for t, p in self.paths if not any(t is d for d in tables)]


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the frame has, whatever their case."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def lookup(frame: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a computed table whose size is checked first; ``small`` should have been cut."""
    fits = small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return frame.join(F.broadcast(small) if fits else small, on, how)


def whole(text: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns' values only."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
