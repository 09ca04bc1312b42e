"""Database tables: JDBC, and SQLite files through a Python data source."""

from __future__ import annotations

import glob
import os
import sqlite3

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

import goldseam
from goldseam.functions.coerce import coerce_strict
from goldseam.types import declared_type

ROWS_PER_BATCH = 10_000

# Executors get the reader with the plan and need no copy of this package.
cloudpickle.register_pickle_by_value(goldseam)


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, bounds: tuple, partitions: int, **options: str
) -> DataFrame:
    """A table over JDBC in parallel ranges of ``partition_column``."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, **options)
        .options(lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
        .load()
    )


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _mounted(path: str) -> str:
    """The path as the operating system knows it; SQLite reads mounted folders only."""
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"SQLite files must be in a folder that all executors mount, not at {path}")
    return path


def _database_files(path: str) -> list[str]:
    """A file, or the ``.db`` files of a folder; executors must see the same path."""
    path = _mounted(path)
    files = sorted(glob.glob(os.path.join(path, "*.db"))) if os.path.isdir(path) else [path]
    found = [f for f in files if os.path.exists(f)]
    if not found:
        raise ValueError(f"no database at {path}")
    return found


def declared_types(path: str, table: str) -> dict[str, str]:
    """Column types as the table declares them; an unknown table is an error."""
    connection = _connect(_database_files(path)[0])
    try:
        rows = connection.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    finally:
        connection.close()
    if not rows:
        raise ValueError(f"table {table!r} not found or empty in {path}")
    return {r[1]: declared_type(r[2]) for r in rows}


def _stored_as(column: str, kind: str) -> str:
    """The part of coercion that depends on how SQLite stores the single value.

    A stored real in an integer column is cut; a boolean is the truth of the
    value. All else is left to Spark, which gets text.
    """
    c = _quoted(column)
    if kind == "int":
        return f"CASE typeof({c}) WHEN 'real' THEN CAST({c} AS INTEGER) ELSE {c} END"
    if kind == "bool":
        return (
            f"CASE typeof({c}) WHEN 'null' THEN NULL WHEN 'text' THEN iif({c} <> '', '1', '') "
            f"WHEN 'blob' THEN iif(length({c}) > 0, '1', '') ELSE iif({c} <> 0, '1', '') END"
        )
    return c


class RowRange(InputPartition):
    def __init__(self, path: str, low: int | None, high: int | None):
        self.path, self.low, self.high = path, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self):
        """Ranges of row numbers per file, so that a large table is read by many tasks."""
        table, wanted = _quoted(self.options["table"]), int(self.options.get("numpartitions", 8))
        files = _database_files(self.options["path"])
        ranges = []
        for path in files:
            connection = _connect(path)
            try:
                low, high = connection.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
            except sqlite3.OperationalError:  # a table WITHOUT ROWID is one range
                ranges.append(RowRange(path, None, None))
                continue
            finally:
                connection.close()
            if low is None:
                continue
            step = -(-(high - low + 1) // max(1, wanted // len(files)))
            ranges += [RowRange(path, at, min(at + step - 1, high)) for at in range(low, high + 1, step)]
        return ranges or [RowRange(files[0], 0, -1)]

    def read(self, partition: RowRange):
        types = declared_types(partition.path, self.options["table"])
        selected = ", ".join(_stored_as(c, types[c]) for c in self.columns)
        query, bounds = f"SELECT {selected} FROM {_quoted(self.options['table'])}", ()
        if partition.low is not None:
            query, bounds = f"{query} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)
        connection = _connect(partition.path)
        try:
            cursor = connection.execute(query, bounds)
            while rows := cursor.fetchmany(ROWS_PER_BATCH):
                arrays = [pa.array([None if v is None else str(v) for v in c], pa.string()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(arrays, names=self.columns)
        finally:
            connection.close()


class SqliteSource(DataSource):
    """``format("sqlite_table")`` with ``path``, ``table`` and ``numPartitions``; columns come as text."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        types = declared_types(self.options["path"], self.options["table"])
        return ", ".join(f"`{c}` string" for c in types)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema.names)


def read_sqlite_text(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").options(path=path, table=table, numPartitions=partitions).load()


def read_sqlite(
    spark: SparkSession, path: str, table: str, types: dict[str, str] | None = None, partitions: int = 8
) -> DataFrame:
    """A table with the strict database coercion; ``types`` default to the declared ones."""
    declared = declared_types(path, table)
    types = types or declared
    text = read_sqlite_text(spark, path, table, partitions)
    return text.select(*[coerce_strict(F.col(f"`{c}`"), kind).alias(c) for c, kind in types.items()])


def infer_declared(df: DataFrame, declarations: dict[str, str]) -> DataFrame:
    """A text table cast to the types that a database declares for its columns."""
    return df.select(
        *[coerce_strict(F.col(f"`{c}`"), declared_type(kind)).alias(c) for c, kind in declarations.items()]
    )


def write_sqlite_shards(df: DataFrame, folder: str, table: str, declarations: dict[str, str]) -> DataFrame:
    """Write one SQLite file per partition, for handing data to tools that want files.

    A file appears under its final name only when complete, and the name
    depends on the partition alone, so a repeated task replaces its own file.
    Returns the number of rows written per file.
    """
    columns = list(declarations)
    created = ", ".join(f"{_quoted(c)} {kind}" for c, kind in declarations.items())
    inserted = f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' for _ in columns)})"
    root = _mounted(folder)
    os.makedirs(root, exist_ok=True)

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        final = os.path.join(root, f"part-{context.partitionId():05d}.db")
        partial = f"{final}.attempt-{context.taskAttemptId()}"
        connection = sqlite3.connect(partial)
        connection.execute("PRAGMA journal_mode = OFF")
        connection.execute(f"CREATE TABLE {_quoted(table)} ({created})")
        n = 0
        for batch in batches:
            connection.executemany(inserted, zip(*[batch.column(c).to_pylist() for c in columns]))
            n += batch.num_rows
        connection.commit()
        connection.close()
        os.replace(partial, final)
        yield pa.RecordBatch.from_pydict({"file": [os.path.basename(final)], "n_rows": [n]})

    return df.select(*columns).mapInArrow(write, "file string, n_rows bigint")
