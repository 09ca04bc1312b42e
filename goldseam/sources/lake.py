"""Bronze, Silver and Gold as catalog tables over folders of parquet files.

Each full write goes to a new folder, and the table is then pointed at it: a
reader sees the old rows or the new ones, a failed write leaves the old table,
and a table can be rewritten from its own rows.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.functions.text import row_hash
from goldseam.operators.governance import within_retention
from goldseam.operators.split import REASON, dead_letters
from goldseam.operators.state import WATERMARK_SCHEMA, absent_seeds, latest, merge_in_buckets, upsert
from goldseam.spec import AUDIT_COLUMNS, DEAD_LETTER_TABLE, LAYERS, RETENTION_DAYS, WATERMARK_TABLE, column_name

AUDIT_SCHEMA = "_ingested_at timestamp_ntz, _source_name string, _pipeline_run_id string"
DEAD_LETTER_SCHEMA = (
    "_dl_id string, _ingested_at timestamp_ntz, _batch_id string, _source string, "
    "_error_type string, _error_detail string, _raw_payload variant"
)
VALID = "_row_valid"
#: Partition columns of tables that are merged by key, and of tables that expire by day.
BUCKET, DAY = "_bucket", "_ingested_on"
_KEYS, _BUCKETS = "goldseam.keys", "goldseam.buckets"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


class SchemaDriftError(Exception):
    """The incoming columns differ from the table and the policy is to halt."""


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


def with_audit(df: DataFrame, source: str, run_id: str, at: Column) -> DataFrame:
    return df.withColumns(dict(zip(AUDIT_COLUMNS, (at, F.lit(source), F.lit(run_id)))))


def with_row_id(df: DataFrame, batch_id: str, at: Column) -> DataFrame:
    """The control columns of contract tables: hash of the row, batch and load time, in front."""
    return df.select(
        row_hash(df.columns).alias("_row_id"), F.lit(batch_id).alias("_batch_id"), at.alias("_ingested_at"), *df.columns
    )


def normalise_columns(df: DataFrame) -> DataFrame:
    """Bronze column names; two columns that become equal are an error."""
    names = [c if c in AUDIT_COLUMNS else column_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide: {names}")
    return df.toDF(*names)


def write_both(rows: DataFrame, flag: str, folder: str, mode: str = "errorifexists") -> None:
    """Write rows into a folder for each of the two values of ``flag``.

    A task keeps a writer open for either; else it would sort all its rows, in memory.
    """
    conf = rows.sparkSession.conf
    writers = conf.get(_WRITERS)
    conf.set(_WRITERS, "2")
    try:
        rows.write.mode(mode).partitionBy(flag).parquet(folder)
    finally:
        conf.set(_WRITERS, writers)


class Lake:
    """Layer databases below one root folder; ``prefix`` separates environments."""

    def __init__(self, spark: SparkSession, root: str, prefix: str = ""):
        self.spark, self.root, self.prefix = spark, root.rstrip("/"), prefix
        for layer in LAYERS:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS `{prefix}{layer}` LOCATION '{self.root}/{layer}'")

    def name(self, table: str, layer: str = "bronze") -> str:
        return f"`{self.prefix}{layer}`.`{table}`"

    def exists(self, table: str, layer: str = "bronze") -> bool:
        return self.spark.catalog.tableExists(f"{self.prefix}{layer}.{table}")

    def read(self, table: str, layer: str = "bronze") -> DataFrame:
        return self.spark.table(self.name(table, layer))

    def columns(self, table: str, layer: str = "bronze") -> list[str]:
        """Columns of the table, none if there is no such table."""
        return self.read(table, layer).columns if self.exists(table, layer) else []

    def _new_folder(self, table: str, layer: str) -> str:
        return f"{self.root}/{layer}/{table}/{uuid.uuid4().hex}"

    def ensure(
        self,
        table: str,
        schema: T.StructType | str,
        audit: bool = True,
        layer: str = "bronze",
        raw: bool = True,
        partition_by: tuple[str, ...] = (),
    ) -> None:
        """Create the table if it is absent; ``raw`` tables get Bronze column names.

        The load time of audited tables has a default, which rows that come without one get.
        """
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        fields = [T.StructField(column_name(f.name) if raw else f.name, f.dataType) for f in schema.fields]
        if audit:
            fields += T.StructType.fromDDL(AUDIT_SCHEMA).fields
        default = {AUDIT_COLUMNS[0]: " DEFAULT localtimestamp()"} if audit else {}
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{default.get(f.name, '')}" for f in fields)
        parts = f"PARTITIONED BY ({', '.join(partition_by)}) " if partition_by else ""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name(table, layer)} ({columns}) USING parquet {parts}"
            f"LOCATION '{self._new_folder(table, layer)}'"
        )

    def apply_drift(self, table: str, schema: T.StructType, policy: str = "add", layer: str = "bronze") -> list[str]:
        """Add the columns the table lacks, or halt if the policy says so."""
        existing = {c.upper() for c in self.columns(table, layer)}
        if not existing:
            return []
        names = {f: column_name(f.name) if layer == "bronze" else f.name for f in schema.fields}
        added = [f for f, name in names.items() if name.upper() not in existing]
        if policy == "halt":
            stored = {f.name.upper(): f.dataType for f in self.read(table, layer).schema.fields}
            here = {name.upper() for name in names.values()}
            removed = [c for c in stored if c not in here and not c.startswith("_")]
            retyped = [f.name for f, name in names.items() if stored.get(name.upper(), f.dataType) != f.dataType]
            if added or removed or retyped:
                raise SchemaDriftError(
                    f"{table}: new columns {[f.name for f in added]}, removed {removed}, retyped {retyped}"
                )
        if added:
            columns = ", ".join(f"`{names[f]}` {f.dataType.simpleString()}" for f in added)
            self.spark.sql(f"ALTER TABLE {self.name(table, layer)} ADD COLUMNS ({columns})")
        return [names[f] for f in added]

    def _aligned(self, df: DataFrame, table: str, layer: str, extra: tuple[Column, ...] = ()) -> DataFrame:
        """Columns in table order and type; one that the rows lack has its default, or else is null."""
        have = {column_name(c): c for c in df.columns}
        if len(have) < len(df.columns):
            raise SchemaDriftError(f"{table}: columns {df.columns} share a table name")

        def field(f: T.StructField) -> Column:
            source = have.get(column_name(f.name))
            default = F.expr(f.metadata["CURRENT_DEFAULT"]) if "CURRENT_DEFAULT" in f.metadata else F.lit(None)
            value = default if source is None else F.col(f"`{source}`")
            return value.cast(f.dataType).alias(f.name)

        return df.select(*[field(f) for f in self.read(table, layer).schema.fields], *extra)

    def point(self, table: str, folder: str, layer: str = "bronze") -> None:
        """Make a written folder the content of the table."""
        self.spark.sql(f"ALTER TABLE {self.name(table, layer)} SET LOCATION '{folder}'")
        self.spark.catalog.refreshTable(self.name(table, layer))

    def reload(self, df: DataFrame, table: str, layer: str = "bronze") -> int:
        """Replace all rows of the table; returns the rows written, counted during the write."""
        folder, seen = self._new_folder(table, layer), Observation()
        counted = self._aligned(df, table, layer).observe(seen, F.count(F.lit(1)).alias("n"))
        counted.write.parquet(folder)
        self.point(table, folder, layer)
        return seen.get["n"]

    def reload_split(self, flagged: DataFrame, table: str, layer: str = "bronze") -> tuple[int, int, str, DataFrame]:
        """Write flagged rows once, valid and rejected ones to folders of their own.

        Returns both counts, the folder of the valid rows (for :meth:`point`,
        once the load is accepted) and the rejected rows as written, under their
        original names. Rows are coerced once, and the valid folder becomes the
        table as it is.
        """
        folder, seen = self._new_folder(table, layer), Observation()
        valid = F.col(REASON).isNull().alias(VALID)
        rows = self._aligned(flagged, table, layer, (F.col(REASON), valid)).observe(
            seen, F.count_if(F.col(VALID)).alias("valid"), F.count_if(~F.col(VALID)).alias("dead")
        )
        write_both(rows, VALID, folder)
        n_valid, n_dead = seen.get["valid"], seen.get["dead"]
        stored = rows.drop(VALID).schema
        nothing = self.spark.createDataFrame([], stored)
        if n_valid == 0:  # the write has made no folder for them
            nothing.write.parquet(f"{folder}/{VALID}=true")
        dead = self.spark.read.schema(stored).parquet(f"{folder}/{VALID}=false") if n_dead else nothing
        names = [c for c in flagged.columns if c != REASON and c not in AUDIT_COLUMNS]
        dead = dead.select(*[F.col(f"`{column_name(c)}`").alias(c) for c in names], REASON)
        return n_valid, n_dead, f"{folder}/{VALID}=true", dead

    def append(self, df: DataFrame, table: str, layer: str = "bronze") -> int:
        """Add rows; returns the rows written."""
        seen = Observation()
        counted = self._aligned(df, table, layer).observe(seen, F.count(F.lit(1)).alias("n"))
        counted.write.insertInto(self.name(table, layer))
        return seen.get["n"]

    def ensure_buckets(self, table: str, schema: T.StructType | str, keys: list[str], buckets: int, layer: str = "silver") -> None:
        """Create a table whose rows are found by ``keys``: each lies in the bucket that its keys' hash names.

        A merge rewrites whole buckets, so there should be so many that one is a few hundred MB.
        """
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        unknown = [k for k in keys if k not in schema.fieldNames()]
        if unknown or buckets < 1:
            raise ValueError(f"{table}: keys {unknown} are no columns, or no buckets ({buckets})")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name(table, layer)} ({columns}, {BUCKET} int) USING parquet "
            f"PARTITIONED BY ({BUCKET}) LOCATION '{self._new_folder(table, layer)}' "
            f"TBLPROPERTIES ({_quoted(_KEYS)} = {_quoted(','.join(keys))}, {_quoted(_BUCKETS)} = '{buckets}')"
        )

    def _properties(self, table: str, layer: str) -> dict[str, str]:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.name(table, layer)}").collect()
        return {r["key"]: r["value"] for r in rows}

    def merge(
        self, updates: DataFrame, table: str, version: Column, layer: str = "silver", deleted: Column | None = None
    ) -> dict[str, int]:
        """Insert, replace or delete rows of a bucketed table by key; returns how many of each, and the buckets written.

        Of several updates of a key the one with the highest ``version`` counts; rows for
        which ``deleted`` holds take the row of their key away. Only buckets that an update
        falls into are read and written, into a new folder; then these buckets are pointed
        at it. So a reader of a bucket sees all of a merge or nothing, one that fails before
        leaves the table as it was, and a merge that is repeated gives the same table.
        """
        properties = self._properties(table, layer)
        keys, buckets = properties[_KEYS].split(","), int(properties[_BUCKETS])
        columns = [c for c in self.read(table, layer).columns if c != BUCKET]
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
        # One row per key, written once: read for the list of buckets and for the merge.
        staged = f"{self._new_folder(table, layer)}-updates"
        latest(updates.withColumn("_gone", gone), keys, version).withColumn(BUCKET, bucket).write.parquet(staged)
        fresh = self.spark.read.parquet(staged)
        touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())
        counts = {"inserted": 0, "updated": 0, "deleted": 0, "buckets": len(touched)}
        if touched:
            current = self.read(table, layer).filter(F.col(BUCKET).isin(touched))
            merged = merge_in_buckets(current, fresh, columns, keys, BUCKET)
            folder, seen = self._new_folder(table, layer), Observation()
            tallies = [F.count_if(F.col("_change") == c).alias(c) for c in ("inserted", "updated", "deleted")]
            kept = merged.observe(seen, *tallies).filter("_change != 'deleted'").drop("_change")
            kept.write.partitionBy(BUCKET).parquet(folder)
            counts |= seen.get
            self._point_buckets(table, layer, touched, folder)
        return counts

    def _point_buckets(self, table: str, layer: str, touched: list[int], folder: str) -> None:
        """Make a folder's buckets those of the table; one that has no rows any more is an empty folder."""
        name = self.name(table, layer)
        known = {r[0] for r in self.spark.sql(f"SHOW PARTITIONS {name}").collect()}
        for at in touched:
            part, place = f"PARTITION ({BUCKET} = {at})", _quoted(f"{folder}/{BUCKET}={at}")
            if f"{BUCKET}={at}" in known:
                self.spark.sql(f"ALTER TABLE {name} {part} SET LOCATION {place}")
            else:
                self.spark.sql(f"ALTER TABLE {name} ADD {part} LOCATION {place}")
        self.spark.catalog.refreshTable(name)

    def ensure_daily(self, table: str, schema: T.StructType | str, audit: bool = True, layer: str = "bronze") -> None:
        """Create a table laid out by the day of load, so that days can expire. Its files belong to the catalog."""
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        fields = [T.StructField(column_name(f.name), f.dataType) for f in schema.fields]
        if audit:
            fields += T.StructType.fromDDL(AUDIT_SCHEMA).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name(table, layer)} ({columns}, {DAY} date) USING parquet PARTITIONED BY ({DAY})"
        )

    def append_daily(self, df: DataFrame, table: str, layer: str = "bronze", column: str = AUDIT_COLUMNS[0]) -> int:
        """Add rows below the day of ``column``; those without a time lie in a part of their own and never expire."""
        seen = Observation()
        rows = self._aligned(df.withColumn(DAY, F.to_date(column)), table, layer)
        # Rows of a day meet in few files, and a day with most of them is spread.
        dealt = rows.observe(seen, F.count(F.lit(1)).alias("n")).hint("rebalance", F.col(DAY))
        dealt.write.insertInto(self.name(table, layer))
        return seen.get["n"]

    def expire_days(self, table: str, as_of: dt.date, days: int = RETENTION_DAYS, layer: str = "bronze") -> list[dt.date]:
        """Drop the days that lie wholly past their retention, and their files; no data is read or rewritten.

        Returns the days dropped. The day on which the retention ends stays until all of it is past.
        """
        name, bound = self.name(table, layer), as_of - dt.timedelta(days=days)
        found = [r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {name}").collect()]
        past = sorted(d for d in found if d != "__HIVE_DEFAULT_PARTITION__" and dt.date.fromisoformat(d) < bound)
        if past:
            parts = ", ".join(f"PARTITION ({DAY} = DATE '{d}')" for d in past)
            self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {parts} PURGE")
            self.spark.catalog.refreshTable(name)
        return [dt.date.fromisoformat(d) for d in past]

    def append_dead_letters(
        self, dead: DataFrame, source: str, run_id: str, at: Column, required: list[str] | None = None
    ) -> int:
        """Keep the rejected rows of a run; a run that is repeated replaces its own rows. Returns their number."""
        keys = ("_source", "_batch_id")
        self.ensure(DEAD_LETTER_TABLE, DEAD_LETTER_SCHEMA, audit=False, raw=False, partition_by=keys)
        seen = Observation()
        letters = self._aligned(dead_letters(dead, source, run_id, at, required=required), DEAD_LETTER_TABLE, "bronze")
        counted = letters.drop(*keys).observe(seen, F.count(F.lit(1)).alias("n"))
        # Any text may be part of a key, so the folder is named by its hash.
        folder = f"{self.root}/bronze/{DEAD_LETTER_TABLE}/{uuid.uuid5(uuid.NAMESPACE_OID, f'{source}/{run_id}').hex}"
        counted.write.mode("overwrite").parquet(folder)
        part = ", ".join(f"{k} = {_quoted(v)}" for k, v in zip(keys, (source, run_id), strict=True))
        table = self.name(DEAD_LETTER_TABLE)
        self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({part}) LOCATION {_quoted(folder)}")
        self.spark.catalog.refreshTable(table)
        return seen.get["n"]

    def watermark(self, source: str):
        """The last load time of a source, or None."""
        if not self.exists(WATERMARK_TABLE):
            return None
        row = self.read(WATERMARK_TABLE).filter(F.col("source_name") == source).select("last_loaded_at").first()
        return row[0] if row else None

    def move_watermark(self, source: str, loaded_at, rows: int, run_id: str, updated_at: Column | None = None) -> None:
        """Insert or replace the watermark of one source."""
        self.ensure(WATERMARK_TABLE, WATERMARK_SCHEMA, audit=False, raw=False)
        update = self.spark.range(1).select(
            F.lit(source).alias("source_name"),
            (loaded_at if isinstance(loaded_at, Column) else F.lit(loaded_at)).cast("timestamp_ntz").alias("last_loaded_at"),
            F.lit(run_id).alias("last_batch_id"),
            F.lit(rows).cast("bigint").alias("rows_loaded"),
            (now() if updated_at is None else updated_at).alias("updated_at"),
        )
        merged = upsert(self.read(WATERMARK_TABLE), update, "source_name", F.col("updated_at"))
        self.reload(merged, WATERMARK_TABLE)

    def seed(self, seeds: DataFrame, table: str, key: str, layer: str = "bronze") -> int:
        """Add the seed rows whose key is absent."""
        return self.append(absent_seeds(seeds, self.read(table, layer), key), table, layer)

    def remove_old_versions(self, table: str, layer: str = "bronze", older_than_hours: float = 24.0) -> int:
        """Delete the folders that earlier full writes have left; no reader may still be using them.

        Younger folders stay, as they may be loads that are written and not yet published.
        Not for partitioned tables. Returns how many were deleted. Only folders are listed,
        no data is read.
        """
        if table == DEAD_LETTER_TABLE:
            raise ValueError("dead letters have no versions")
        before = (time.time() - older_than_hours * 3600) * 1000
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name(table, layer)}")
        current = described.filter("col_name = 'Location'").first()["data_type"]
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{layer}/{table}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        old = [s.getPath() for s in fs.listStatus(folder)
               if s.getPath().getName() not in current.split("/") and s.getModificationTime() <= before]
        return sum(fs.delete(path, True) for path in old)

    def expire(
        self, table: str, as_of: Column, column: str = AUDIT_COLUMNS[0], days: int = RETENTION_DAYS, layer: str = "bronze"
    ) -> int:
        """Rewrite the table without the rows past their retention; returns the rows that stay. Safe to repeat."""
        return self.reload(within_retention(self.read(table, layer), as_of, column, days), table, layer)

    def materialise(self, df: DataFrame, table: str, layer: str, kind: str = "table") -> DataFrame:
        """Publish a model in its layer.

        A frame cannot become a persistent view, and a session's view knows neither layer
        nor prefix, so ``kind="view"`` gives a table as well.
        """
        if not self.exists(table, layer):
            self.ensure(table, df.schema, audit=False, layer=layer, raw=False)
        else:
            self.apply_drift(table, df.schema, layer=layer)
        self.reload(df, table, layer)
        return self.read(table, layer)
