"""Tables whose schema changes: every file is read with the schema it was written in.

A load whose columns differ from those of the table begins a new version: a folder of
its own and one row in the log. Nothing that is stored is rewritten. Reading brings
all versions to the columns of all of them, and each column to the narrowest type
that holds the values of every version.
"""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = "version int, schema string, added string, widened string, written_at timestamp_ntz"
#: From narrow to wide; a type to the right holds what those to its left hold (a double the nearest number).
NUMBERS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DecimalType(38, 0), T.FloatType(), T.DoubleType())
MOMENTS = (T.DateType(), T.TimestampNTZType(), T.TimestampType())


def wider(one: T.DataType, other: T.DataType) -> T.DataType:
    """The narrowest type that takes values of both; text, if nothing else does."""
    if one == other:
        return one
    if T.NullType() in (one, other):
        return other if one == T.NullType() else one
    for ladder in (NUMBERS, MOMENTS):
        if one in ladder and other in ladder:
            return max(one, other, key=ladder.index)
    if isinstance(one, T.DecimalType) and isinstance(other, T.DecimalType):
        scale = max(one.scale, other.scale)
        digits = max(one.precision - one.scale, other.precision - other.scale)
        return T.DecimalType(digits + scale, scale) if digits + scale <= 38 else T.DoubleType()
    numbers = [t for t in (one, other) if isinstance(t, T.NumericType)]
    if len(numbers) == 2:
        whole = next((t for t in numbers if isinstance(t, T.IntegralType)), None)
        decimal = next((t for t in numbers if isinstance(t, T.DecimalType)), None)
        # 19 digits hold any whole number of 64 bits.
        return T.DecimalType(19 + decimal.scale, decimal.scale) if whole and decimal and decimal.scale <= 19 else T.DoubleType()
    return T.StringType()


def merged_schema(schemas: list[T.StructType]) -> T.StructType:
    """All columns, in the order in which they came, each as wide as any version has it; names compare without case."""
    found: dict[str, T.StructField] = {}
    for schema in schemas:
        for field in schema.fields:
            held = found.get(field.name.lower())
            kind = field.dataType if held is None else wider(held.dataType, field.dataType)
            found[field.name.lower()] = T.StructField(field.name if held is None else held.name, kind)
    return T.StructType(list(found.values()))


class VersionedTable:
    """Rows below ``path/rows/v=<n>``, and the log of versions in ``path/log``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        """One row per version, with what it added and widened."""
        self.spark.createDataFrame([], LOG_SCHEMA).write.mode("append").parquet(f"{self.path}/log")
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/log")

    def versions(self) -> list[T.StructType]:
        """The schemas in their order: a row per change of the schema, whatever the data."""
        rows = self.log().select("version", "schema").orderBy("version").collect()
        return [T.StructType.fromJson(json.loads(r["schema"])) for r in rows]

    def append(self, df: DataFrame, at: dt.datetime | None = None) -> tuple[int, int]:
        """Add rows; returns the version they were written in, and their number.

        Columns in another order, or in another case, are no change. A version that an
        earlier one equals is not begun again.
        """
        names = [c.lower() for c in df.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"column names collide: {df.columns}")
        known = self.versions()
        shape = {f.name.lower(): f.dataType for f in df.schema.fields}
        shapes = [{f.name.lower(): f.dataType for f in s.fields} for s in known]
        version = next((n for n, s in enumerate(shapes, 1) if s == shape), len(known) + 1)
        if version > len(known):
            self._begin(df.schema, known, version, at)
        seen = Observation()
        rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("append").parquet(f"{self.path}/rows/v={version}")
        return version, seen.get["n"]

    def _begin(self, schema: T.StructType, known: list[T.StructType], version: int, at: dt.datetime | None) -> None:
        before = {f.name.lower(): f.dataType for f in merged_schema(known).fields}
        after = {f.name.lower(): f.dataType for f in merged_schema([*known, schema]).fields}
        added = ",".join(c for c in after if c not in before)
        widened = ",".join(f"{c}:{before[c].simpleString()}>{t.simpleString()}" for c, t in after.items() if before.get(c, t) != t)
        row = (version, schema.json(), added, widened, at or dt.datetime.now())
        self.spark.createDataFrame([row], LOG_SCHEMA).write.mode("append").parquet(f"{self.path}/log")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of all versions, or of those up to one, in the columns and types these have together."""
        known = self.versions()[:version]
        if not known:
            raise ValueError(f"no such table or version: {self.path}")
        whole = merged_schema(known)

        def seen(number: int, schema: T.StructType) -> DataFrame:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/rows/v={number}")
            have = {f.name.lower(): f.name for f in schema.fields}
            return rows.select(
                *((F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
                  for f in whole.fields)
            )

        return reduce(DataFrame.unionByName, (seen(n, s) for n, s in enumerate(known, 1)))
