"""Column profiles kept per load and merged, so that a new load reads its own rows only.

One scan of a load gives one row of mergeable facts per column: counts, the sign,
least and greatest value, a distinct-count sketch, and a frequent-item sketch that
holds all values of a column with few of them. Nothing but these rows is shuffled.
Whether values are unique no sketch can tell; columns that look unique in a load
also leave the hashes of their values, by which later loads are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.functions.casts import ratio
from goldseam.functions.coerce import parse_double, strip
from goldseam.operators.profile import LISTED_VALUES_MAX, MIN_SAMPLES_FOR_UNIQUE, NUMERIC_KINDS

#: Items that a frequent-item sketch keeps apart; with no more than FEW distinct values (null is one) it drops none,
#: so that its list and counts are exact.
TRACKED, FEW = 256, 128
#: 2 ** HLL_BITS registers: the distinct count is off by 1.04 / 2 ** (HLL_BITS / 2), 0.8 %, on average.
HLL_BITS = 14
#: A column whose estimate is at least so large a part of its values may be unique.
NEAR_UNIQUE = 0.95

FACTS = (
    "column_name string, inferred_type string, n_rows bigint, present bigint, negative boolean, least string, "
    "greatest string, hll binary, items struct<sketch: binary, maxItemsTracked: int, itemDataType: string, "
    "itemDataTypeDDL: string>"
)


def _text(df: DataFrame, name: str) -> Column:
    """The value as trimmed text, null if blank: what the exact profile compares."""
    kind = df.schema[name].dataType
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0).cast(kind)  # the two zeros are one value
    if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("string")
    return F.nullif(strip(value.cast("string")), F.lit(""))


def column_facts(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row of FACTS per column of ``types``, from one scan and one aggregate without a shuffle of values."""
    texts = df.select(*(_text(df, c).alias(c) for c in types))

    def facts(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        negative = F.bool_or(parse_double(value) < 0) if kind in NUMERIC_KINDS else F.lit(None).cast("boolean")
        items = F.call_function("approx_top_k_accumulate", value, F.lit(TRACKED))
        return F.struct(
            F.lit(name).alias("column_name"), F.lit(kind).alias("inferred_type"), F.count(F.lit(1)).alias("n_rows"),
            F.count(value).alias("present"), negative.alias("negative"), F.min(value).alias("least"),
            F.max(value).alias("greatest"), F.hll_sketch_agg(value, HLL_BITS).alias("hll"), items.alias("items"),
        )

    wide = texts.agg(*(facts(c, kind).alias(f"f{at}") for at, (c, kind) in enumerate(types.items())))
    return wide.select(F.inline(F.array(*(F.col(f"f{at}") for at in range(len(types))))))


def merge_facts(facts: DataFrame) -> DataFrame:
    """The facts of several loads as those of one; a column that a load lacks is missing in its rows."""
    kind = F.when(F.count_distinct("inferred_type") == 1, F.first("inferred_type")).otherwise("str")
    merged = facts.groupBy("column_name").agg(
        kind.alias("inferred_type"), F.sum("n_rows").alias("n_rows"), F.sum("present").alias("present"),
        F.bool_or("negative").alias("negative"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_union_agg("hll").alias("hll"), F.call_function("approx_top_k_combine", F.col("items"), F.lit(TRACKED)).alias("items"),
    )
    return merged


def _estimate() -> Column:
    return F.hll_sketch_estimate("hll")


def _all_items() -> Column:
    return F.call_function("approx_top_k_estimate", F.col("items"), F.lit(FEW))


def near_unique(facts: DataFrame) -> list[str]:
    """Columns that may be unique by their estimate; one row per column comes to the driver."""
    wanted = (F.col("present") >= 1) & (_estimate() >= NEAR_UNIQUE * F.col("present"))
    return sorted(r[0] for r in facts.filter(wanted).select("column_name").collect())


def value_hashes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, h1, h2)``: 128 bits for every value of some columns, nulls and blanks left out."""
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.xxhash64(F.lit(1), _text(df, c)).alias("h1"),
                 F.xxhash64(F.lit(2), _text(df, c)).alias("h2"), _text(df, c).isNotNull().alias("there"))
        for c in columns
    ]
    return df.select(F.inline(F.array(*pairs))).filter("there").drop("there")


class ProfileStore:
    """Facts and value hashes of the loads of one table, below a folder all executors reach.

    ``facts/load=<id>`` has a row per column, ``hashes/load=<id>`` those of its columns
    that look unique. A load that is added again replaces its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, df: DataFrame, load: str, types: dict[str, str]) -> None:
        """Profile the rows of one load; no row of another is read."""
        facts = f"{self.path}/facts/load={load}"
        column_facts(df, types).write.mode("overwrite").parquet(facts)
        columns = near_unique(self.spark.read.schema(FACTS).parquet(facts))
        hashes = value_hashes(df, columns) if columns else self.spark.createDataFrame([], "column_name string, h1 long, h2 long")
        hashes.write.mode("overwrite").partitionBy("column_name").parquet(f"{self.path}/hashes/load={load}")

    def facts(self) -> DataFrame:
        """The merged facts of all loads."""
        return merge_facts(self.spark.read.schema(FACTS).parquet(f"{self.path}/facts"))

    def hashed(self) -> DataFrame:
        """``(column_name, hashed, different)``: how many values left a hash, and how many hashes there are."""
        schema = "column_name string, h1 long, h2 long"
        hashes = self.spark.read.schema(schema).parquet(f"{self.path}/hashes")
        counted = hashes.groupBy("column_name", "h1", "h2").agg(F.count("*").alias("n"))
        return counted.groupBy("column_name").agg(F.sum("n").alias("hashed"), F.count("*").alias("different"))

    def profile(self) -> DataFrame:
        """The columns of :func:`goldseam.operators.profile.profile_columns` over all loads, and ``exact``.

        ``distinct_count`` and ``cardinality_ratio`` are exact for columns with at most FEW
        distinct values and for those that look unique in every load, where ``exact`` is
        true; for others they are estimates. Everything else is exact.
        """
        facts = self.facts()
        listed = _all_items()
        known = (
            facts.join(self.hashed(), "column_name", "left")
            .withColumn("estimate", _estimate())
            .withColumn("listed", F.when(F.col("estimate") < FEW, listed))
        )
        values = F.array_sort(F.filter(F.transform("listed", lambda i: i["item"]), lambda v: v.isNotNull()))
        counted = F.aggregate("listed", F.lit(0).cast("long"), lambda acc, i: acc + i["count"])
        # Hashed values make all of the column's only if it looked unique in every load.
        counted_all = F.coalesce("hashed", F.lit(0)) == F.col("present")
        unique = (F.col("present") >= MIN_SAMPLES_FOR_UNIQUE) & counted_all & (F.col("different") == F.col("present"))
        complete = F.col("listed").isNotNull() & (F.size("listed") < FEW) & (counted == F.col("n_rows"))
        known = known.withColumns(
            {"values": F.when(complete, values), "is_unique": F.coalesce(unique, F.lit(False)), "all_hashed": counted_all}
        )
        distinct = F.when(F.col("all_hashed"), F.coalesce("different", F.lit(0))).otherwise(
            F.coalesce(F.size("values").cast("long"), F.least("estimate", "present"))
        )
        known = known.withColumn("distinct_count", distinct)
        return known.select(
            "column_name", "inferred_type",
            ratio(F.col("n_rows") - F.col("present"), F.col("n_rows")).alias("null_rate"),
            "distinct_count", F.col("present").alias("sample_count"),
            ratio(F.col("distinct_count"), F.col("present")).alias("cardinality_ratio"),
            "is_unique", F.when(F.col("inferred_type").isin(*NUMERIC_KINDS), F.col("negative")).alias("ever_negative"),
            F.when(F.size("values").between(1, LISTED_VALUES_MAX), F.col("values")).otherwise(
                F.array().cast("array<string>")
            ).alias("distinct_values"),
            "least", "greatest", (F.col("all_hashed") | F.col("values").isNotNull()).alias("exact"),
        )
