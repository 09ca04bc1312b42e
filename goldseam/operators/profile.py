"""Column facts, and what follows from them: nullability, tests, value catalogs.

All facts come from one long frame ``(column, value, n)``. It is built by
unpivoting and counting, so tasks combine equal values before the shuffle, and
a value that fills a third of the table is one row per task. Two consumers
read that frame (the facts and the short value lists); both have the same
plan up to the shuffle, which Spark therefore runs once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.functions.casts import ratio
from goldseam.functions.coerce import parse_double, strip
from goldseam.operators.sample import bottom_rows
from goldseam.spec import NULLABLE_THRESHOLD

# Thresholds of the reference.
MIN_SAMPLES_FOR_UNIQUE = 10
LISTED_VALUES_MAX = 20
CATEGORICAL_RATIO_MAX = 0.05
CATEGORICAL_MIN_SAMPLES = 20
CATEGORICAL_MIN_DISTINCT = 2
CATALOG_RATIO_MAX = 0.10
CATALOG_VALUES_MAX = 60

CATALOG_SCHEMA = (
    "table_name string, column_name string, distinct_count bigint, total bigint, distinct_values array<string>"
)
NUMERIC_KINDS = ("int", "float")


def value_counts(df: DataFrame, columns: list[str] | None = None, trimmed: bool = True) -> DataFrame:
    """``(column_name, value, n, below_zero)``: how often each text occurs in each column.

    Columns are counted in groups of one type, each group on values of that
    type: a scan per group reads only its own columns, numbers take less room in
    the shuffle than their digits, and only distinct values become text. The
    sign is null for other values than numbers. With ``trimmed``, blank text counts as null.
    """
    groups: dict[T.DataType, list[str]] = {}
    for f in df.schema.fields:
        if columns is None or f.name in columns:
            groups.setdefault(f.dataType, []).append(f.name)
    counted = [_counts_of_one_type(df, names, t, trimmed) for t, names in groups.items()]
    return reduce(DataFrame.unionByName, counted)


def _counts_of_one_type(df: DataFrame, names: list[str], data_type: T.DataType, trimmed: bool) -> DataFrame:
    simple = isinstance(data_type, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))

    def countable(c: str) -> Column:
        value = F.col(f"`{c}`") if simple else F.col(f"`{c}`").cast("string")
        return F.nullif(strip(value), F.lit("")) if trimmed and not simple else value

    wide = df.select(*[countable(c).alias(c) for c in names])
    long = wide.unpivot([], [f"`{c}`" for c in names], "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    below = F.col("value") < 0 if isinstance(data_type, T.NumericType) else F.lit(None).cast("boolean")
    return counts.select("column_name", F.col("value").cast("string").alias("value"), "n", below.alias("below_zero"))


def _listed(counts: DataFrame, few: DataFrame) -> DataFrame:
    """The values of the columns named by ``few``, in order and null last.

    ``few`` keeps the columns with a short list and has at most one row per
    column, so it can be broadcast, and no array is longer than the limit. It is
    an inner join, and all sides use ``n``, so that up to the shuffle this stays
    the plan of the facts: a semi join would be pushed below the counting.
    """
    values = counts.filter(F.col("n") > 0).join(F.broadcast(few.select("column_name")), "column_name")
    in_order = F.array_sort(F.collect_list(F.struct(F.col("value").isNull().alias("last"), "value")))
    return values.groupBy("column_name").agg(F.transform(in_order, lambda e: e["value"]).alias("_values"))


def _columns_frame(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row per column of the table, so that an empty table has a profile too."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("inferred_type")) for c, kind in types.items()]
    return df.sparkSession.range(1).select(F.inline(F.array(*pairs)))


def numeric_kinds(schema: T.StructType) -> dict[str, str]:
    """Inferred-style type names for a typed table."""
    kinds = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.IntegralType):
            kinds[f.name] = "int"
        elif isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
            kinds[f.name] = "float"
        elif isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = "bool"
        else:
            kinds[f.name] = "str"
    return kinds


def profile_columns(df: DataFrame, types: dict[str, str], sample_rows: int | None = None) -> DataFrame:
    """One row of facts per column of ``types``.

    Values are compared as trimmed text, so ``1`` and ``1.0`` are two values. With
    ``sample_rows``, only so many rows count, the same in every run.
    """
    rows = df if sample_rows is None else bottom_rows(df, sample_rows)
    counts = value_counts(rows, list(types))
    present = F.col("value").isNotNull()
    # Text is parsed after the counting: once per distinct value, not per row.
    below = F.coalesce("below_zero", parse_double(F.col("value")) < 0, F.lit(False))
    negative = F.when(present, below)
    facts = counts.groupBy("column_name").agg(
        F.sum("n").alias("_total"),
        F.sum(F.when(present, F.col("n"))).alias("_present"),
        F.count("value").alias("distinct_count"),
        F.bool_or(negative).alias("_negative"),
    )
    listed = _listed(counts, facts.filter((F.col("distinct_count") <= LISTED_VALUES_MAX) & (F.col("_total") > 0)))
    kind = F.col("inferred_type")
    no_values = F.array().cast("array<string>")
    known = (
        _columns_frame(df, types)
        .join(facts, "column_name", "left")
        .join(listed, "column_name", "left")
        .withColumn("sample_count", F.coalesce("_present", F.lit(0)))
        .withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    )
    return known.select(
        "column_name",
        kind,
        ratio(F.col("_total") - F.col("sample_count"), F.col("_total")).alias("null_rate"),
        "distinct_count",
        "sample_count",
        ratio(F.col("distinct_count"), F.col("sample_count")).alias("cardinality_ratio"),
        (
            (F.col("sample_count") >= MIN_SAMPLES_FOR_UNIQUE) & (F.col("distinct_count") == F.col("sample_count"))
        ).alias("is_unique"),
        F.when(kind.isin(*NUMERIC_KINDS), F.col("_negative")).alias("ever_negative"),
        F.when(F.col("distinct_count").between(1, LISTED_VALUES_MAX), F.array_compact("_values"))
        .otherwise(no_values)
        .alias("distinct_values"),
    )


def approximate_profile(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Null rate and approximate distinct counts in one scan, without a shuffle of values."""

    def facts(c: str) -> Column:
        text = F.nullif(strip(F.col(f"`{c}`")), F.lit(""))
        return F.struct(
            F.lit(c).alias("column_name"),
            ratio(F.count_if(text.isNull()), F.count("*")).alias("null_rate"),
            F.count(text).alias("sample_count"),
            F.approx_count_distinct(text).alias("distinct_count"),
        )

    wide = df.agg(*[facts(c).alias(c) for c in types])
    return wide.select(F.inline(F.array(*[F.col(f"`{c}`") for c in types])))


def null_rates(df: DataFrame) -> DataFrame:
    """``(column_name, null_rate)`` in one scan and one aggregate; blank text counts as null."""

    def rate(f: T.StructField) -> Column:
        value = F.col(f"`{f.name}`")
        empty = (F.nullif(strip(value), F.lit("")) if isinstance(f.dataType, T.StringType) else value).isNull()
        return F.struct(F.lit(f.name).alias("column_name"), ratio(F.count_if(empty), F.count("*")).alias("null_rate"))

    wide = df.agg(F.array(*[rate(f) for f in df.schema.fields]).alias("rates"))
    return wide.select(F.inline("rates"))


def nullable_columns(profile: DataFrame) -> DataFrame:
    """Columns too sparse to demand a value of, by their facts or :func:`null_rates`."""
    return profile.filter(F.col("null_rate") > NULLABLE_THRESHOLD).select("column_name", "null_rate")


def suggest_tests(profile: DataFrame) -> DataFrame:
    """``(column_name, tests, nonnegative, candidate_categorical)`` from the facts."""
    tests = F.array_compact(
        F.array(
            F.when(F.col("null_rate") <= NULLABLE_THRESHOLD, F.lit("not_null")),
            F.when(F.col("is_unique"), F.lit("unique")),
        )
    )
    nonnegative = (
        F.col("inferred_type").isin(*NUMERIC_KINDS)
        & F.coalesce(~F.col("ever_negative"), F.lit(False))
        & (F.col("sample_count") > 0)
    )
    categorical = (
        (F.col("inferred_type") == "str")
        & ~F.col("is_unique")
        & (F.col("sample_count") >= CATEGORICAL_MIN_SAMPLES)
        & (F.col("cardinality_ratio") <= CATEGORICAL_RATIO_MAX)
        & (F.col("distinct_count") >= CATEGORICAL_MIN_DISTINCT)
    )
    return profile.select(
        F.lower("column_name").alias("column_name"),
        tests.alias("tests"),
        nonnegative.alias("nonnegative"),
        categorical.alias("candidate_categorical"),
        F.when(categorical, F.col("distinct_values")).alias("categorical_values"),
    )


def without_not_null(suggested: DataFrame, nullable: DataFrame) -> DataFrame:
    """Withdraw ``not_null`` for the columns that are known to be sparse.

    Both sides have one row per column of a table.
    """
    marks = nullable.select(F.lower("column_name").alias("column_name"), F.lit(True).alias("_sparse"))
    kept = F.when(F.col("_sparse"), F.array_remove("tests", "not_null")).otherwise(F.col("tests"))
    return suggested.join(marks, "column_name", "left").withColumn("tests", kept).drop("_sparse")


def categorical_catalog(df: DataFrame, table_name: str, columns: list[str] | None = None) -> DataFrame:
    """Text columns with few values, and these values in order.

    The ratio leaves nulls out, the list of values does not. A table without
    rows yields nothing.
    """
    texts = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.sparkSession.createDataFrame([], CATALOG_SCHEMA)
    counts = value_counts(df, texts, trimmed=False)
    facts = counts.groupBy("column_name").agg(
        F.count("value").alias("distinct_count"), F.sum("n").alias("total")
    )
    few = facts.filter(
        (F.col("total") > 0)
        & (F.col("distinct_count") <= CATALOG_VALUES_MAX)
        & (ratio(F.col("distinct_count"), F.col("total")) <= CATALOG_RATIO_MAX)
    )
    return (
        few.join(_listed(counts, few), "column_name")
        .select(
            F.lit(table_name).alias("table_name"),
            "column_name",
            "distinct_count",
            "total",
            F.col("_values").alias("distinct_values"),
        )
    )


def mart_catalog(spark: SparkSession, database: str, pattern: str = "mart_%") -> DataFrame:
    """Value catalogs of all tables of a database whose name matches, e.g. the marts."""
    tables = spark.sql(f"SHOW TABLES IN `{database}`").filter(F.ilike("tableName", F.lit(pattern)))
    names = sorted(r["tableName"] for r in tables.select("tableName").collect())
    catalogs = [categorical_catalog(spark.table(f"`{database}`.`{n}`"), n) for n in names]
    if not catalogs:
        return spark.createDataFrame([], CATALOG_SCHEMA)
    return reduce(DataFrame.unionByName, catalogs)
