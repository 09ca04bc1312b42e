"""Personal-data tags, the data dictionary, schema differences, retention."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.operators.profile import value_counts
from goldseam.spec import RETENTION_DAYS

# Words that mark a column as personal data.
PII_WORDS = ("name", "scorer", "player", "person", "email", "phone", "address")
# Shapes of personal data in values.
PII_SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3,4}[ .-][0-9]{3,4}",
}


def is_pii_name(name: str, parity: bool = False) -> bool:
    """Whether a column name holds a personal-data word.

    ``player_name`` counts, as names are split at ``_``. With ``parity`` the
    underscore is a letter of the word, so that only a bare ``name`` counts.
    """
    pattern = r"\W+" if parity else r"[\W_]+"
    return bool(set(re.split(pattern, name.lower())) & set(PII_WORDS))


def tag_pii_columns(df: DataFrame, parity: bool = False) -> DataFrame:
    """Per column: the tag, and how many values and distinct values it exposes.

    Values are counted per column before they are moved, so one shuffle of
    distinct values serves all columns and a frequent value costs nothing.
    """
    tagged = [c for c in df.columns if is_pii_name(c, parity)]
    counts = value_counts(df, df.columns, trimmed=False)
    return counts.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("value").alias("distinct_values"),
    ).select("column_name", F.col("column_name").isin(*tagged).alias("pii"), "non_null", "distinct_values")


def count_pii_values(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Rows in whose text something has the shape of personal data, with counts per shape."""

    def count(shape: str, pattern: str) -> Column:
        n = F.regexp_count(F.col(text), F.lit(pattern))
        # Most texts have no @ at all, which a plain search finds out faster.
        return F.when(F.contains(F.col(text), F.lit("@")), n).otherwise(0) if shape == "email" else n

    counted = df.select(*keep, *[count(shape, p).alias(f"n_{shape}") for shape, p in PII_SHAPES.items()])
    found = F.greatest(*[F.col(f"n_{shape}") for shape in PII_SHAPES])
    return counted.filter(found > 0)


def dictionary_entries(suggested: DataFrame, model: str, table: str, parity: bool = False) -> DataFrame:
    """Data dictionary of the staging model of a Bronze table, from its suggested tests."""
    column = F.col("column_name")
    # Column names are schema, so the tag is a list of names in the plan.
    words = "|".join(PII_WORDS)
    pii = column.rlike(rf"\b(?:{words})\b") if parity else F.arrays_overlap(
        F.split(column, r"[\W_]+"), F.array(*[F.lit(w) for w in PII_WORDS])
    )
    tests = F.when(F.col("nonnegative"), F.array_append("tests", F.lit("at_least_0"))).otherwise(F.col("tests"))
    return suggested.filter(~column.startswith("_")).select(
        F.lit(model).alias("model"),
        column,
        F.concat(F.lit("Raw "), F.replace(column, F.lit("_"), F.lit(" ")), F.lit(f" from Bronze {table}")).alias(
            "description"
        ),
        tests.alias("tests"),
        pii.alias("pii"),
        F.col("candidate_categorical"),
    )


def replace_models(dictionary: DataFrame, entries: DataFrame, models: list[str]) -> DataFrame:
    """The dictionary with all entries of ``models`` replaced by those of ``entries``, new models added."""
    return dictionary.filter(~F.col("model").isin(*models)).unionByName(entries)


def schema_frame(df: DataFrame, types: T.StructType) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(f.name.upper(), f.dataType.simpleString()) for f in types.fields], "column_name string, data_type string"
    )


def schema_difference(df: DataFrame, current: T.StructType, incoming: T.StructType) -> DataFrame:
    """``(column_name, change, old_type, new_type)``: added, removed and retyped columns."""
    old = schema_frame(df, current).withColumnRenamed("data_type", "old_type")
    new = schema_frame(df, incoming).withColumnRenamed("data_type", "new_type")
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    both = old.join(new, "column_name", "full").withColumn("change", change)
    return both.filter(F.col("change").isNotNull()).select("column_name", "change", "old_type", "new_type")


def within_retention(df: DataFrame, as_of: Column, column: str = "_ingested_at", days: int = RETENTION_DAYS) -> DataFrame:
    """Rows no older than the retention of Bronze; the bound reaches the scan."""
    return df.filter(F.col(column) >= as_of - F.make_dt_interval(F.lit(days)))
