"""Column types from the data, and the naming rules that correct them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.functions.coerce import BOOLEAN_WORDS, coerce, parse_double, strip
from goldseam.operators.sample import bottom_rows


#: From here on a whole number may not fit in 64 bits, and up to 38 digits it fits in a wide one.
LONG_LIMIT, WIDE_LIMIT = float(1 << 63), 1e38


def _fold(texts: Column, whole: Column, boolean: Column, size: Column | None = None) -> Column:
    """Narrowest of bool, int, wide (beyond 64 bits), float that all values allow; text if there are none."""
    number = F.bool_and(texts)
    return (
        F.when(F.bool_and(boolean), "bool")
        .when(number & F.bool_and(whole) & (F.lit(False) if size is None else F.max(size) >= LONG_LIMIT), "wide")
        .when(number & F.bool_and(whole), "int")
        .when(number, "float")
        .otherwise("str")
    )


def inspect_columns(
    df: DataFrame, sample_rows: int | None = None, decided: Iterable[str] = ()
) -> DataFrame:
    """``(column_name, inferred_type, null_rate)`` of text columns.

    One scan and one row per column and task shuffled. All rows are looked at;
    ``sample_rows`` looks at so many only, the same in every run (:func:`bottom_rows`). Values of ``decided`` columns
    are not parsed: their type is given as text, for a naming rule to replace.
    """
    rows = df if sample_rows is None else bottom_rows(df, sample_rows)
    texts = rows.select(*[F.nullif(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])
    # One long column keeps the compiled code small however wide the table is.
    long = texts.unpivot([], [f"`{c}`" for c in df.columns], "column_name", "text")
    parsed = long.withColumn("number", F.when(~F.col("column_name").isin(*decided), parse_double(F.col("text"))))
    text, number = F.col("text"), F.col("number")
    present = text.isNotNull()  # a blank or null value says nothing about the type
    whole = number.isNotNull() & (number % 1 == 0)  # not so for nan and the infinities
    inferred = _fold(
        F.when(present, number.isNotNull()),
        F.when(present, whole & (F.abs(number) < WIDE_LIMIT)),
        F.when(present, ~F.col("column_name").isin(*decided) & F.lower(text).isin(*BOOLEAN_WORDS)),
        F.abs(number),
    )
    found = parsed.groupBy("column_name").agg(
        inferred.alias("inferred_type"), F.avg((~present).cast("int")).alias("null_rate")
    )
    # A table without rows has columns too; nothing is known of them but that they are text.
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("column_name"))
    return names.join(found, "column_name", "left").fillna("str", ["inferred_type"]).fillna(0.0, ["null_rate"])


def infer_types(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """``(column_name, inferred_type)`` of text columns."""
    return inspect_columns(df, sample_rows).select("column_name", "inferred_type")


def infer_json_types(df: DataFrame, variant: str) -> DataFrame:
    """``(column_name, inferred_type)`` over the keys of JSON objects.

    JSON values carry types: all boolean -> bool, whole numbers and booleans ->
    int, numbers and booleans -> float, no value -> str, anything else -> str.
    """
    fields = df.select(F.col(variant).alias("_v")).lateralJoin(
        df.sparkSession.tvf.variant_explode(F.col("_v").outer())
    )
    kind = F.schema_of_variant("value")
    present = kind != "VOID"
    boolean = kind == "BOOLEAN"
    whole = boolean | (kind == "BIGINT") | kind.rlike(r"^DECIMAL\([0-9]+,0\)$")
    number = whole | kind.rlike("^(DECIMAL|DOUBLE|FLOAT)")
    inferred = _fold(F.when(present, number), F.when(present, whole), F.when(present, boolean))
    return fields.groupBy(F.col("key").alias("column_name")).agg(inferred.alias("inferred_type"))


def schema_map(inferred: DataFrame) -> dict[str, str]:
    """The inferred types on the driver: one entry per column."""
    return {r["column_name"]: r["inferred_type"] for r in inferred.collect()}


# The naming rules, tried from top to bottom.
DATE_WORDS = ("date", "time", "timestamp", "dt")
DATE_SUFFIXES = ("created_at", "updated_at")
BOOLEAN_PREFIXES = ("is_", "has_", "can_", "should_", "was_", "will_")
BOOLEAN_SUFFIXES = ("_flag", "_active", "_enabled", "_visible", "_deleted")
TEXT_SUFFIXES = ("_id", "_code", "_key", "_ref", "_num", "_no", "_hash", "_uuid")
TEXT_WORDS = (
    "code", "identifier", "reference", "key", "hash", "uuid", "slug",
    "phone", "zip", "postal", "version", "status", "category",
)
FLOAT_WORDS = (
    "price", "amount", "cost", "revenue", "salary", "rate", "ratio", "pct", "percent",
    "latitude", "longitude", "weight", "height", "temperature",
)
INT_WORDS = (
    "count", "qty", "quantity", "num", "number", "rank", "position", "age", "year", "month", "day",
    "score", "goals", "points", "votes",
)
INT_SUFFIXES = ("duration_seconds", "duration_minutes")


def policy_type(name: str, inferred: str) -> str:
    """Type of a column by its name, or the inferred one if no rule speaks.

    Number words are compared with whole parts of the name, so that ``discount`` is
    not taken for a ``count``; text words are looked for anywhere, as in ``zipcode``.
    ``score`` stays a float where it has fractions, and a wide number stays wide. A
    number rule corrects one number type to another; text such as the codes of a
    ``position`` is never forced into a number, which would reject its rows.
    """
    lowered = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
    words = set(re.split(r"[^a-z0-9]+", lowered))
    if words & set(DATE_WORDS) or lowered.endswith(DATE_SUFFIXES):
        return "str"
    if lowered.startswith(BOOLEAN_PREFIXES) or lowered.endswith(BOOLEAN_SUFFIXES):
        return "bool"
    if lowered.endswith(TEXT_SUFFIXES) or any(word in lowered for word in TEXT_WORDS):
        return "str"
    if inferred == "str":
        return "str"
    if words & set(FLOAT_WORDS):
        return "float"
    if words & set(INT_WORDS) or lowered.endswith(INT_SUFFIXES):
        return inferred if inferred == "wide" or (inferred == "float" and "score" in words) else "int"
    return inferred


def decided_by_name(names: Iterable[str]) -> list[str]:
    """The columns whose type follows from their name alone."""
    return [n for n in names if len({policy_type(n, kind) for kind in ("bool", "int", "wide", "float", "str")}) == 1]


def policy_types(df: DataFrame) -> dict[str, str]:
    """Types of text columns by the naming rules; only columns that no rule decides are scanned."""
    decided = decided_by_name(df.columns)
    rest = [c for c in df.columns if c not in decided]
    found = schema_map(infer_types(df.select(*[F.col(f"`{c}`") for c in rest]))) if rest else {}
    return {c: policy_type(c, found.get(c, "str")) for c in df.columns}


def apply_type_policy(types: dict[str, str]) -> dict[str, str]:
    return {name: policy_type(name, kind) for name, kind in types.items()}


def retype(df: DataFrame, types: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Coerce every column of ``types``; other columns are left out but those of ``keep``.

    Stripping is a projection of its own, so that it runs once per value. Numbers of a kind
    are parsed as one array by one expression: written out for every column, the generated
    method would be too long for Java to compile.
    """
    numbered = list(enumerate(types.items()))
    texts = df.select(
        *[F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, (c, _) in numbered],
        *[strip(F.col(f"`{c}`")).alias(f"s{i}") for i, (c, _) in numbered],
        *[F.col(f"`{c}`") for c in keep],
    )
    places = {kind: [i for i, (_, k) in numbered if k == kind] for kind in ("int", "wide", "float")}

    def numbers(kind: str) -> Column:
        return F.transform(F.array(*[F.col(f"s{i}") for i in places[kind]]), lambda text: coerce(text, kind, text))

    parsed = texts.select("*", *[numbers(kind).alias(f"n_{kind}") for kind, at in places.items() if at])

    def value(i: int, kind: str) -> Column:
        return F.get(f"n_{kind}", F.lit(places[kind].index(i))) if kind in places else coerce(F.col(f"v{i}"), kind, F.col(f"s{i}"))

    return parsed.select(*[value(i, kind).alias(c) for i, (c, kind) in numbered], *[F.col(f"`{c}`") for c in keep])
