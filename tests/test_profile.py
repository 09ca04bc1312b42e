"""Type inference, column facts and what is suggested from them."""

import datetime as dt
import decimal
import typing

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.operators import infer, profile
from goldseam.types import contract_schema, declared_type, inferred_schema


def test_inference_precedence(spark):
    df = spark.createDataFrame(
        [("1", "1", "1.5", "x", "", "nan", "1_000", "3.0"), ("0", "2", "2", "1", " ", "1", "7", "4"), (None,) * 8],
        "flag string, whole string, part string, mixed string, none string, odd string, grouped string, dotted string",
    )
    assert infer.schema_map(infer.infer_types(df)) == {
        "flag": "bool", "whole": "int", "part": "float", "mixed": "str", "none": "str", "odd": "float",
        "grouped": "int", "dotted": "int",
    }


def test_inference_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert infer.schema_map(infer.infer_types(df)) == {"a": "str", "b": "str"}


def test_inference_may_look_at_first_rows_only(spark):
    df = spark.createDataFrame([("1",)] * 3 + [("x",)] * 2, "a string").coalesce(1)
    assert infer.schema_map(infer.infer_types(df, sample_rows=3)) == {"a": "bool"}
    assert infer.schema_map(infer.infer_types(df)) == {"a": "str"}


def test_json_inference(spark):
    lines = [
        '{"a": 1, "b": true, "c": 1.5, "d": null, "e": 1, "f": 12345678901234567890, "g": {"x": 1}}',
        '{"a": 2, "b": false, "c": 2, "e": "x", "f": 1}',
        '{"a": true, "c": false}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "j string").select(F.parse_json("j").alias("v"))
    assert infer.schema_map(infer.infer_json_types(df, "v")) == {
        "a": "int", "b": "bool", "c": "float", "d": "str", "e": "str", "f": "int", "g": "str",
    }


@pytest.mark.parametrize(
    "name, inferred, expected",
    [
        ("match_num", "int", "str"), ("order_id", "int", "str"), ("zip", "int", "str"), ("zipcode", "int", "str"), ("customerId", "int", "str"), ("status_code", "int", "str"),
        ("created_at", "int", "str"), ("match_date", "int", "str"), ("is_open", "int", "bool"), ("sold_flag", "int", "bool"),
        ("unit_price", "int", "float"), ("goals", "float", "int"), ("home_score", "bool", "int"),
        ("home_score", "float", "float"), ("discount", "float", "float"), ("duration_seconds", "float", "int"),
        ("city", "str", "str"), ("position", "str", "str"), ("position", "float", "int"), ("neutral", "bool", "bool"),
    ],
)
def test_type_policy(name, inferred, expected):
    assert infer.policy_type(name, inferred) == expected


def facts(spark, values, kind="str"):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return profile.profile_columns(df, {"c": kind})


def test_null_rate_at_the_threshold(spark):
    exact = facts(spark, [""] + ["x"] * 19)
    assert exact.first()["null_rate"] == 0.05
    assert profile.nullable_columns(exact).count() == 0
    above = facts(spark, ["", " "] + ["x"] * 18)
    assert profile.nullable_columns(above).count() == 1


@pytest.mark.parametrize("n, is_unique", [(9, False), (10, True)])
def test_unique_needs_ten_values(spark, n, is_unique):
    assert facts(spark, [f"v{i}" for i in range(n)]).first()["is_unique"] is is_unique


@pytest.mark.parametrize("n, listed", [(20, 20), (21, 0)])
def test_value_list_is_bounded(spark, n, listed):
    row = facts(spark, [f"v{i:02d}" for i in range(n)] * 2 + [None]).first()
    assert row["distinct_count"] == n
    assert list(row["distinct_values"]) == [f"v{i:02d}" for i in range(listed)]


def test_texts_are_compared_as_texts(spark):
    row = facts(spark, ["1", "1.0", " 1 ", "-2", "x"], "int").first()
    assert (row["distinct_count"], row["sample_count"], row["ever_negative"]) == (4, 5, True)


def test_profile_of_an_empty_table(spark):
    row = facts(spark, []).first()
    assert (row["null_rate"], row["distinct_count"], row["sample_count"], row["is_unique"]) == (0.0, 0, 0, False)
    assert row["ever_negative"] is None


def suggestion(spark, values, kind="str"):
    return profile.suggest_tests(facts(spark, values, kind)).first()


def test_categorical_limits(spark):
    assert suggestion(spark, ["a", "b"] * 20)["candidate_categorical"]  # ratio exactly 5 %
    assert not suggestion(spark, ["a", "b"] * 19)["candidate_categorical"]
    assert not suggestion(spark, ["a"] * 40)["candidate_categorical"]
    assert not suggestion(spark, ["a"] * 19)["candidate_categorical"]


def test_suggested_tests(spark):
    row = suggestion(spark, [str(i) for i in range(12)], "int")
    assert (list(row["tests"]), row["nonnegative"]) == (["not_null", "unique"], True)
    assert not suggestion(spark, ["-1", "2"], "int")["nonnegative"]
    assert not suggestion(spark, [], "int")["nonnegative"]


def test_not_null_is_withdrawn_for_sparse_columns(spark):
    suggested = profile.suggest_tests(facts(spark, ["a"] * 30))
    sparse = spark.createDataFrame([("C", 0.5)], "column_name string, null_rate double")
    assert profile.without_not_null(suggested, sparse).first()["tests"] == []


def test_catalog_lists_null_but_does_not_count_it(spark):
    df = spark.createDataFrame([("a",)] * 15 + [("b",)] * 10 + [(None,)] * 5, "c string")
    row = profile.categorical_catalog(df, "t").first()
    assert (row["distinct_count"], row["total"], list(row["distinct_values"])) == (2, 30, ["a", "b", None])
    many = spark.createDataFrame([(f"v{i % 61}",) for i in range(1000)], "c string")
    assert profile.categorical_catalog(many, "t").count() == 0
    sixty = spark.createDataFrame([(f"v{i % 60}",) for i in range(1000)] + [(None,)], "c string")
    assert len(profile.categorical_catalog(sixty, "t").first()["distinct_values"]) == 61


def test_catalog_of_all_marts(spark, lake):
    rows = spark.createDataFrame([("a", 1)] * 15 + [("b", 2)] * 15, "team string, n int")
    lake.materialise(rows, "mart_one", "gold")
    lake.materialise(rows, "other", "gold")
    lake.materialise(rows.select("n"), "mart_numbers", "gold")
    got = profile.mart_catalog(spark, f"{lake.prefix}gold").collect()
    assert [(r.table_name, r.column_name, list(r.distinct_values)) for r in got] == [("mart_one", "team", ["a", "b"])]
    assert profile.mart_catalog(spark, f"{lake.prefix}silver").count() == 0


def test_typed_columns_are_counted_by_type(spark):
    df = spark.createDataFrame([(1, 1.5, "a", True), (1, 2.5, "b", None)], "i int, d double, s string, b boolean")
    got = {(r.column_name, r.value, r.n) for r in profile.value_counts(df).collect()}
    assert got == {
        ("i", "1", 2), ("d", "1.5", 1), ("d", "2.5", 1), ("s", "a", 1), ("s", "b", 1), ("b", "true", 1), ("b", None, 1),
    }


def test_approximate_profile(spark):
    df = spark.createDataFrame([(str(i % 7),) for i in range(100)], "c string")
    row = profile.approximate_profile(df, {"c": "int"}).first()
    assert (row["null_rate"], row["sample_count"], row["distinct_count"]) == (0.0, 100, 7)


def test_type_maps():
    class Contract:
        a: int
        b: typing.Optional[float]
        c: dt.datetime | None
        d: decimal.Decimal
        e: dict
        f: object

    types = {f.name: f.dataType.simpleString() for f in contract_schema(Contract).fields}
    assert types == {
        "a": "bigint", "b": "double", "c": "timestamp_ntz", "d": "decimal(38,9)", "e": "variant", "f": "string",
    }
    assert [declared_type(x) for x in ("VARCHAR(20)", "bigint", "DECIMAL (10,2)", "geometry")] == [
        "str", "int", "float", "str",
    ]
    schema = inferred_schema({"a": "int", "b": "str"}, {"b"})
    assert [(f.dataType, f.nullable) for f in schema.fields] == [(T.LongType(), False), (T.StringType(), True)]


def test_numbers_beyond_64_bits_are_wide_and_kept(spark):
    values = ["1", "98765432109876543210"]
    df = spark.createDataFrame([(v, "7") for v in values], "big string, small string")
    types = {r.column_name: r.inferred_type for r in infer.infer_types(df).collect()}
    assert types == {"big": "wide", "small": "int"}
    got = infer.retype(df, types)
    assert got.schema["big"].dataType.simpleString() == "decimal(38,0)"
    assert sorted(int(r.big) for r in got.collect()) == [int(v) for v in values]


def test_null_rates_agree_with_the_profile(spark, rows):
    df = spark.createDataFrame([(1, " ", None), (None, "x", -0.5), (3, None, 2.0), (4, "y", 1.0)], "a int, b string, c double")
    full = profile.profile_columns(df, profile.numeric_kinds(df.schema))
    assert rows(profile.null_rates(df)) == rows(full, "column_name", "null_rate")
    assert rows(full, "column_name", "ever_negative") == [("a", False), ("b", None), ("c", True)]
    assert rows(profile.null_rates(df.limit(0))) == [("a", 0.0), ("b", 0.0), ("c", 0.0)]


def test_wide_numbers_stay_wide_and_named_columns_are_not_parsed(spark):
    assert infer.policy_type("goals", "wide") == "wide" and infer.policy_type("goals", "float") == "int"
    assert infer.decided_by_name(["order_id", "goals", "is_open", "note", "match_date"]) == ["order_id", "is_open", "match_date"]
    df = spark.createDataFrame([("1", "98765432109876543210", "7")], "order_id string, goals string, note string")
    assert infer.policy_types(df) == {"order_id": "str", "goals": "wide", "note": "int"}
