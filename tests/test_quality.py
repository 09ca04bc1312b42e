"""Expectations, service levels, personal data, dictionary, questions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.functions.text import contains_word, row_hash, strip_code_fences, strip_semicolons
from goldseam.operators import governance, quality
from goldseam.operators.split import dead_letters, dead_rows, flag_rows, valid_rows
from goldseam.plans import ask
from goldseam.spec import Slo


def table(spark):
    return spark.createDataFrame([(1, "a", -1.0), (1, None, 2.0), (2, "b", None), (None, "c", 0.0)], "k int, s string, x double")


def test_expectations(spark):
    tests = [
        quality.not_null("s"), quality.unique("k"), quality.at_least("x"), quality.unique("s"),
        quality.Expectation("holds", condition="k > 0"),
    ]
    got = {r.test_name: (r.status, r.failures) for r in quality.run_expectations(table(spark), "m", tests).collect()}
    assert got == {
        "not_null_s": ("fail", 1), "unique_k": ("fail", 1), "at_least_x": ("fail", 1), "unique_s": ("pass", 0),
        "holds_k > 0": ("pass", 0),
    }
    assert quality.violations(table(spark), quality.at_least("x")).count() == 1


def test_summary_and_gate(spark):
    results = quality.run_expectations(table(spark), "stg_a", [quality.not_null("s"), quality.unique("s")]).unionByName(
        quality.run_expectations(table(spark), "stg_a_b", [quality.unique("s")])
    )
    models = spark.createDataFrame([("stg_a",), ("stg_a_b",), ("stg_c",)], "model string")
    got = {r.model: (r.total, r.passed, r.failed, list(r.failures), r.all_passed, r.gate)
           for r in quality.summarize_tests(results, models).collect()}
    assert got == {
        "stg_a": (2, 1, 1, ["not_null_s"], False, "failed"),
        "stg_a_b": (1, 1, 0, [], True, "passed"),
        "stg_c": (0, 0, 0, [], False, "passed_with_warning"),
    }
    assert quality.run_expectations(table(spark), "m", []).count() == 0


def test_service_levels(spark):
    loads = spark.createDataFrame(
        [("exact", 95, 5), ("above", 949, 51), ("empty", 0, 0), ("few", 9, 0), ("strict", 99, 1)],
        "source_name string, rows_loaded bigint, rows_dead bigint",
    )
    judged = quality.check_slos(loads, {"few": Slo(min_rows=10), "strict": Slo(max_dead_pct=0.5)})
    assert {r.source_name: (r.breach, r.slo_passed) for r in judged.collect()} == {
        "exact": (None, True), "above": ("dead_letter_rate", False), "empty": (None, True),
        "few": ("min_rows", False), "strict": ("dead_letter_rate", False),
    }
    assert quality.check_slos(loads, {}).filter("slo_passed").count() == 4


def test_split_keeps_every_row(spark):
    flagged = flag_rows(table(spark), nullable={"x"})
    assert (valid_rows(flagged).count(), dead_rows(flagged).count()) == (2, 2)
    detail = dead_rows(flagged).withColumn("_rejection_detail", F.lit("d" * 3000))
    letter = dead_letters(detail, "s", "b", F.current_timestamp()).first()
    assert len(letter._error_detail) >= 2000 and len(letter._dl_id) == 36


def test_reconcile_and_values(spark, rows):
    df = table(spark)
    assert tuple(quality.reconcile({"bronze": df, "silver": df.limit(3)}).first()) == (4, 3, False)
    assert rows(quality.unexpected_values(df, "s", ["a"])) == [("b", 1), ("c", 1)]


@pytest.mark.parametrize(
    "name, split, parity",
    [("scorer", True, True), ("player_name", True, False), ("tournament", False, False), ("home address", True, True)],
)
def test_pii_names(name, split, parity):
    assert governance.is_pii_name(name) is split
    assert governance.is_pii_name(name, parity=True) is parity


def test_pii_values(spark):
    texts = ["mail to a.b@c.org, or x@y.co.uk", "call +1 555-123-4567", "a @ b", "1.555.123.45"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: (r.n_email, r.n_phone) for r in governance.count_pii_values(df, "t", ["id"]).collect()}
    assert got == {0: (2, 0), 1: (0, 1)}


def test_schema_difference(spark):
    old, new = T.StructType.fromDDL("a int, b string, c int"), T.StructType.fromDDL("a int, b int, d int")
    got = {(r.column_name, r.change) for r in governance.schema_difference(spark.range(1), old, new).collect()}
    assert got == {("B", "retyped"), ("C", "removed"), ("D", "added")}


def test_retention_keeps_the_last_day(spark):
    at = [dt.datetime(2026, 3, 13), dt.datetime(2026, 3, 12, 23, 59)]
    df = spark.createDataFrame([(x,) for x in at], "_ingested_at timestamp_ntz")
    kept = governance.within_retention(df, F.lit("2026-06-11").cast("timestamp_ntz"))
    assert [r[0] for r in kept.collect()] == at[:1]


STATEMENTS = {
    "": "empty", "  \n": "empty", "select 1": None, " With x as (select 1) select * from x": None,
    "select 1; drop table t": "DROP", "select * from t where updated_at > 1": None, "delete from t": "start",
    "select 1 union delete": "DELETE", "select create, drop from t": "DROP", "selection": "start",
}


def test_sql_audit_and_check_agree(spark):
    df = spark.createDataFrame([(s,) for s in STATEMENTS], "s string")
    assert {r.s: r.v for r in df.select("s", ask.audit_sql(F.col("s")).alias("v")).collect()} == STATEMENTS
    for sql, refused in STATEMENTS.items():
        if refused:
            with pytest.raises(ask.UnsafeSqlError):
                ask.validate_readonly(sql)
        else:
            assert ask.validate_readonly(sql) == sql
    assert ask.run_readonly(spark, "select * from range(9)", rows=5).count() == 5


def test_text_helpers(spark):
    df = spark.createDataFrame([("```sql\nselect 1;; \n```", "The Email of x")], "a string, b string")
    row = df.select(
        strip_code_fences(F.col("a")), strip_semicolons(strip_code_fences(F.col("a"))),
        contains_word(F.col("b"), ["email"]), contains_word(F.col("b"), ["mail"]), F.length(row_hash(["a", "b"])),
    ).first()
    assert tuple(row) == ("select 1;;", "select 1", True, False, 64)


def test_routing_and_evaluation(spark):
    df = spark.createDataFrame([("What TABLES exist?",), ("who won?",)], "q string")
    assert [r[0] for r in df.select(ask.route(F.col("q"))).collect()] == ["metadata", "data"]
    results = spark.createDataFrame(
        [("select * from MART_A", "mart_a", True, 1.0), (None, "mart_a", False, 2.005)],
        "sql string, expected_table string, success boolean, latency_sec double",
    )
    assert tuple(ask.summarize_evaluation(results).first()) == (2, 1, 50.0, 1, 50.0, 1.5)


def test_chart_frame_takes_the_last_number(spark):
    df = spark.createDataFrame([("a", 1, 2.5, "x")], "team string, n int, p double, note string")
    assert tuple(ask.chart_frame(df).first()) == ("a", 2.5)
    with pytest.raises(ValueError):
        ask.chart_frame(df.select("team", "note"))
    with pytest.raises(ValueError):
        ask.chart_frame(df.select("team"))


def test_best_team_is_judged_over_all_tournaments(spark):
    mart = spark.createDataFrame(
        [("one", "t1", 1, 1, 3, 100.0, 0, 1), ("one", "t2", 9, 0, 0, 0.0, 0, -9), ("two", "t1", 10, 8, 24, 80.0, 0, 8)],
        "team string, tournament string, matches_played int, wins int, points int, win_pct double, clean_sheets int,"
        "goal_difference int",
    )
    assert tuple(ask.best_win_pct(mart).first()) == ("two", 80.0)
    assert ask.average_goal_difference(mart).first()[0] == 0.0
    assert len(ask.GOLDEN) == 10
