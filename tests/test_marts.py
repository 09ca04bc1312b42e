"""Staging models and marts on hand-written rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from goldseam.plans import gold
from goldseam.plans.silver import LOADED_AT, MODELS, capital_columns, snake_case, stage, stage_generic, stage_rules


def results(spark, data):
    return spark.createDataFrame(data, "home_team string, away_team string, home_score int, away_score int, tournament string")


def test_performance_counts_null_scores_as_draws(spark):
    df = results(spark, [("a", "b", 2, 0, "t"), ("b", "a", 1, 1, "t"), ("a", "b", None, 3, "t"), ("a", "c", 0, 4, "t")])
    row = gold.mart_team_performance(df).filter("team = 'a'").first().asDict()
    assert row == {
        "team": "a", "tournament": "t", "matches_played": 4, "wins": 1, "draws": 2, "losses": 1, "win_pct": 25.0,
        "points": 5, "goals_for": 3, "goals_against": 8, "goal_difference": -5, "avg_goals_scored_per_match": 0.75,
        "avg_goals_conceded_per_match": 2.0, "clean_sheets": 1, "failed_to_score": 1, "biggest_win_margin": 2,
        "home_matches": 3, "away_matches": 1, "home_wins": 1, "away_wins": 0,
    }


def test_performance_invariants(spark):
    rng = random.Random(5)
    data = [
        (f"t{rng.randrange(6)}", f"t{rng.randrange(6)}", rng.randrange(5), rng.randrange(5), f"c{rng.randrange(3)}")
        for _ in range(400)
    ]
    mart = gold.mart_team_performance(results(spark, data))
    assert mart.filter("wins + draws + losses != matches_played").isEmpty()
    assert mart.filter("home_matches + away_matches != matches_played").isEmpty()
    balance = mart.groupBy("tournament").agg(F.sum("goal_difference").alias("d"), F.sum("matches_played").alias("n"))
    assert balance.filter("d != 0").isEmpty()
    assert mart.agg(F.sum("matches_played")).first()[0] == 2 * len(data)


def test_minute_buckets(spark):
    minutes = [0, 15, 16, 30, 31, 45, 46, 60, 61, 75, 76, 90, 91, None, -1]
    df = spark.createDataFrame([(m,) for m in minutes], "minute int")
    got = [r[0] for r in df.select(gold.minute_bucket(F.col("minute"))).collect()]
    assert got == [
        "0-15", "0-15", "16-30", "16-30", "31-45", "31-45", "46-60", "46-60", "61-75", "61-75", "76-90", "76-90",
        "90+", "unknown", "unknown",
    ]


def test_goal_analytics(spark):
    df = spark.createDataFrame(
        [("a", "x", 5, False, True), ("a", "x", 95, True, False), ("a", "y", None, False, False), ("a", None, 50, False, False)],
        "team string, scorer string, minute int, own_goal boolean, penalty boolean",
    )
    assert tuple(gold.mart_goal_analytics(df).first()) == ("a", 4, 1, 25.0, 1, 1, 2, 1, 2)


def players(spark):
    return spark.createDataFrame(
        [
            ("a", "GK", "A", dt.date(2000, 12, 31)), ("a", "df", "X", dt.date(1990, 1, 1)), ("a", "MF", None, None),
            ("z", "FW", "Z", dt.date(2001, 5, 5)), ("z", "coach", None, None),
        ],
        "team_name string, position string, club_country string, date_of_birth date",
    )


def test_squad_profile(spark):
    teams = spark.createDataFrame([("a", "A"), ("b", "B")], "team_name string, fifa_code string")
    as_of = F.lit("2026-01-01").cast("date")
    got = {r.team_name: tuple(r)[1:] for r in gold.mart_squad_profile(players(spark), teams, as_of).collect()}
    assert got == {
        "a": (3, 31.0, 26, 36, 1, 1, 1, 0, 1, 33.3),
        "z": (2, 25.0, 25, 25, 0, 0, 0, 1, 0, 0.0),  # a team the table lacks
    }
    literal = gold.mart_squad_profile(players(spark).withColumn("position", F.lower("position")), teams, as_of, parity=True)
    assert literal.agg(F.sum("goalkeepers")).first()[0] == 0


def test_squad_profile_repeats_for_repeated_teams(spark):
    teams = spark.createDataFrame([("a", "A"), ("a", "X")], "team_name string, fifa_code string")
    row = gold.mart_squad_profile(players(spark), teams, F.lit("2026-01-01").cast("date")).filter("team_name = 'a'").first()
    assert (row.squad_size, row.players_at_foreign_clubs) == (6, 2)


def test_staging_drops_audit_columns_and_rows_with_nulls(spark):
    bronze = spark.createDataFrame(
        [("2026-06-11", "A", "B", "A", "X", "9", "true", "false", "s"), ("no day", "A", "B", "A", "X", "9", "t", "f", "s")],
        "DATE string, HOME_TEAM string, AWAY_TEAM string, TEAM string, SCORER string, MINUTE string, OWN_GOAL string,"
        "PENALTY string, _source_name string",
    )
    staged = stage(bronze, "stg_historical_goals")
    assert staged.columns == [*MODELS["stg_historical_goals"].names, LOADED_AT]
    assert [tuple(r)[:-1] for r in staged.collect()] == [
        (dt.date(2026, 6, 11), "a", "b", "a", "x", 9, True, False)
    ]


def test_one_bad_number_fails_the_model(spark):
    bronze = spark.createDataFrame(
        [("2026-06-11", "A", "B", "A", "X", "90+2", "true", "false")],
        "date string, home_team string, away_team string, team string, scorer string, minute string, own_goal string,"
        "penalty string",
    )
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        stage(bronze, "stg_historical_goals").collect()


def test_generic_and_rule_driven_staging(spark):
    bronze = spark.createDataFrame(
        [("2026-06-11", "2026-06-11 10:00:00", 1, "ABC", "Ab", "s"), ("x", "x", 0, "D", "c", "s")],
        "`Match Date` string, createdAt string, IS_OPEN int, CODE string, note string, _source_name string",
    )
    assert stage_generic(bronze).columns == ["match date", "createdat", "is_open", "code", "note", LOADED_AT]
    assert capital_columns(bronze) == ["CODE"]
    staged = stage_rules(bronze, ["CODE"])
    assert [tuple(r)[:-1] for r in staged.collect()] == [
        (dt.date(2026, 6, 11), dt.datetime(2026, 6, 11, 10), True, "abc", "Ab"), (None, None, False, "d", "c"),
    ]


@pytest.mark.parametrize(
    "name, expected", [("orderDate", "order_date"), ("Order Date", "order_date"), ("ORDER_DATE", "order_date"), ("x1Y", "x1_y")]
)
def test_snake_case(name, expected):
    assert snake_case(name) == expected
