"""Registered queries on matches and goals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.functions.text import row_hash
from goldseam.jobs.inputs import BUCKETS, GOAL_CHAIN, GOALS, MATCH_CHAIN, MATCHES, PERSPECTIVES, with_inputs
from goldseam.operators.joins import skew_join
from goldseam.operators.quality import Expectation, violations
from goldseam.plans import adapt, ask, gold
from goldseam.plans.silver import LOADED_AT, stage
from goldseam.session import scratch_path
from goldseam.sources.lake import Lake, with_audit

def load_time():
    return F.lit("2026-06-11 00:00:00").cast("timestamp_ntz")


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in Bronze shape: day and scores as text, names in capitals, audit columns."""
    raw = adapt.matches(spark, sf_dir).select(
        F.col("match_date").cast("string").alias("date"),
        F.upper("home_team").alias("home_team"),
        F.upper("away_team").alias("away_team"),
        F.col("home_score").cast("string").alias("home_score"),
        F.col("away_score").cast("string").alias("away_score"),
        F.upper("tournament").alias("tournament"),
        F.concat(F.lit("City of "), F.upper("home_team")).alias("city"),
        F.upper("home_team").alias("country"),
        F.col("neutral").cast("string").alias("neutral"),
    )
    return with_audit(raw, "historical_results", "run-1", load_time())


def performance(spark, sf_dir):
    return gold.mart_team_performance(adapt.matches(spark, sf_dir))


def analytics(spark, sf_dir):
    return gold.mart_goal_analytics(adapt.goals(spark, sf_dir))


def stage_matches(spark, sf_dir):
    return stage(raw_results(spark, sf_dir), "stg_historical_results", load_time()).drop(LOADED_AT)


def stage_shootouts(spark, sf_dir):
    drawn = raw_results(spark, sf_dir).filter(F.col("home_score") == F.col("away_score"))
    odd = F.col("home_score").cast("int") % 2 == 1
    raw = drawn.select(
        "date",
        "home_team",
        "away_team",
        F.when(odd, F.col("home_team")).otherwise(F.col("away_team")).alias("winner"),
        F.when(F.col("neutral") == "true", F.col("home_team")).alias("first_shooter"),
    )
    return stage(raw, "stg_historical_shootouts", load_time()).drop(LOADED_AT)


def raw_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals in Bronze shape; some have no minute, some an impossible day."""
    goals = adapt.table(spark, sf_dir, "events").withColumn("_day", F.date_format("ts", "yyyy-MM-dd"))
    return goals.select(
        F.when(F.col("event_id") % 7 == 0, "2020-02-30").otherwise(F.col("_day")).alias("date"),
        F.concat(F.lit("TEAM_"), (F.col("user_id") % 20).cast("string")).alias("home_team"),
        F.concat(F.lit("TEAM_"), (F.col("user_id") % 19).cast("string")).alias("away_team"),
        F.concat(F.lit("TEAM_"), (F.col("user_id") % 20).cast("string")).alias("team"),
        F.concat(F.lit("User_"), F.col("user_id").cast("string")).alias("scorer"),
        F.when(F.col("value") <= 400, F.floor("value").cast("bigint") % 100).cast("string").alias("minute"),
        (F.col("event_type") == "error").cast("string").alias("own_goal"),
        (F.col("event_type") == "purchase").cast("string").alias("penalty"),
    )


def stage_goals(spark, sf_dir):
    return stage(raw_goals(spark, sf_dir), "stg_historical_goals", load_time()).drop(LOADED_AT)


def minute_bucket(spark, sf_dir):
    bucketed = adapt.goals(spark, sf_dir).withColumn("minute_bucket", gold.minute_bucket(F.col("minute")))
    return bucketed.groupBy("minute_bucket").agg(F.count("*").alias("n_goals"))


def assert_nonnegative(spark, sf_dir):
    """Scores after a deduction of one goal, so that the test has something to find."""
    results = adapt.matches(spark, sf_dir).withColumns(
        {c: F.col(c) - 1 for c in ("home_score", "away_score")}
    )
    rule = Expectation("holds", condition="home_score >= 0 and away_score >= 0")
    return violations(results, rule).select("match_date", "home_team", "away_team", "home_score", "away_score")


def goals_with_results(spark, sf_dir):
    matches = adapt.matches(spark, sf_dir)
    keys = ["match_date", "home_team", "away_team"]
    scored = matches.filter(F.col("home_score") > 0).select(*keys, F.col("home_score").alias("goals"))
    results = matches.groupBy(*keys).agg(
        F.sum("home_score").alias("home_total"), F.sum("away_score").alias("away_total"), F.count("*").alias("n_matches")
    )
    return skew_join(scored, results, keys)


def chart_frame(spark, sf_dir):
    return ask.chart_frame(ask.top_points(performance(spark, sf_dir), 10))


def result_preview(spark, sf_dir):
    return ask.preview(performance(spark, sf_dir).select("team", "tournament", "points"), ["team", "tournament"])


def _lake(spark) -> Lake:
    path = scratch_path(spark, "lake")
    return Lake(spark, path, prefix=path.rsplit("-", 1)[1][:8] + "_")


def sink_full_reload(spark, sf_dir):
    """Load once, load again with other rows, and read: only the second load is there."""
    lake, rows = _lake(spark), adapt.matches(spark, sf_dir)
    lake.ensure("RAW_RESULTS", rows.schema)
    first = with_audit(rows.filter("neutral"), "results", "run-1", load_time())
    lake.reload(first, "RAW_RESULTS")
    lake.reload(with_audit(rows, "results", "run-2", load_time()), "RAW_RESULTS")
    return lake.read("RAW_RESULTS").toDF(*[c.lower() for c in lake.columns("RAW_RESULTS")])


def sink_append_audit(spark, sf_dir):
    """Two appends, each with its own run."""
    lake, rows = _lake(spark), adapt.matches(spark, sf_dir)
    lake.ensure("RAW_RESULTS", rows.schema)
    lake.append(with_audit(rows.filter("neutral"), "results", "run-1", load_time()), "RAW_RESULTS")
    lake.append(with_audit(rows.filter("not neutral"), "results", "run-2", load_time()), "RAW_RESULTS")
    return lake.read("RAW_RESULTS").toDF(*[c.lower() for c in lake.columns("RAW_RESULTS")])


def row_ids(spark, sf_dir):
    """SHA-256 identifiers of raw rows."""
    rows = adapt.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return rows.select("s_suppkey", row_hash(rows.columns).alias("row_id"))


QUERIES = {
    "mart_team_performance": performance,
    "perspective_union": lambda s, d: gold.perspectives(adapt.matches(s, d)),
    "stage_matches": stage_matches,
    "stage_shootouts": stage_shootouts,
    "g_win_pct": lambda s, d: ask.best_win_pct(performance(s, d)),
    "g_top5_points": lambda s, d: ask.top_points(performance(s, d), 5),
    "g_top10_points": lambda s, d: ask.top_points(performance(s, d), 10),
    "g_avg_gd": lambda s, d: ask.average_goal_difference(performance(s, d)),
    "g_clean_sheets": lambda s, d: ask.most_clean_sheets(performance(s, d)),
    "assert_nonnegative": assert_nonnegative,
    "goals_with_results": goals_with_results,
    "chart_frame": chart_frame,
    "result_preview": result_preview,
    "sink_full_reload": sink_full_reload,
    "sink_append_audit": sink_append_audit,
    "row_hash": row_ids,
    "mart_goal_analytics": analytics,
    "minute_bucket": minute_bucket,
    "stage_goals": stage_goals,
    "g_own_goals": lambda s, d: ask.most_own_goals(analytics(s, d)),
    "g_first_half": lambda s, d: ask.most_first_half_goals(analytics(s, d)),
    "g_unique_scorers": lambda s, d: ask.scorers_per_team(analytics(s, d)),
}

_RELOADED = """select *, timestamp '2026-06-11 00:00:00' as _ingested_at, 'results' as _source_name,
  {run} as _pipeline_run_id from matches"""

ORACLE = {
    "mart_team_performance": with_inputs("select * from performance", *MATCH_CHAIN[:3]),
    "perspective_union": with_inputs("select * from perspectives", MATCHES, PERSPECTIVES),
    "stage_matches": with_inputs(
        """select match_date as date, home_team, away_team, cast(home_score as bigint) as home_score,
           cast(away_score as bigint) as away_score, tournament, 'city of ' || home_team as city,
           home_team as country, neutral from matches""",
        MATCHES,
    ),
    "stage_shootouts": with_inputs(
        """select match_date as date, home_team, away_team,
           case when home_score % 2 = 1 then home_team else away_team end as winner,
           case when neutral then home_team end as first_shooter
           from matches where home_score = away_score""",
        MATCHES,
    ),
    "g_win_pct": with_inputs("select team, win_pct from per_team order by win_pct desc, team limit 1", *MATCH_CHAIN),
    "g_top5_points": with_inputs("select team, points from per_team order by points desc, team limit 5", *MATCH_CHAIN),
    "g_top10_points": with_inputs(
        "select team, points from per_team order by points desc, team limit 10", *MATCH_CHAIN
    ),
    "g_avg_gd": with_inputs("select round(avg(goal_difference), 4) as avg_goal_difference from per_team", *MATCH_CHAIN),
    "g_clean_sheets": with_inputs(
        "select team, clean_sheets from per_team order by clean_sheets desc, team limit 1", *MATCH_CHAIN
    ),
    "assert_nonnegative": with_inputs(
        """select match_date, home_team, away_team, home_score - 1 as home_score, away_score - 1 as away_score
           from matches where home_score - 1 < 0 or away_score - 1 < 0""",
        MATCHES,
    ),
    "goals_with_results": with_inputs(
        """select s.match_date, s.home_team, s.away_team, s.home_score as goals, r.home_total, r.away_total, r.n_matches
           from matches s join (
             select match_date, home_team, away_team, cast(sum(home_score) as bigint) as home_total,
                    cast(sum(away_score) as bigint) as away_total, count(*) as n_matches
             from matches group by all) r
           on s.match_date = r.match_date and s.home_team = r.home_team and s.away_team = r.away_team
           where s.home_score > 0""",
        MATCHES,
    ),
    "chart_frame": with_inputs(
        "select team as label, points as value from per_team order by points desc, team limit 10", *MATCH_CHAIN
    ),
    "result_preview": with_inputs(
        "select team, tournament, points from performance order by team, tournament limit 5", *MATCH_CHAIN[:3]
    ),
    "sink_full_reload": with_inputs(_RELOADED.format(run="'run-2'"), MATCHES),
    "sink_append_audit": with_inputs(
        _RELOADED.format(run="case when neutral then 'run-1' else 'run-2' end"), MATCHES
    ),
    "row_hash": """select s_suppkey, sha256(to_json({'s_suppkey': s_suppkey, 's_name': s_name,
                   's_nationkey': s_nationkey, 's_acctbal': s_acctbal})::varchar) as row_id from supplier""",
    "mart_goal_analytics": with_inputs("select * from analytics", *GOAL_CHAIN),
    "minute_bucket": with_inputs(
        "select minute_bucket, count(*) as n_goals from bucketed group by minute_bucket", GOALS, BUCKETS
    ),
    "stage_goals": """
        select cast(ts as date) as game_date, concat('team_', cast(user_id % 20 as varchar)) as home_team,
          concat('team_', cast(user_id % 19 as varchar)) as away_team,
          concat('team_', cast(user_id % 20 as varchar)) as team,
          concat('user_', cast(user_id as varchar)) as scorer,
          cast(floor(value) as bigint) % 100 as minute,
          event_type = 'error' as own_goal, event_type = 'purchase' as penalty
        from events where event_id % 7 <> 0 and value <= 400""",
    "g_own_goals": with_inputs(
        "select team, own_goals_against from analytics order by own_goals_against desc, team limit 1", *GOAL_CHAIN
    ),
    "g_first_half": with_inputs(
        "select team, first_half_goals from analytics order by first_half_goals desc, team limit 1", *GOAL_CHAIN
    ),
    "g_unique_scorers": with_inputs("select team, unique_scorers from analytics", *GOAL_CHAIN),
}
