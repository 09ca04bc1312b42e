"""Questions: read-only check, golden queries, and operators on question logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.functions.text import contains_text

# Statements that are refused, in the order they are reported.
FORBIDDEN = ("DROP", "DELETE", "UPDATE", "ALTER", "TRUNCATE", "INSERT", "MERGE", "CREATE", "GRANT", "REVOKE")
ALLOWED_START = r"(?i)^\s*(WITH|SELECT)\b"
# Wording of a question about the data catalog.
METADATA_SIGNALS = (
    "what tables", "what data", "what columns", "list tables", "what can you", "schema", "metadata", "what fields",
)
# How many earlier turns and how many result rows give context.
CONTEXT_TURNS = 3
PREVIEW_ROWS = 5


class UnsafeSqlError(Exception):
    """A statement that is not plainly read-only."""


def validate_readonly(sql: str | None) -> str:
    """The statement itself, unless :func:`audit_sql` names a reason to refuse it."""
    one = SparkSession.active().createDataFrame([(sql,)], "sql string")
    reason = one.select(audit_sql(F.col("sql"))).first()[0]
    if reason is not None:
        raise UnsafeSqlError(f"refused ({reason}): {sql!r}")
    return sql


def audit_sql(sql: Column) -> Column:
    """Why a logged statement is refused (``empty``, ``start`` or the keyword); null if it is not."""
    empty = sql.isNull() | ~sql.rlike(r"(?U)\S")
    upper = F.upper(sql)
    first_word = F.coalesce(*[F.when(upper.rlike(rf"\b{word}\b"), word) for word in FORBIDDEN])
    return F.when(empty, "empty").when(~sql.rlike(ALLOWED_START), "start").otherwise(first_word)


def run_readonly(spark: SparkSession, sql: str, rows: int | None = None) -> DataFrame:
    """Result of a checked statement over the registered marts.

    Spark's parser has the last word: DESCRIBE QUERY takes one query and nothing else.
    """
    checked = validate_readonly(sql)
    spark.sql(f"DESCRIBE QUERY {checked}")
    result = spark.sql(checked)
    return result if rows is None else result.limit(rows)


def route(question: Column) -> Column:
    """``metadata`` where the wording asks for the catalog, else ``data``."""
    lowered = F.lower(question)
    signals = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(s)) for s in METADATA_SIGNALS])
    return F.when(signals, "metadata").otherwise("data")


def context_line(question: Column, answer: Column) -> Column:
    return F.concat(
        F.lit("Q: "), F.coalesce(question, F.lit("")), F.lit("\nA: "), F.coalesce(answer, F.lit(""))
    )


def summarize_evaluation(results: DataFrame) -> DataFrame:
    """Success, table hits and latency over ``(sql, expected_table, success, latency_sec)``."""
    hit = F.coalesce(contains_text(F.col("sql"), F.col("expected_table")), F.lit(False))
    total, good, hits = F.count("*"), F.count_if("success"), F.count_if(hit)
    return results.agg(
        total.alias("total"),
        good.alias("successes"),
        F.round(F.lit(100.0) * good / total, 0).alias("success_pct"),
        hits.alias("correct_table"),
        F.round(F.lit(100.0) * hits / total, 0).alias("correct_table_pct"),
        F.round(F.avg("latency_sec"), 2).alias("avg_latency_sec"),
    )


def chart_frame(df: DataFrame) -> DataFrame:
    """Label and value of a chart: the first column as text and the last numeric one."""
    if len(df.columns) < 2:
        raise ValueError("a chart needs a label and a value")
    numeric = [f.name for f in df.schema.fields[1:] if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    if not numeric:
        raise ValueError("no numeric column to chart")
    return df.select(F.col(f"`{df.columns[0]}`").cast("string").alias("label"), F.col(f"`{numeric[-1]}`").alias("value"))


def preview(df: DataFrame, order: list[Column | str], rows: int = PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def _top(df: DataFrame, metric: str, k: int, ascending: bool = False) -> DataFrame:
    first = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    name = "team" if "team" in df.columns else "team_name"
    return df.select(name, metric).orderBy(first, name).limit(k)


def _per_team(performance: DataFrame) -> DataFrame:
    """The mart is per team and tournament; questions are about teams."""
    return performance.groupBy("team").agg(
        F.sum("points").alias("points"),
        F.sum("clean_sheets").alias("clean_sheets"),
        F.sum("goal_difference").alias("goal_difference"),
        F.round(F.lit(100.0) * F.sum("wins") / F.sum("matches_played"), 1).alias("win_pct"),
    )


def best_win_pct(performance: DataFrame) -> DataFrame:
    return _top(_per_team(performance), "win_pct", 1)


def most_own_goals(goal_analytics: DataFrame) -> DataFrame:
    return _top(goal_analytics, "own_goals_against", 1)


def youngest_squad(squads: DataFrame) -> DataFrame:
    return _top(squads, "avg_age", 1, ascending=True)


def top_points(performance: DataFrame, k: int) -> DataFrame:
    return _top(_per_team(performance), "points", k)


def most_foreign(squads: DataFrame) -> DataFrame:
    return _top(squads, "legionnaire_pct", 1)


def most_first_half_goals(goal_analytics: DataFrame) -> DataFrame:
    return _top(goal_analytics, "first_half_goals", 1)


def average_goal_difference(performance: DataFrame) -> DataFrame:
    return _per_team(performance).agg(F.round(F.avg("goal_difference"), 4).alias("avg_goal_difference"))


def most_clean_sheets(performance: DataFrame) -> DataFrame:
    return _top(_per_team(performance), "clean_sheets", 1)


def scorers_per_team(goal_analytics: DataFrame) -> DataFrame:
    return goal_analytics.select("team", "unique_scorers")


def most_goalkeepers(squads: DataFrame) -> DataFrame:
    return _top(squads, "goalkeepers", 1)


# The evaluation questions, the mart each is about, and its answer.
GOLDEN = (
    ("Which team has the highest win percentage?", "mart_team_performance", best_win_pct),
    ("Which team scored the most own goals against them?", "mart_goal_analytics", most_own_goals),
    ("Which team has the youngest average squad age?", "mart_squad_profile", youngest_squad),
    ("List the top 5 teams by total points.", "mart_team_performance", lambda mart: top_points(mart, 5)),
    ("Which team has the highest percentage of players at foreign clubs?", "mart_squad_profile", most_foreign),
    ("Which team scored the most goals in the first half?", "mart_goal_analytics", most_first_half_goals),
    ("What is the average goal difference across all teams?", "mart_team_performance", average_goal_difference),
    ("Which team has the most clean sheets?", "mart_team_performance", most_clean_sheets),
    ("How many unique goal scorers does each team have?", "mart_goal_analytics", scorers_per_team),
    ("Which team has the most goalkeepers in their squad?", "mart_squad_profile", most_goalkeepers),
)
