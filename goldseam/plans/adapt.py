"""The driver tables seen as matches, goals, teams and players.

Dimension joins come first, so that the large fact is shuffled as few times as
possible. No side is marked for broadcast: Spark decides by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2026-06-11"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def t(name):
        return table(spark, sf_dir, name)

    nation = t("nation")
    home = nation.select(F.col("n_nationkey").alias("home_key"), F.lower("n_name").alias("home_team"))
    away = nation.select(F.col("n_nationkey").alias("away_key"), F.lower("n_name").alias("away_team"))
    hosts = (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(home, F.col("c_nationkey") == F.col("home_key"))
        .select("o_orderkey", "o_orderdate", "o_orderpriority", "home_key", "home_team")
    )
    guests = (
        t("supplier").join(away, F.col("s_nationkey") == F.col("away_key")).select("s_suppkey", "away_key", "away_team")
    )
    return (
        t("lineitem")
        .join(hosts, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(guests, F.col("l_suppkey") == F.col("s_suppkey"))
        .filter(F.col("home_key") != F.col("away_key"))
        .select(
            F.col("o_orderdate").cast("date").alias("match_date"),
            "home_team",
            "away_team",
            (F.col("l_quantity").cast("int") % 6).alias("home_score"),
            (F.col("l_partkey") % 5).cast("int").alias("away_score"),
            F.lower("o_orderpriority").alias("tournament"),
            (F.col("l_returnflag") == "N").alias("neutral"),
        )
    )


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = (F.floor("value").cast("bigint") % 100).cast("int")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("team_"), (F.col("user_id") % 20).cast("string")).alias("team"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("scorer"),
        F.when(F.col("value") <= 400, minute).alias("minute"),
        (F.col("event_type") == "error").alias("own_goal"),
        (F.col("event_type") == "purchase").alias("penalty"),
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "nation")
        .filter(F.col("n_regionkey") != 0)
        .select(
            F.lower("n_name").alias("team_name"),
            F.col("n_nationkey").cast("string").alias("fifa_code"),
            F.col("n_regionkey").cast("string").alias("group_name"),
        )
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.substring("o_orderpriority", 1, 1)
    position = (
        F.when(rank == "1", "gk").when(rank == "2", "df").when(rank == "3", "mf").when(rank == "4", "fw").otherwise("xx")
    )
    club_country = F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 25).cast("string"))
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("player_id"),
            F.lower("n_name").alias("team_name"),
            position.alias("position"),
            club_country.alias("club_country"),
            F.col("o_orderdate").cast("date").alias("date_of_birth"),
        )
    )
