"""The three marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.functions.casts import calendar_years, percentage

# The intervals of a match, their halves, and the positions.
MINUTE_BUCKETS = ((0, 15), (16, 30), (31, 45), (46, 60), (61, 75), (76, 90))
FIRST_HALF = ("0-15", "16-30", "31-45")
SECOND_HALF = ("46-60", "61-75", "76-90", "90+")
POSITIONS = {"goalkeepers": "GK", "defenders": "DF", "midfielders": "MF", "forwards": "FW"}


def perspectives(results: DataFrame) -> DataFrame:
    """Each match as seen by the home and by the away team.

    Both rows come from one array per match, so the input is read once.
    """

    def seen_by(venue: str, team: str, own: str, other: str) -> Column:
        return F.struct(
            F.col(team).alias("team"),
            F.col(own).alias("goals_for"),
            F.col(other).alias("goals_against"),
            F.lit(venue).alias("venue"),
        )

    sides = F.array(
        seen_by("home", "home_team", "home_score", "away_score"),
        seen_by("away", "away_team", "away_score", "home_score"),
    )
    others = [c for c in ("tournament", "date", "match_date") if c in results.columns]
    return results.select(*others, F.inline(sides)).withColumn("result", outcome("goals_for", "goals_against"))


def outcome(goals_for: str, goals_against: str) -> Column:
    """win, loss, or else draw; an unknown score is a draw."""
    gf, ga = F.col(goals_for), F.col(goals_against)
    return F.when(gf > ga, "win").when(gf < ga, "loss").otherwise("draw")


def mart_team_performance(results: DataFrame) -> DataFrame:
    """One row per team and tournament."""
    result, venue = F.col("result"), F.col("venue")
    gf, ga = F.col("goals_for"), F.col("goals_against")
    matches, wins, draws = F.count("*"), F.count_if(result == "win"), F.count_if(result == "draw")

    def per_match(goals: Column) -> Column:
        # Matches without a score count too, which ``avg`` would leave out.
        return F.round(F.sum(goals).cast("double") / matches, 2)

    return (
        perspectives(results)
        .groupBy("team", "tournament")
        .agg(
            matches.alias("matches_played"),
            wins.alias("wins"),
            draws.alias("draws"),
            F.count_if(result == "loss").alias("losses"),
            percentage(wins, matches).alias("win_pct"),
            (wins * 3 + draws).alias("points"),
            F.sum(gf).alias("goals_for"),
            F.sum(ga).alias("goals_against"),
            (F.sum(gf) - F.sum(ga)).alias("goal_difference"),
            per_match(gf).alias("avg_goals_scored_per_match"),
            per_match(ga).alias("avg_goals_conceded_per_match"),
            F.count_if(ga == 0).alias("clean_sheets"),
            F.count_if(gf == 0).alias("failed_to_score"),
            F.max(gf - ga).alias("biggest_win_margin"),
            F.count_if(venue == "home").alias("home_matches"),
            F.count_if(venue == "away").alias("away_matches"),
            F.count_if((venue == "home") & (result == "win")).alias("home_wins"),
            F.count_if((venue == "away") & (result == "win")).alias("away_wins"),
        )
    )


def minute_bucket(minute: Column) -> Column:
    bucket = F.when(minute > 90, "90+")
    for low, high in MINUTE_BUCKETS:
        bucket = bucket.when(minute.between(low, high), f"{low}-{high}")
    return bucket.otherwise("unknown")


def mart_goal_analytics(goals: DataFrame) -> DataFrame:
    """One row per scoring team."""
    bucket = F.col("minute_bucket")
    total, penalties = F.count("*"), F.count_if(F.col("penalty"))
    return (
        goals.withColumn("minute_bucket", minute_bucket(F.col("minute")))
        .groupBy("team")
        .agg(
            total.alias("total_goals"),
            penalties.alias("penalty_goals"),
            percentage(penalties, total).alias("penalty_goal_pct"),
            F.count_if(F.col("own_goal")).alias("own_goals_against"),
            F.count_if(bucket.isin(*FIRST_HALF)).alias("first_half_goals"),
            F.count_if(bucket.isin(*SECOND_HALF)).alias("second_half_goals"),
            F.count_if(bucket == "90+").alias("stoppage_time_goals"),
            F.count_distinct("scorer").alias("unique_scorers"),
        )
    )


def age_years(born: Column, as_of: Column) -> Column:
    return calendar_years(born, as_of)


def mart_squad_profile(players: DataFrame, teams: DataFrame, as_of: Column, parity: bool = False) -> DataFrame:
    """One row per team name of the players, matched to a team or not.

    Players are counted per (team, club country) before the join, so the join
    moves a few rows per team whatever the size of a squad or of the team table.
    Positions are compared without regard to case; with ``parity`` they must be
    upper case, which lower-cased staging rows never are.
    """
    position = F.col("position") if parity else F.upper("position")
    age = age_years(F.col("date_of_birth"), as_of)
    squads = players.groupBy("team_name", "club_country").agg(
        F.count("*").alias("n"),
        F.sum(age).alias("age_sum"),
        F.count(age).alias("age_n"),
        F.min(age).alias("age_min"),
        F.max(age).alias("age_max"),
        *[F.count_if(position == code).alias(name) for name, code in POSITIONS.items()],
    )
    abroad = F.when(F.col("club_country") != F.col("fifa_code"), F.col("n")).otherwise(0)
    return (
        squads.join(teams.select("team_name", "fifa_code"), "team_name", "left")
        .groupBy("team_name")
        .agg(
            F.sum("n").alias("squad_size"),
            F.round(F.sum("age_sum").cast("double") / F.nullif(F.sum("age_n"), F.lit(0)), 1).alias("avg_age"),
            F.min("age_min").alias("youngest_player_age"),
            F.max("age_max").alias("oldest_player_age"),
            *[F.sum(name).alias(name) for name in POSITIONS],
            F.sum(abroad).alias("players_at_foreign_clubs"),
            percentage(F.sum(abroad), F.sum("n")).alias("legionnaire_pct"),
        )
    )
