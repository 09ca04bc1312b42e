"""Registered queries on players and teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.jobs.inputs import AS_OF, PLAYERS, SQUAD_CHAIN, with_inputs
from goldseam.operators.profile import null_rates, nullable_columns
from goldseam.operators.split import REASON, dead_letters, dead_rows, flag_null_key, flag_rows, valid_rows
from goldseam.plans import adapt, ask, gold
from goldseam.plans.silver import LOADED_AT, stage


def as_of():
    return F.lit(adapt.AS_OF).cast("date")


def squads(spark, sf_dir):
    return gold.mart_squad_profile(adapt.players(spark, sf_dir), adapt.teams(spark, sf_dir), as_of())


def age_years(spark, sf_dir):
    players = adapt.players(spark, sf_dir)
    return players.select("player_id", gold.age_years(F.col("date_of_birth"), as_of()).alias("age"))


def raw_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players in Bronze shape: text in capitals, the birthday as text, some of them no day at all."""
    players = adapt.players(spark, sf_dir)
    no_day = F.col("player_id") % 13 == 0
    return players.select(
        "player_id",
        F.concat(F.lit("Player "), F.col("player_id").cast("string")).alias("player_name"),
        F.upper("team_name").alias("team_name"),
        F.upper("position").alias("position"),
        # Half a number is rounded up by the strict cast.
        (F.col("player_id") % 30 + F.lit(0.5).cast("decimal(2,1)")).alias("jersey_number"),
        F.concat(F.lit("FC "), F.upper("team_name")).alias("club_name"),
        "club_country",
        F.when(no_day, "unknown").otherwise(F.col("date_of_birth").cast("string")).alias("date_of_birth"),
    )


def stage_players(spark, sf_dir):
    return stage(raw_players(spark, sf_dir), "stg_player_profiles").drop(LOADED_AT)


def raw_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("team_name"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("fifa_code"),
        F.concat(F.lit("Group "), F.col("n_regionkey").cast("string")).alias("group_name"),
    )


def stage_teams(spark, sf_dir):
    return stage(raw_teams(spark, sf_dir), "stg_national_teams").drop(LOADED_AT)


def sparse_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players with two columns that have nulls: one often enough to be optional, one not."""
    players = adapt.players(spark, sf_dir)
    return players.withColumn("date_of_birth", F.when(F.col("player_id") % 50 != 0, F.col("date_of_birth")))


def nullable(spark, sf_dir):
    players = sparse_players(spark, sf_dir)
    return nullable_columns(null_rates(players))


def split_valid(spark, sf_dir):
    return valid_rows(flag_rows(sparse_players(spark, sf_dir), nullable={"club_country"}))


def split_strict(spark, sf_dir):
    flagged = flag_rows(sparse_players(spark, sf_dir))
    return flagged.withColumnRenamed(REASON, "rejection_reason")


def split_null_key(spark, sf_dir):
    flagged = flag_null_key(sparse_players(spark, sf_dir), "club_country", "null_club_country_pk")
    return dead_rows(flagged).withColumnRenamed(REASON, "rejection_reason")


def dead_letter(spark, sf_dir):
    flagged = flag_rows(sparse_players(spark, sf_dir))
    at = F.lit("2026-06-11 00:00:00").cast("timestamp_ntz")
    letters = dead_letters(dead_rows(flagged), "player_profiles", "run-1", at)
    return letters.drop("_dl_id").withColumn("_raw_payload", F.to_json("_raw_payload"))


QUERIES = {
    "mart_squad_profile": squads,
    "age_years": age_years,
    "stage_players": stage_players,
    "stage_teams": stage_teams,
    "g_youngest": lambda s, d: ask.youngest_squad(squads(s, d)),
    "g_foreign": lambda s, d: ask.most_foreign(squads(s, d)),
    "g_goalkeepers": lambda s, d: ask.most_goalkeepers(squads(s, d)),
    "nullable_columns": nullable,
    "split_valid": split_valid,
    "split_strict": split_strict,
    "split_null_key": split_null_key,
    "dead_letter": dead_letter,
}

_SPARSE = """sparse as (
  select player_id, team_name, position, club_country,
    case when player_id % 50 <> 0 then date_of_birth end as date_of_birth from players)"""

ORACLE = {
    "mart_squad_profile": with_inputs("select * from squads", *SQUAD_CHAIN),
    "age_years": with_inputs(
        f"select player_id, cast(year({AS_OF}) - year(date_of_birth) as int) as age from players", PLAYERS
    ),
    "stage_players": with_inputs(
        """select cast(player_id as varchar) as player_id, 'player ' || cast(player_id as varchar) as player_name,
             team_name, position, player_id % 30 + 1 as jersey_number, 'fc ' || team_name as club_name, club_country,
             case when player_id % 13 <> 0 then date_of_birth end as date_of_birth from players""",
        PLAYERS,
    ),
    "stage_teams": """select lower(n_name) as team_name, 'n' || cast(n_nationkey as varchar) as fifa_code,
                      'group ' || cast(n_regionkey as varchar) as group_name from nation""",
    "g_youngest": with_inputs("select team_name, avg_age from squads order by avg_age, team_name limit 1", *SQUAD_CHAIN),
    "g_foreign": with_inputs(
        "select team_name, legionnaire_pct from squads order by legionnaire_pct desc, team_name limit 1", *SQUAD_CHAIN
    ),
    "g_goalkeepers": with_inputs(
        "select team_name, goalkeepers from squads order by goalkeepers desc, team_name limit 1", *SQUAD_CHAIN
    ),
    "nullable_columns": with_inputs(
        """select 'club_country' as column_name, sum((club_country is null)::int)::double / count(*) as null_rate
           from sparse having null_rate > 0.05
           union all select 'date_of_birth', sum((date_of_birth is null)::int)::double / count(*) as r
           from sparse having r > 0.05
           union all select 'position', sum((trim(position) = '' or position is null)::int)::double / count(*) as r
           from sparse having r > 0.05
           union all select 'team_name', sum((trim(team_name) = '' or team_name is null)::int)::double / count(*) as r
           from sparse having r > 0.05
           union all select 'player_id', sum((player_id is null)::int)::double / count(*) as r
           from sparse having r > 0.05""",
        PLAYERS,
        _SPARSE,
    ),
    "split_valid": with_inputs(
        """select * from sparse where player_id is not null and team_name is not null and position is not null
           and date_of_birth is not null""",
        PLAYERS,
        _SPARSE,
    ),
    "split_strict": with_inputs(
        """select *, case when player_id is null or team_name is null or position is null or club_country is null
             or date_of_birth is null then 'null_or_coercion_failure' end as rejection_reason from sparse""",
        PLAYERS,
        _SPARSE,
    ),
    "split_null_key": with_inputs(
        "select *, 'null_club_country_pk' as rejection_reason from sparse where club_country is null", PLAYERS, _SPARSE
    ),
    "dead_letter": with_inputs(
        """select timestamp '2026-06-11 00:00:00' as _ingested_at, 'run-1' as _batch_id, 'player_profiles' as _source,
             'null_or_coercion_failure' as _error_type, '' as _error_detail,
             cast(to_json({'club_country': club_country, 'date_of_birth': cast(date_of_birth as varchar),
                           'player_id': player_id, 'position': position, 'team_name': team_name}) as varchar)
               as _raw_payload
           from sparse where club_country is null or date_of_birth is null""",
        PLAYERS,
        _SPARSE,
    ),
}
