"""Nested documents to flat parent and child rows.

Every step is narrow: arrays are exploded in the task that read the document,
and parent fields are carried into the child, so nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.operators.joins import running_number

_GOAL = "array<struct<name:string,minute:string,owngoal:boolean,penalty:boolean>>"
# The shape of the two documents.
MATCH_DOCUMENT = (
    "matches array<struct<date:string,time:string,round:string,`group`:string,ground:string,"
    f"team1:string,team2:string,score:struct<ft:array<int>,ht:array<int>>,goals1:{_GOAL},goals2:{_GOAL}>>"
)
SQUAD_ROW = (
    "name string, fifa_code string, `group` string, "
    "players array<struct<name:string,pos:string,number:int,date_of_birth:string,"
    "club:struct<name:string,country:string>>>"
)

PARENT_COLUMNS = [
    "match_num", "match_date", "match_time", "round_name", "group_name", "ground", "team1_name", "team2_name",
    "score_ft_team1", "score_ft_team2", "score_ht_team1", "score_ht_team2",
]
CHILD_COLUMNS = [
    "match_num", "match_date", "round_name", "team1_name", "team2_name",
    "scoring_team", "scorer_name", "minute", "is_team1_goal", "is_own_goal", "is_penalty",
]


def _text(value: Column) -> Column:
    """A missing text is ``''`` in flat rows. A typed read shows a JSON null in the same way."""
    return F.coalesce(value, F.lit(""))


def _positions(documents: DataFrame, keep: list[str]) -> DataFrame:
    return documents.select(*keep, F.posexplode("matches").alias("match_num", "_m"))


def _parents(matches: DataFrame, keep: list[str]) -> DataFrame:
    m = "_m."

    def score(half: str, side: int) -> Column:
        return F.try_element_at(F.col(f"_m.score.{half}"), F.lit(side))

    return matches.select(
        *keep,
        F.col("match_num").cast("bigint").alias("match_num"),
        _text(F.col(m + "date")).alias("match_date"),
        _text(F.col(m + "time")).alias("match_time"),
        _text(F.col(m + "round")).alias("round_name"),
        _text(F.col(m + "group")).alias("group_name"),
        _text(F.col(m + "ground")).alias("ground"),
        _text(F.col(m + "team1")).alias("team1_name"),
        _text(F.col(m + "team2")).alias("team2_name"),
        score("ft", 1).cast("bigint").alias("score_ft_team1"),
        score("ft", 2).cast("bigint").alias("score_ft_team2"),
        score("ht", 1).cast("bigint").alias("score_ht_team1"),
        score("ht", 2).cast("bigint").alias("score_ht_team2"),
    )


def flatten_parents(documents: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per match; ``match_num`` is its position in the document."""
    keep = list(keep)
    return _parents(_positions(documents, keep), keep)


def flatten_children(documents: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per goal of either side, with the fields of its match.

    Both goal arrays are tagged with their side and exploded together, which
    reads the documents once; a null array gives no rows.
    """
    keep = list(keep)

    def side(goals: str, team: str, first: bool) -> Column:
        tagged = F.transform(
            F.col(f"_m.{goals}"),
            lambda g: F.struct(
                _text(F.col(f"_m.{team}")).alias("scoring_team"), F.lit(first).alias("is_team1_goal"), g.alias("g")
            ),
        )
        return F.coalesce(tagged, F.array().cast(_TAGGED))

    goals = F.explode(F.concat(side("goals1", "team1", True), side("goals2", "team2", False))).alias("_g")
    return _positions(documents, keep).select(*keep, "match_num", "_m", goals).select(
        *keep,
        F.col("match_num").cast("bigint").alias("match_num"),
        _text(F.col("_m.date")).alias("match_date"),
        _text(F.col("_m.round")).alias("round_name"),
        _text(F.col("_m.team1")).alias("team1_name"),
        _text(F.col("_m.team2")).alias("team2_name"),
        F.col("_g.scoring_team").alias("scoring_team"),
        _text(F.col("_g.g.name")).alias("scorer_name"),
        _text(F.col("_g.g.minute")).alias("minute"),
        F.col("_g.is_team1_goal").alias("is_team1_goal"),
        F.coalesce(F.col("_g.g.owngoal"), F.lit(False)).alias("is_own_goal"),
        F.coalesce(F.col("_g.g.penalty"), F.lit(False)).alias("is_penalty"),
    )


_TAGGED = (
    "array<struct<scoring_team:string,is_team1_goal:boolean,"
    "g:struct<name:string,minute:string,owngoal:boolean,penalty:boolean>>>"
)


def _variant_text(value: str, path: str) -> Column:
    """Text as the reference prints it: missing -> ``''``, JSON null -> ``None``."""
    field = F.try_variant_get(value, path, "variant")
    return (
        F.when(field.isNull(), "")
        .when(F.is_variant_null(field), "None")
        .otherwise(F.try_variant_get(value, path, "string"))
    )


def flatten_variant_parents(documents: DataFrame, variant: str, keep: list[str] = ()) -> DataFrame:
    """As :func:`flatten_parents` for documents held as VARIANT.

    The document keeps the difference between a missing field and a JSON null.
    """
    keep = list(keep)
    matches = F.try_variant_get(variant, "$.matches", "variant")
    rows = documents.select(*keep, matches.alias("_v")).lateralJoin(
        documents.sparkSession.tvf.variant_explode(F.col("_v").outer())
    )

    def score(half: str, side: int) -> Column:
        return F.try_variant_get("value", f"$.score.{half}[{side}]", "bigint")

    return rows.select(
        *keep,
        F.col("pos").cast("bigint").alias("match_num"),
        *[
            _variant_text("value", f"$.{source}").alias(name)
            for source, name in (
                ("date", "match_date"), ("time", "match_time"), ("round", "round_name"), ("group", "group_name"),
                ("ground", "ground"), ("team1", "team1_name"), ("team2", "team2_name"),
            )
        ],
        score("ft", 0).alias("score_ft_team1"),
        score("ft", 1).alias("score_ft_team2"),
        score("ht", 0).alias("score_ht_team1"),
        score("ht", 1).alias("score_ht_team2"),
    )


def flatten_teams(squads: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per team."""
    return squads.select(
        *keep,
        _text(F.col("name")).alias("team_name"),
        _text(F.col("fifa_code")).alias("fifa_code"),
        _text(F.col("group")).alias("group_name"),
    )


def flatten_players(squads: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per player with the position in the squad, still without an id."""
    return squads.select(
        *keep, _text(F.col("name")).alias("team_name"), F.posexplode("players").alias("player_pos", "_p")
    ).select(
        *keep,
        "team_name",
        "player_pos",
        _text(F.col("_p.name")).alias("player_name"),
        _text(F.col("_p.pos")).alias("position"),
        F.col("_p.number").cast("bigint").alias("jersey_number"),
        _text(F.col("_p.club.name")).alias("club_name"),
        _text(F.col("_p.club.country")).alias("club_country"),
        _text(F.col("_p.date_of_birth")).alias("date_of_birth"),
    )


def with_player_ids(players: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """``P00001``, ``P00002``, ... over all teams in document order."""
    numbered = running_number(players, order, "_number", blocks)
    return numbered.select(F.format_string("P%05d", "_number").alias("player_id"), *players.columns)
