"""Staging models: one projection each over a Bronze table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.functions import casts
from goldseam.spec import AUDIT_COLUMNS

LOADED_AT = "_loaded_at"


@dataclass(frozen=True)
class StagingModel:
    """Output columns by treatment, in output order.

    A column is ``name`` or ``name<source`` and its treatment is lower, date,
    time, number, boolean, text or keep.
    """

    columns: tuple[tuple[str, str], ...]
    required: bool = False

    @property
    def names(self) -> list[str]:
        return [c.split("<")[0] for c, _ in self.columns]


def _model(*groups: str, required: bool = False) -> StagingModel:
    pairs = []
    for group in groups:
        treatment, columns = group.split(":")
        pairs += [(c, treatment) for c in columns.split()]
    return StagingModel(tuple(pairs), required)


# The seven staging models, columns in output order.
MODELS = {
    "stg_historical_results": _model(
        "date:date", "lower:home_team away_team", "number:home_score away_score",
        "lower:tournament city country", "boolean:neutral",
    ),
    "stg_historical_goals": _model(
        "date:game_date<date", "lower:home_team away_team team scorer", "number:minute",
        "boolean:own_goal penalty", required=True,
    ),
    "stg_historical_shootouts": _model("date:date", "lower:home_team away_team winner first_shooter"),
    "stg_national_teams": _model("lower:team_name fifa_code group_name"),
    "stg_player_profiles": _model(
        "text:player_id", "lower:player_name team_name position", "number:jersey_number",
        "lower:club_name club_country", "date:date_of_birth",
    ),
    "stg_worldcup_api": _model(
        "number:match_num", "date:match_date", "time:match_time",
        "lower:round_name group_name ground team1_name team2_name",
        "number:score_ft_team1 score_ft_team2 score_ht_team1 score_ht_team2",
    ),
    "stg_worldcup_api_secondary": _model(
        "keep:match_num", "date:match_date", "lower:round_name team1_name team2_name scoring_team scorer_name",
        "keep:minute", "boolean:is_team1_goal is_own_goal is_penalty",
    ),
}


def _treat(column: Column, treatment: str, source_type: T.DataType) -> Column:
    if treatment == "number":
        return casts.strict_number(column, source_type)
    return {
        "lower": F.lower,
        "date": casts.lenient_date,
        "time": casts.lenient_time,
        "boolean": casts.strict_boolean,
        "text": casts.lenient_text,
        "keep": lambda c: c,
    }[treatment](column)


def stage(bronze: DataFrame, model: StagingModel | str, loaded_at: Column | None = None) -> DataFrame:
    """Cast, lower-case and rename as the model says; audit columns fall away.

    A model with ``required`` keeps only rows without any null.
    """
    model = MODELS[model] if isinstance(model, str) else model
    types = {f.name.lower(): f.dataType for f in bronze.schema.fields}
    columns = []
    for column, treatment in model.columns:
        name, _, source = column.partition("<")
        source = source or name
        columns.append(_treat(F.col(f"`{source}`"), treatment, types[source.lower()]).alias(name))
    staged = bronze.select(*columns, (F.current_timestamp() if loaded_at is None else loaded_at).alias(LOADED_AT))
    return staged.dropna(subset=model.names) if model.required else staged


def stage_generic(bronze: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """All columns but the audit ones, names in lower case, with the load time."""
    columns = [F.col(f"`{c}`").alias(c.lower()) for c in bronze.columns if not c.startswith("_")]
    return bronze.select(*columns, (F.current_timestamp() if loaded_at is None else loaded_at).alias(LOADED_AT))


def snake_case(name: str) -> str:
    """``orderDate``, ``Order Date`` and ``ORDER_DATE`` -> ``order_date``."""
    out = ""
    for before, letter in zip(" " + name, name):
        if letter.isupper() and (before.islower() or before.isdigit()):
            out += "_"
        out += letter.lower() if letter.isalnum() else "_"
    return "_".join(part for part in out.split("_") if part)


# Name endings that mean a day or a moment, and flag prefixes.
DATE_ENDINGS = ("_date", "date")
TIMESTAMP_ENDINGS = ("_at", "_time", "time")
FLAG_PREFIXES = ("is_", "has_", "was_")


def rule_treatment(name: str, source_type: T.DataType) -> str:
    """What the name and type of a column ask for."""
    if isinstance(source_type, T.StringType):
        if name.endswith(DATE_ENDINGS):
            return "date"
        if name.endswith(TIMESTAMP_ENDINGS):
            return "timestamp"
    if isinstance(source_type, T.NumericType) and name.startswith(FLAG_PREFIXES):
        return "boolean"
    return "keep"


def stage_rules(bronze: DataFrame, lower_case: list[str] = (), loaded_at: Column | None = None) -> DataFrame:
    """Staging by naming rules; ``lower_case`` names the columns found to hold capitals only."""
    columns = []
    for f in bronze.schema.fields:
        if f.name.lower() in AUDIT_COLUMNS:
            continue
        name, source = snake_case(f.name), F.col(f"`{f.name}`")
        treatment = "lower" if f.name in lower_case else rule_treatment(name, f.dataType)
        cast = source.try_cast("timestamp_ntz") if treatment == "timestamp" else _treat(source, treatment, f.dataType)
        columns.append(cast.alias(name))
    return bronze.select(*columns, (F.current_timestamp() if loaded_at is None else loaded_at).alias(LOADED_AT))


def capital_columns(bronze: DataFrame) -> list[str]:
    """Text columns that hold capital letters and no small ones: one scan, one row back."""
    texts = [f.name for f in bronze.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return []

    def only_capitals(c: str) -> Column:
        value = F.col(f"`{c}`")
        return F.bool_and(value == F.upper(value)) & F.bool_or(value != F.lower(value))

    row = bronze.agg(*[only_capitals(c).alias(c) for c in texts]).first()
    return [c for c in texts if row[c]]
