"""From Bronze to marts: staging models, their tests, the marts, and the answers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.operators.governance import dictionary_entries
from goldseam.operators.profile import (
    null_rates,
    nullable_columns,
    numeric_kinds,
    profile_columns,
    suggest_tests,
    without_not_null,
)
from goldseam.operators.quality import (
    Expectation,
    at_least,
    not_null,
    run_expectations,
    summarize_tests,
    unique,
    violations,
)
from goldseam.plans.ask import GOLDEN
from goldseam.plans.gold import mart_goal_analytics, mart_squad_profile, mart_team_performance
from goldseam.plans.graph import Model, ModelGraph
from goldseam.plans.silver import LOADED_AT, MODELS, stage, stage_generic
from goldseam.sources.lake import Lake

# The Bronze table of each staging model.
BRONZE_TABLES = {
    "stg_historical_results": "RAW_HISTORICAL_RESULTS",
    "stg_historical_goals": "RAW_HISTORICAL_GOALS",
    "stg_historical_shootouts": "RAW_HISTORICAL_SHOOTOUTS",
    "stg_national_teams": "RAW_NATIONAL_TEAMS",
    "stg_player_profiles": "RAW_PLAYER_PROFILES",
    "stg_worldcup_api": "RAW_WC2026_MATCHES",
    "stg_worldcup_api_secondary": "RAW_WC2026_GOALS",
}
# Staging columns that may be null, and those that must be unique.
OPTIONAL_COLUMNS = {
    "stg_historical_shootouts": ("first_shooter",),
    "stg_player_profiles": ("player_name", "team_name", "position", "club_name", "club_country", "date_of_birth"),
}
UNIQUE_COLUMNS = {
    "stg_worldcup_api": ("match_num",),
    "stg_national_teams": ("fifa_code",),
    "stg_player_profiles": ("player_id",),
}
NO_NEGATIVE_SCORES = Expectation("holds", condition="home_score >= 0 and away_score >= 0")


@dataclass(frozen=True)
class StagedModel:
    """A staged table, the outcomes of the tests its values suggested, and its entries in the data dictionary."""

    rows: DataFrame
    outcomes: DataFrame
    dictionary: DataFrame


def stage_with_tests(bronze: DataFrame, model: str, table: str, optional: list[str] = ()) -> StagedModel:
    """Stage by the generic model, suggest tests from the values, withdraw those of sparse columns, and run the rest.

    ``optional`` columns may be null whatever their values say. The suggestions, one
    row per column, come to the driver, where they become tests.
    """
    staged = stage_generic(bronze)
    values = staged.drop(LOADED_AT)
    suggested = suggest_tests(profile_columns(values, numeric_kinds(values.schema)))
    sparse = nullable_columns(null_rates(values)).select("column_name")
    if optional:
        listed = [F.lit(c.lower()) for c in optional]
        more = bronze.sparkSession.range(1).select(F.explode(F.array(*listed)).alias("column_name"))
        sparse = sparse.unionByName(more).distinct()
    found = without_not_null(suggested, sparse).orderBy("column_name").collect()
    tests = []
    for row in found:
        tests += [{"not_null": not_null, "unique": unique}[t](row["column_name"]) for t in row["tests"]]
        tests += [at_least(row["column_name"], 0)] if row["nonnegative"] else []
    facts = bronze.sparkSession.createDataFrame(found, suggested.schema)
    return StagedModel(staged, run_expectations(staged, model, tests), dictionary_entries(facts, model, table))


def staging_models() -> list[Model]:
    """A staging model per Bronze table."""
    def staged(model: str, table: str) -> Model:
        return Model(model, (table,), lambda inputs: stage(inputs[table], model), "silver", "view")

    return [staged(model, table) for model, table in BRONZE_TABLES.items()]


def mart_models(as_of: Column) -> list[Model]:
    """The marts over the staging models."""
    results, goals, players, teams = (
        "stg_historical_results", "stg_historical_goals", "stg_player_profiles", "stg_national_teams"
    )
    return [
        Model("mart_team_performance", (results,), lambda i: mart_team_performance(i[results]), "gold"),
        Model("mart_goal_analytics", (goals,), lambda i: mart_goal_analytics(i[goals]), "gold"),
        Model("mart_squad_profile", (players, teams), lambda i: mart_squad_profile(i[players], i[teams], as_of), "gold"),
    ]


def layers(as_of: Column) -> ModelGraph:
    """All models. ``layers(as_of).build(lake, ["RAW_HISTORICAL_GOALS"])`` builds again what that table's change reaches."""
    return ModelGraph([*staging_models(), *mart_models(as_of)])


def silver(lake: Lake) -> dict[str, DataFrame]:
    """The staging models whose Bronze table exists, each as a table of the layer."""
    return ModelGraph(staging_models()).build(lake)


def declared_tests(model: str) -> list[Expectation]:
    optional = OPTIONAL_COLUMNS.get(model, ())
    tests = [not_null(c) for c in MODELS[model].names if c not in optional]
    tests += [unique(c) for c in UNIQUE_COLUMNS.get(model, ())]
    return [*tests, NO_NEGATIVE_SCORES] if model == "stg_historical_results" else tests


def test_models(models: dict[str, DataFrame]) -> DataFrame:
    """Gate and failed tests per staging model; both tables of a source are tested."""
    results = [run_expectations(df, model, declared_tests(model)) for model, df in models.items()]
    return summarize_tests(reduce(DataFrame.unionByName, results))


def negative_scores(models: dict[str, DataFrame]) -> DataFrame:
    """Rows that fail the assertion on scores."""
    columns = ("date", "home_team", "away_team", "home_score", "away_score")
    return violations(models["stg_historical_results"], NO_NEGATIVE_SCORES).select(*columns)


def gold(lake: Lake, models: dict[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """The marts as tables, built from the staging models."""
    marts = mart_models(as_of)
    return {m.name: lake.materialise(m.compute(models), m.name, m.layer) for m in marts}


def golden_answers(marts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The answer of every evaluation question."""
    return {question: answer(marts[mart]) for question, mart, answer in GOLDEN}
