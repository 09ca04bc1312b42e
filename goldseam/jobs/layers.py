"""Registered queries on whole loads: raw rows to stored marts, drift, two-table documents, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.jobs.events import documents
from goldseam.jobs.inputs import ANALYTICS, MATCH_CHAIN, PLAYERS, with_inputs
from goldseam.jobs.matches import load_time, raw_goals, raw_results
from goldseam.jobs.squads import as_of, raw_players, raw_teams
from goldseam.operators.profile import mart_catalog
from goldseam.plans import adapt, build
from goldseam.plans.ingest import ingest
from goldseam.session import scratch_path
from goldseam.sources.lake import Lake, SchemaDriftError, with_audit
from goldseam.spec import AUDIT_COLUMNS, Slo, SourceSpec


def new_lake(spark: SparkSession) -> Lake:
    path = scratch_path(spark, "lake")
    return Lake(spark, path, prefix=path.rsplit("-", 1)[1][:8] + "_")


def built_layers(spark: SparkSession, sf_dir: str) -> tuple[Lake, dict[str, DataFrame]]:
    """Four Bronze tables, their staging models and the three marts, all stored."""
    lake = new_lake(spark)
    for source, raw in (
        ("historical_results", raw_results(spark, sf_dir)),
        ("historical_goals", raw_goals(spark, sf_dir)),
        ("player_profiles", raw_players(spark, sf_dir)),
        ("national_teams", raw_teams(spark, sf_dir)),
    ):
        table, rows = build.BRONZE_TABLES[f"stg_{source}"], raw.drop(*AUDIT_COLUMNS)
        lake.ensure(table, rows.schema)
        lake.reload(with_audit(rows, source, "run-1", load_time()), table)
    return lake, build.gold(lake, build.silver(lake), as_of())


def layer_build(spark, sf_dir):
    """Three measures of every row of the stored marts."""
    _, marts = built_layers(spark, sf_dir)
    chosen = {
        "mart_team_performance": (F.concat_ws("/", "team", "tournament"), "matches_played", "points", "goal_difference"),
        "mart_goal_analytics": (F.col("team"), "total_goals", "first_half_goals", "unique_scorers"),
        "mart_squad_profile": (F.col("team_name"), "goalkeepers", "players_at_foreign_clubs", "youngest_player_age"),
    }
    rows = [
        marts[mart].select(
            F.lit(mart).alias("mart"), item.alias("item"),
            *(F.col(m).cast("bigint").alias(f"measure_{i}") for i, m in enumerate(measures, 1)),
        )
        for mart, (item, *measures) in chosen.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def stored_mart_catalog(spark, sf_dir):
    """The values of the marts' text columns that have few, from the tables of the Gold layer."""
    lake, _ = built_layers(spark, sf_dir)
    return mart_catalog(spark, f"{lake.prefix}gold").withColumn("distinct_values", F.array_join("distinct_values", "|"))


def schema_halt(spark, sf_dir):
    """Four batches of customers for a table that halts on any drift; only the one with its columns is loaded."""
    customers = adapt.table(spark, sf_dir, "customer")
    lake = new_lake(spark)
    lake.ensure("RAW_CUSTOMER", customers.schema, audit=False)
    share = F.col("c_custkey") % 4
    batches = {
        "added": customers.filter(share == 0).withColumn("c_email", F.col("c_name")),
        "removed": customers.filter(share == 1).drop("c_acctbal"),
        "retyped": customers.filter(share == 2).withColumn("c_nationkey", F.col("c_nationkey").cast("string")),
        "same": customers.filter(share == 3),
    }
    outcomes = []
    for name, batch in batches.items():
        reason = ""
        try:
            lake.apply_drift("RAW_CUSTOMER", batch.schema, "halt")
            lake.append(batch, "RAW_CUSTOMER")
        except SchemaDriftError as error:
            reason = str(error)
        outcomes.append(batch.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("batch"), "n_rows", F.lit(reason).alias("reason")))
    table = lake.read("RAW_CUSTOMER").groupBy(F.lower("C_MKTSEGMENT").alias("batch")).agg(F.count("*").alias("n_rows"))
    return reduce(DataFrame.unionByName, outcomes).unionByName(table.withColumn("reason", F.lit("in the table")))


def two_table_load(spark, sf_dir):
    """Match documents loaded into matches and goals, twice; the second load replaces the first."""
    landing, lake = scratch_path(spark, "json"), new_lake(spark)
    documents(adapt.table(spark, sf_dir, "events")).drop("event_id").write.json(landing)
    spec = SourceSpec("worldcup_api", "api_json", landing, None, "RAW_WC_MATCHES", "RAW_WC_GOALS", {"multi_line": False})
    for _ in range(2):
        ingest(lake, spec, Slo(min_rows=1), load_time(), run_id="run-1")
    matches = lake.read("RAW_WC_MATCHES").groupBy(F.col("MATCH_DATE").alias("match_date"), F.col("TEAM1_NAME").alias("team")).agg(
        F.count("*").alias("n_rows"), F.sum("SCORE_FT_TEAM1").alias("total")
    )
    goals = lake.read("RAW_WC_GOALS").groupBy(F.col("MATCH_DATE").alias("match_date"), F.col("SCORING_TEAM").alias("team")).agg(
        F.count("*").alias("n_rows"), F.sum(F.col("IS_PENALTY").cast("bigint")).alias("total")
    )
    return matches.withColumn("kind", F.lit("matches")).unionByName(goals.withColumn("kind", F.lit("goals")))


def retention_apply(spark, sf_dir):
    """Events past their retention leave the table; applying it again changes nothing."""
    events, lake = adapt.table(spark, sf_dir, "events"), new_lake(spark)
    lake.ensure("RAW_EVENTS", events.schema, audit=False)
    lake.append(events, "RAW_EVENTS")
    for _ in range(2):
        lake.expire("RAW_EVENTS", F.lit("2024-04-20 00:00:00").cast("timestamp_ntz"), "ts")
    return lake.read("RAW_EVENTS").toDF(*events.columns)


QUERIES = {
    "layer_build": layer_build,
    "mart_catalog": stored_mart_catalog,
    "schema_halt": schema_halt,
    "two_table_load": two_table_load,
    "retention_apply": retention_apply,
}

# Goals as staging leaves them: with a day that exists and a minute.
_STAGED_GOALS = """bucketed as (
  select concat('team_', cast(user_id % 20 as varchar)) as team, concat('user_', cast(user_id as varchar)) as scorer,
    event_type = 'error' as own_goal, event_type = 'purchase' as penalty,
    case when cast(floor(value) as bigint) % 100 <= 15 then '0-15' when cast(floor(value) as bigint) % 100 <= 30 then '16-30'
      when cast(floor(value) as bigint) % 100 <= 45 then '31-45' else '46-60' end as minute_bucket
  from events where event_id % 7 <> 0 and value <= 400)"""


def _catalog_sql(table: str, column: str) -> str:
    return f"""select 'mart_{table}' as table_name, '{column}' as column_name, count(distinct {column}) as distinct_count,
        count(*) as total, string_agg(distinct {column}, '|' order by {column}) as distinct_values from {table}
        having count(*) > 0 and count(distinct {column})::double / count(*) <= 0.10 and count(distinct {column}) <= 60"""


ORACLE = {
    "layer_build": with_inputs(
        """select 'mart_team_performance' as mart, team || '/' || tournament as item, matches_played as measure_1,
             points as measure_2, goal_difference as measure_3 from performance
           union all select 'mart_goal_analytics', team, total_goals, first_half_goals, unique_scorers from analytics
           union all select 'mart_squad_profile', team_name, count(*) filter (where position = 'gk'), count(club_country),
             cast(min(2026 - year(date_of_birth)) filter (where player_id % 13 <> 0) as bigint)
           from players group by team_name""",
        *MATCH_CHAIN[:3], _STAGED_GOALS, ANALYTICS, PLAYERS,
    ),
    "mart_catalog": with_inputs(
        " union all ".join([
            _catalog_sql("team_performance", "team"), _catalog_sql("team_performance", "tournament"),
            _catalog_sql("goal_analytics", "team"), _catalog_sql("squad_profile", "team_name"),
        ]),
        *MATCH_CHAIN[:3], "team_performance as (select * from performance)", _STAGED_GOALS, ANALYTICS,
        "goal_analytics as (select * from analytics)", PLAYERS,
        "squad_profile as (select team_name from players group by team_name)",
    ),
    "schema_halt": """
        select 'added' as batch, count(*) as n_rows,
          'RAW_CUSTOMER: new columns [''c_email''], removed [], retyped []' as reason from customer where c_custkey % 4 = 0
        union all select 'removed', count(*), 'RAW_CUSTOMER: new columns [], removed [''C_ACCTBAL''], retyped []'
        from customer where c_custkey % 4 = 1
        union all select 'retyped', count(*), 'RAW_CUSTOMER: new columns [], removed [], retyped [''c_nationkey'']'
        from customer where c_custkey % 4 = 2
        union all select 'same', count(*), '' from customer where c_custkey % 4 = 3
        union all select lower(c_mktsegment), count(*), 'in the table' from customer where c_custkey % 4 = 3 group by 1""",
    "two_table_load": """with docs as (
          select strftime(ts, '%Y-%m-%d') as match_date, cast(json_extract_string(props, '$.k') as int) as k,
            event_id % 2 = 0 as even, event_type = 'purchase' as penalty from events),
        goals as (
          select match_date, penalty, unnest([{'team': 'Alpha', 'n': k % 4}, {'team': 'Beta', 'n': if(even, k % 4, 0)},
            {'team': 'Gamma', 'n': k % 4}, {'team': 'Delta', 'n': least(k % 4, 1)}], recursive := true) from docs)
        select 'matches' as kind, match_date, 'Alpha' as team, count(*) as n_rows, cast(sum(k % 5) as bigint) as total
        from docs group by match_date
        union all select 'matches', match_date, 'Gamma', count(*), cast(sum(k % 5) filter (where even) as bigint)
        from docs group by match_date
        union all select 'goals', match_date, team, cast(sum(n) as bigint), cast(sum(if(penalty, n, 0)) as bigint)
        from goals group by match_date, team having sum(n) > 0""",
    "retention_apply": "select * from events where ts >= timestamp '2024-04-20 00:00:00' - interval 90 day",
}
