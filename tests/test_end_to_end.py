"""All six sources through every layer."""

import json
import sqlite3

from pyspark.sql import functions as F

from goldseam.operators.profile import mart_catalog
from goldseam.operators.state import summarize_runs
from goldseam.plans import ask, build
from goldseam.plans.ingest import ingest_all, run_log
from goldseam.sources.lake import Lake
from goldseam.spec import Slo, SourceSpec

TEAMS = ["Alpha", "Beta", "Gamma", "Delta"]


def sources(tmp_path):
    results = [
        f"2020-{m:02d}-{d:02d},{h},{a},{(m * d) % 5},{(m + d) % 4},Cup,City,Land,{'TRUE' if d % 2 else 'FALSE'}"
        for m in range(1, 7)
        for d, (h, a) in enumerate([(h, a) for h in TEAMS for a in TEAMS if h != a], 1)
    ]
    goals = [
        f"2020-01-{i % 12 + 1:02d},{TEAMS[i % 4]},{TEAMS[(i + 1) % 4]},{TEAMS[i % 4]},Player {i % 9},{i * 7 % 95 + 2},"
        f"{'TRUE' if i % 11 == 0 else 'FALSE'},{'TRUE' if i % 5 == 0 else 'FALSE'}"
        for i in range(60)
    ]
    shootouts = [f"2020-02-{i % 20 + 1:02d},Alpha,Beta,Alpha,{'Beta' if i % 3 == 0 else ''}" for i in range(30)]
    for name, head, rows in (
        ("results", "date,home_team,away_team,home_score,away_score,tournament,city,country,neutral", results),
        ("goals", "date,home_team,away_team,team,scorer,minute,own_goal,penalty", goals),
        ("shootouts", "date,home_team,away_team,winner,first_shooter", shootouts),
    ):
        (tmp_path / f"{name}.csv").write_text("\n".join([head, *rows]) + "\n")
    matches = {"matches": [
        {"date": "2026-06-11", "time": "13:00", "round": "1", "group": "A", "ground": "X", "team1": "Alpha", "team2": "Beta",
         "score": {"ft": [1, 0], "ht": [0, 0]}, "goals1": [{"name": "p", "minute": "9"}]},
        {"date": "2026-06-12", "time": "13:00 UTC-6", "round": "1", "team1": "Gamma", "team2": "Delta"},
    ]}
    (tmp_path / "api.json").write_text(json.dumps(matches))
    db = sqlite3.connect(tmp_path / "squads.db")
    db.execute("CREATE TABLE national_teams (team_name TEXT PRIMARY KEY, fifa_code TEXT, group_name TEXT NOT NULL)")
    db.execute(
        "CREATE TABLE player_profiles (player_id TEXT PRIMARY KEY, player_name TEXT, team_name TEXT, position TEXT,"
        " jersey_number INTEGER, club_name TEXT, club_country TEXT, date_of_birth TEXT)"
    )
    db.executemany("INSERT INTO national_teams VALUES (?, ?, ?)", [(t, t[:3].upper(), "A") for t in TEAMS])
    db.executemany(
        "INSERT INTO player_profiles VALUES (?, ?, ?, ?, ?, ?, ?, ?)",
        [(f"P{i:05d}", f"Player {i}", TEAMS[i % 4], ("GK", "DF", "MF", "FW")[i // 4 % 4], i, "Club",
          ("ALP", "BET")[i % 2], f"{1990 + i % 10}-05-05") for i in range(80)],
    )
    db.commit()
    db.close()
    squads = str(tmp_path / "squads.db")
    return [
        SourceSpec("historical_results", "csv", str(tmp_path / "results.csv")),
        SourceSpec("historical_goals", "csv", str(tmp_path / "goals.csv")),
        SourceSpec("historical_shootouts", "csv", str(tmp_path / "shootouts.csv")),
        SourceSpec("worldcup_api", "api_json", str(tmp_path / "api.json"), None, "RAW_WC2026_MATCHES", "RAW_WC2026_GOALS"),
        SourceSpec("national_teams", "sqlite", squads, "national_teams"),
        SourceSpec("player_profiles", "sqlite", squads, "player_profiles"),
        SourceSpec("absent", "csv", str(tmp_path / "absent.csv")),
    ]


def test_all_layers(spark, lake, tmp_path):
    specs = sources(tmp_path)
    loads = ingest_all(lake, specs, {s.source_name: Slo(min_rows=1) for s in specs})
    assert {r.source_name: r.status for r in loads} == {
        s.source_name: "failed" if s.source_name == "absent" else "done" for s in specs
    }
    assert summarize_runs(run_log(lake, loads)).filter("last_status = 'done'").count() == 6

    models = build.silver(lake)
    assert set(models) == set(build.BRONZE_TABLES)
    gates = {r.model: (r.gate, list(r.failures)) for r in build.test_models(models).collect()}
    # A match without a clock time or a score fails its tests; everything else passes.
    failed = gates.pop("stg_worldcup_api")
    assert failed[0] == "failed" and "not_null_match_time" in failed[1] and "unique_match_num" not in failed[1]
    assert {gate for gate, _ in gates.values()} == {"passed"}
    assert build.negative_scores(models).isEmpty()

    marts = build.gold(lake, models, F.lit("2026-06-11").cast("date"))
    assert marts["mart_team_performance"].agg(F.sum("matches_played")).first()[0] == 144
    assert marts["mart_goal_analytics"].agg(F.sum("total_goals")).first()[0] == 60
    assert marts["mart_squad_profile"].agg(F.sum("squad_size"), F.sum("goalkeepers")).first()[:] == (80, 20)

    answers = {q: df.collect() for q, df in build.golden_answers(marts).items()}
    assert len(answers) == 10 and all(answers.values())
    assert answers["What is the average goal difference across all teams?"][0][0] == 0.0
    table = lake.name("mart_team_performance", "gold")
    assert ask.run_readonly(spark, f"select team from {table} order by points desc", 5).count() == 4
    # A table of the layer that is not a mart stays out; so do columns with too many values for their rows.
    seasons = spark.range(40).select(F.concat(F.lit("s"), F.col("id") % 2).alias("season"), F.col("id").cast("string").alias("code"))
    lake.materialise(seasons, "mart_seasons", "gold")
    lake.materialise(seasons, "notes", "gold")
    found = {(r.table_name, r.column_name): list(r.distinct_values) for r in mart_catalog(spark, f"{lake.prefix}gold").collect()}
    assert found.pop(("mart_seasons", "season")) == ["s0", "s1"]
    assert {table for table, _ in found} <= set(marts) and ("mart_seasons", "code") not in found


def test_environments_stay_apart(spark, tmp_path):
    """Two lakes in one session whose models have the same names."""
    lakes = {e: Lake(spark, str(tmp_path / e), prefix=f"{e}{abs(hash(str(tmp_path))) % 10**8}_") for e in ("dev", "prod")}
    for n, env in enumerate(lakes, 1):
        for layer, kind in (("silver", "view"), ("gold", "table")):
            lakes[env].materialise(spark.range(n).withColumn("env", F.lit(env)), "model", layer, kind)
    for n, (env, own) in enumerate(lakes.items(), 1):
        for layer in ("silver", "gold"):
            assert [r.env for r in own.read("model", layer).collect()] == [env] * n


def test_retention_is_safe_to_repeat(spark, lake):
    rows = spark.sql("select id, timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(id) as _ingested_at from range(200)")
    lake.ensure("RAW_T", rows.schema, audit=False)
    lake.reload(rows, "RAW_T")
    as_of = F.lit("2026-06-30 00:00:00").cast("timestamp_ntz")
    assert [lake.expire("RAW_T", as_of) for _ in range(2)] == [110, 110]
    assert lake.read("RAW_T").agg(F.min("id")).first()[0] == 90
