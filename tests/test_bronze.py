"""Loads into Bronze: files and databases, rejected rows, watermarks, drift."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.operators.state import absent_seeds, newer_than, summarize_runs, upsert
from goldseam.plans.ingest import ingest, run_log
from goldseam.sources import database
from goldseam.sources.files import has_spanning_records, read_csv_text
from goldseam.sources.lake import SchemaDriftError, normalise_columns, with_audit, with_row_id
from goldseam.spec import (
    Slo,
    SourceSpec,
    bronze_table_name,
    qualified_name,
    slo_for,
    staging_model_name,
)


def csv_file(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def results_csv(tmp_path, bad):
    rows = [f"2026-06-{i % 28 + 1:02d},Home {i},Away {i},{i % 5},{i % 3},Cup,City,Land,FALSE" for i in range(40)]
    # Each rejected row lacks another column, so that no column counts as sparse.
    rows += ["2026-06-01,Home,,1,0,Cup,City,Land,FALSE", "2026-06-01,,Away,1,0,Cup,City,Land,FALSE", "2026-06-01,Home,Away,1,0,,City,Land,FALSE"][:bad]
    return csv_file(tmp_path, "results.csv", ["date,home_team,away_team,home_score,away_score,tournament,city,country,neutral", *rows])


def test_csv_load(spark, lake, tmp_path):
    spec = SourceSpec("historical_results", "csv", results_csv(tmp_path, 1))
    result = ingest(lake, spec, slo=Slo(min_rows=40))
    assert (result.status, result.rows_loaded, result.rows_dead, result.breach) == ("done", 40, 1, None)
    table = lake.read("RAW_HISTORICAL_RESULTS")
    types = {f.name: f.dataType for f in table.schema.fields}
    assert types["HOME_SCORE"] == T.LongType() and types["DATE"] == T.StringType()
    assert table.columns[-3:] == ["_ingested_at", "_source_name", "_pipeline_run_id"]
    assert table.count() == 40 and table.select("_pipeline_run_id").distinct().count() == 1
    letter = lake.read("DEAD_LETTER").withColumn("_raw_payload", F.to_json("_raw_payload")).first()
    assert (letter._source, letter._error_type, len(letter._dl_id)) == ("historical_results", "null_or_coercion_failure", 36)
    assert letter._error_detail == "away_team"
    payload = json.loads(letter._raw_payload)
    assert payload["away_team"] is None and payload["home_score"] == 1 and "_source_name" not in payload
    assert lake.watermark("historical_results") is not None


def test_reload_replaces_rows_and_moves_the_watermark(spark, lake, tmp_path):
    spec = SourceSpec("historical_results", "csv", results_csv(tmp_path, 0))
    ingest(lake, spec, slo=Slo())
    first = lake.watermark("historical_results")
    ingest(lake, spec, slo=Slo())
    assert lake.read("RAW_HISTORICAL_RESULTS").count() == 40
    assert lake.read("INGESTION_WATERMARKS").count() == 1
    assert lake.watermark("historical_results") > first


def test_a_load_below_its_levels_is_not_published(spark, lake, tmp_path):
    good = SourceSpec("historical_results", "csv", results_csv(tmp_path, 0))
    ingest(lake, good, slo=Slo())
    mark = lake.watermark("historical_results")
    assert "at least 45000" in ingest(lake, good).breach
    many = ingest(lake, SourceSpec("historical_results", "csv", results_csv(tmp_path, 3)), slo=Slo())
    assert many.status == "failed" and "7.0%" in many.breach
    assert lake.read("RAW_HISTORICAL_RESULTS").count() == 40
    assert lake.watermark("historical_results") == mark
    assert lake.read("DEAD_LETTER").count() == 3
    after = ingest(lake, SourceSpec("historical_results", "csv", results_csv(tmp_path, 3)), slo=Slo(), publish_on_breach=True)
    assert after.status == "failed" and lake.watermark("historical_results") > mark


def test_sparse_columns_may_be_empty(spark, lake, tmp_path):
    rows = [f"2020-01-{i % 28 + 1:02d},A,B,A,{'C' if i % 2 else ''}" for i in range(30)]
    path = csv_file(tmp_path, "shootouts.csv", ["date,home_team,away_team,winner,first_shooter", *rows])
    result = ingest(lake, SourceSpec("historical_shootouts", "csv", path), slo=Slo())
    assert (result.rows_loaded, result.rows_dead) == (30, 0)


def test_two_tables_from_one_document(spark, lake, tmp_path):
    document = {"matches": [
        {"team1": "A", "team2": "B", "goals1": [{"name": "x", "minute": "1"}], "goals2": [{"name": "y", "minute": "2"}]},
        {"team1": "C", "team2": "D"},
    ]}
    (tmp_path / "api.json").write_text(json.dumps(document))
    spec = SourceSpec("worldcup_api", "api_json", str(tmp_path / "api.json"), None, "RAW_WC2026_MATCHES", "RAW_WC2026_GOALS")
    result = ingest(lake, spec)
    assert result.tables == {"RAW_WC2026_MATCHES": 2, "RAW_WC2026_GOALS": 2}
    sources = {r[0] for r in lake.read("RAW_WC2026_GOALS").select("_source_name").collect()}
    assert sources == {"worldcup_api_goals"}
    log = run_log(lake, [result])
    assert tuple(summarize_runs(log).first()) == ("worldcup_api", 1, 1, "done", 4, 0)


def sqlite_file(tmp_path, n=1000):
    path = tmp_path / "squads.db"
    connection = sqlite3.connect(path)
    connection.execute("CREATE TABLE player_profiles (player_id TEXT PRIMARY KEY, name VARCHAR(20), jersey INTEGER, fee REAL, active BOOLEAN)")
    data = [(f"P{i:05d}", f" n{i} ", i, i / 2, i % 2) for i in range(n)]
    data += [("bad1", "x", "3.7x", 1.0, 1), ("bad2", None, 1, 1.0, 1), ("cut", "x", 3.7, 1.0, "false"), ("blank", "", 1, 2, "")]
    connection.executemany("INSERT INTO player_profiles VALUES (?, ?, ?, ?, ?)", data)
    connection.commit()
    connection.close()
    return str(path)


def test_database_load(spark, lake, tmp_path):
    path = sqlite_file(tmp_path)
    assert database.declared_types(path, "player_profiles") == {
        "player_id": "str", "name": "str", "jersey": "int", "fee": "float", "active": "bool",
    }
    df = database.read_sqlite(spark, path, "player_profiles", partitions=5)
    assert df.rdd.getNumPartitions() == 5
    odd = {r.player_id: (r.name, r.jersey, r.active) for r in df.filter("player_id not like 'P%'").collect()}
    # A stored real is cut, a text that is no whole number fails; text is never stripped and is true unless blank.
    assert odd == {"bad1": ("x", None, True), "bad2": (None, 1, True), "cut": ("x", 3, True), "blank": ("", 1, False)}
    assert df.filter("name = ' n7 '").count() == 1
    result = ingest(lake, SourceSpec("player_profiles", "sqlite", path, "player_profiles"), slo=Slo(min_rows=1002))
    assert (result.rows_loaded, result.rows_dead, result.status) == (1002, 2, "done")


def test_unknown_database_table(tmp_path):
    with pytest.raises(ValueError, match="not found"):
        database.declared_types(sqlite_file(tmp_path, 1), "nope")


def test_database_shards_round_trip(spark, tmp_path, rows):
    df = spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name")).repartition(3)
    written = database.write_sqlite_shards(df, str(tmp_path / "shards"), "t", {"id": "INTEGER", "name": "TEXT"})
    assert written.agg(F.sum("n_rows")).first()[0] == 100
    assert rows(database.read_sqlite(spark, str(tmp_path / "shards"), "t")) == rows(df)


def test_csv_records_over_several_lines(spark, tmp_path):
    plain = csv_file(tmp_path, "plain.csv", ["a,b", '1,"x ""y"""'])
    spanning = csv_file(tmp_path, "spanning.csv", ["a,b", '1,"x', 'y"', "2,z"])
    assert not has_spanning_records(spark, plain)
    assert has_spanning_records(spark, spanning)
    assert [tuple(r) for r in read_csv_text(spark, plain).collect()] == [("1", 'x "y"')]
    assert sorted(tuple(r) for r in read_csv_text(spark, spanning).collect()) == [("1", "x\ny"), ("2", "z")]


def test_schema_drift(spark, lake):
    old = T.StructType.fromDDL("id bigint, name string")
    lake.ensure("RAW_T", old)
    lake.append(with_audit(spark.createDataFrame([(1, "a")], old), "t", "r1", F.current_timestamp()), "RAW_T")
    new = T.StructType.fromDDL("id bigint, name string, `home-town` string")
    with pytest.raises(SchemaDriftError):
        lake.apply_drift("RAW_T", new, "halt")
    for changed in ("id bigint", "id string, name string"):
        with pytest.raises(SchemaDriftError):
            lake.apply_drift("RAW_T", T.StructType.fromDDL(changed), "halt")
    lake.apply_drift("RAW_T", T.StructType.fromDDL("id bigint, name string"), "halt")
    assert lake.apply_drift("RAW_T", new) == ["HOME_TOWN"]
    assert lake.apply_drift("RAW_T", new) == []
    assert lake.apply_drift("RAW_ABSENT", new) == []
    lake.append(spark.createDataFrame([(2, "b", "x")], new), "RAW_T")
    got = sorted((r.ID, r.HOME_TOWN) for r in lake.read("RAW_T").collect())
    assert got == [(1, None), (2, "x")]


def test_a_table_can_be_rewritten_from_itself(spark, lake):
    lake.ensure("T", "id bigint", audit=False, layer="gold")
    lake.reload(spark.range(5), "T", "gold")
    assert lake.reload(lake.read("T", "gold").filter("id > 2"), "T", "gold") == 2
    assert sorted(r[0] for r in lake.read("T", "gold").collect()) == [3, 4]


def test_old_versions_can_be_removed(spark, lake):
    lake.ensure("T", "id bigint", audit=False, layer="gold", raw=False)
    for n in (1, 2, 3):
        lake.reload(spark.range(n), "T", "gold")
    assert lake.remove_old_versions("T", "gold") == 0  # young folders may belong to running loads
    assert lake.remove_old_versions("T", "gold", older_than_hours=0) == 2
    assert lake.read("T", "gold").count() == 3
    lake.append(spark.range(1), "T", "gold")
    assert lake.remove_old_versions("T", "gold", older_than_hours=0) == 0 and lake.read("T", "gold").count() == 4


def test_contract_tables_get_row_ids(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    marked = with_row_id(df, "b1", F.lit("2026-06-11").cast("timestamp_ntz"))
    assert marked.columns == ["_row_id", "_batch_id", "_ingested_at", "a", "b"]
    assert marked.select("_row_id").distinct().count() == 2


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = csv_file(tmp_path, "x.csv", ["b,a", "1,2"])
    assert tuple(read_csv_text(spark, path, ["a", "b", "c"]).first()) == ("2", "1", None)


def test_models_as_view_and_table(spark, lake):
    view = lake.materialise(spark.range(3), "stg_x", "silver", "view")
    mart = lake.materialise(view.selectExpr("id", "id * 2 as twice"), "mart_x", "gold")
    assert mart.columns == ["id", "twice"] and mart.count() == 3
    again = lake.materialise(spark.range(2).selectExpr("id", "id as twice", "'n' as note"), "mart_x", "gold")
    assert again.columns == ["id", "twice", "note"] and again.count() == 2


def test_upsert_is_idempotent(spark, rows):
    current = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "k string, v int, at int")
    updates = spark.createDataFrame([("b", 2, 5), ("b", 3, 7), ("c", 4, 1)], "k string, v int, at int")
    once = upsert(current, updates, "k", F.col("at"))
    assert rows(once) == [("a", 1, 10), ("b", 3, 7), ("c", 4, 1)]
    assert rows(upsert(once, updates, "k", F.col("at"))) == rows(once)


def test_seeds_and_watermark_filter(spark, lake, rows):
    lake.ensure("S", "k string, v int", audit=False, raw=False)
    seeds = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v int")
    assert lake.seed(seeds, "S", "k") == 2
    assert lake.seed(seeds.unionByName(spark.createDataFrame([("c", 0)], "k string, v int")), "S", "k") == 1
    assert rows(absent_seeds(seeds, lake.read("S"), "k")) == []
    assert newer_than(seeds, "v", None).count() == 2 and newer_than(seeds, "v", 0).count() == 0


def test_names():
    assert bronze_table_name("user-events v1.2") == "RAW_USER_EVENTS_V1_2"
    assert bronze_table_name("api", secondary=True) == "RAW_API_SECONDARY"
    assert staging_model_name("World-Cup api") == "stg_world_cup_api"
    assert qualified_name("T") == "spark_catalog.bronze.T"
    assert qualified_name("gold.T") == "spark_catalog.gold.T"
    assert qualified_name("c.gold.T") == "c.gold.T"
    assert slo_for("unknown").min_rows == 0 and slo_for("national_teams").min_rows == 48
    with pytest.raises(ValueError):
        SourceSpec("x", "xml", "/tmp")
    with pytest.raises(ValueError):
        SourceSpec("x", "sqlite", "/tmp")


def test_colliding_column_names(spark):
    with pytest.raises(ValueError, match="collide"):
        normalise_columns(spark.range(1).select(F.lit(1).alias("a b"), F.lit(2).alias("a-b")))


def test_csv_files_of_a_folder_are_read_by_their_own_headers(spark, tmp_path, rows):
    folder = tmp_path / "in"
    folder.mkdir()
    csv_file(folder, "1.csv", ["id,name", "1,x", "2,y"])
    csv_file(folder, "2.csv", ["name,id", "z,3"])
    csv_file(folder, "3.csv", ["", "id,extra", '4,"a', 'b"'])
    (folder / "4.csv").write_text("")
    got = read_csv_text(spark, str(folder), ["id", "name", "extra"])
    assert rows(got) == [("1", "x", None), ("2", "y", None), ("3", "z", None), ("4", None, "a\nb")]
    assert set(read_csv_text(spark, str(folder)).columns) == {"id", "name", "extra"}


def test_values_beyond_the_header_reject_their_row(spark, lake, tmp_path):
    path = csv_file(tmp_path, "shootouts.csv", ["home_team,away_team", *["A,B"] * 40, "A,B,C", "A"])
    result = ingest(lake, SourceSpec("historical_shootouts", "csv", path), slo=Slo(max_dead_pct=50))
    assert (result.rows_loaded, result.rows_dead) == (40, 2)
    letters = {(r._error_type, r._error_detail) for r in lake.read("DEAD_LETTER").collect()}
    assert letters == {("more_values_than_columns", ""), ("null_or_coercion_failure", "away_team")}
    assert "_SURPLUS" not in [c.upper() for c in lake.columns("RAW_HISTORICAL_SHOOTOUTS")]


def test_a_repeated_run_replaces_its_dead_letters(spark, lake):
    dead = spark.createDataFrame([(1, None)], "id int, v string").withColumn("_rejection_reason", F.lit("r"))
    at = F.lit("2026-06-11").cast("timestamp_ntz")
    for run in ("run 'a'", "run 'a'", "b"):
        assert lake.append_dead_letters(dead, "s", run, at, required=["id", "v"]) == 1
    letters = lake.read("DEAD_LETTER")
    assert sorted(r._batch_id for r in letters.collect()) == ["b", "run 'a'"]
    assert {r._error_detail for r in letters.collect()} == {"v"}


def test_rows_without_a_load_time_get_the_default(spark, lake):
    lake.ensure("RAW_T", "id bigint")
    lake.append(spark.range(2), "RAW_T")
    lake.append(spark.range(2, 3).withColumn("_ingested_at", F.lit("2026-06-11 00:00:00").cast("timestamp_ntz")), "RAW_T")
    spark.sql(f"INSERT INTO {lake.name('RAW_T')} (ID) VALUES (3)")
    got = {r.ID: r["_ingested_at"] for r in lake.read("RAW_T").collect()}
    assert got[2].isoformat() == "2026-06-11T00:00:00" and all(got[i].year > 2024 for i in (0, 1, 3))
    assert lake.read("RAW_T").filter("_source_name is null").count() == 4


def test_valid_and_rejected_rows_are_written_without_a_sort(spark, tmp_path):
    """A writer for either value stays open, which takes the place of the sort, and later writes are as before."""
    import pyspark.sql.functions as f
    from goldseam.sources import lake as module

    seen, writer = [], spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    frame = spark.range(10).withColumn("ok", f.col("id") % 2 == 1)

    class Rows:
        sparkSession = spark

        @property
        def write(self):
            seen.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
            return frame.write

    module.write_both(Rows(), "ok", str(tmp_path / "both"))
    assert seen == ["2"] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == writer
    assert [spark.read.parquet(f"{tmp_path}/both/ok={v}").count() for v in ("true", "false")] == [5, 5]
