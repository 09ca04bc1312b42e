"""Incremental loads: nothing twice, nothing lost."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from goldseam.operators.split import REASON, flag_rows
from goldseam.spec import Slo
from goldseam.streaming.incremental import (
    LATE,
    NO_TIME,
    late_rows,
    load_events,
    load_new_files,
    read_loaded,
    write_batch,
)


def test_only_new_files_are_loaded(spark, lake, tmp_path):
    landing, target, checkpoint = (str(tmp_path / x) for x in ("landing", "target", "checkpoint"))
    schema = "id bigint, v string"

    def run():
        stream = spark.readStream.schema(schema).json(landing)
        load_new_files(stream, flag_rows, target, checkpoint, lake, "api", ["id", "v"]).awaitTermination()
        return sorted((r.id, r["_batch_id"]) for r in read_loaded(spark, target).collect())

    spark.createDataFrame([(1, "a"), (2, None)], schema).write.json(landing)
    assert run() == [(1, 0)]
    assert run() == [(1, 0)]
    spark.createDataFrame([(3, "c")], schema).write.mode("append").json(landing)
    assert run() == [(1, 0), (3, 1)]
    assert [r.id for r in read_loaded(spark, target, valid=False).collect()] == [2]
    letters = lake.read("DEAD_LETTER").select("_source", "_batch_id", "_error_detail")
    assert [tuple(r) for r in letters.collect()] == [("api", "batch-0", "v")]
    mark = lake.read("INGESTION_WATERMARKS").first()
    assert (mark.source_name, mark.last_batch_id, mark.rows_loaded) == ("api", "batch-1", 1)


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    target = str(tmp_path / "target")
    batch = flag_rows(spark.range(3).withColumn("v", F.lit("x")))
    write_batch(batch, 0, target)
    write_batch(batch, 0, target)
    write_batch(batch.filter("id > 1"), 1, target)
    assert read_loaded(spark, target).count() == 4


def events_of(spark, landing, schema):
    return spark.readStream.schema(schema).json(landing)


EVENT = "id bigint, at timestamp_ntz, v string"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def run_events(spark, tmp_path, lake=None, slo=None):
    landing, target, checkpoint = (str(tmp_path / x) for x in ("landing", "target", "checkpoint"))
    queries = load_events(
        events_of(spark, landing, EVENT), flag_rows, target, checkpoint, ["id"], "at", "2 days", lake, "api" if lake else None, slo
    )
    for query in queries:
        query.awaitTermination()
    return target


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "landing"))


def test_a_key_is_loaded_once_over_batches(spark, lake, tmp_path):
    arrive(spark, tmp_path, [(1, at(1), "a"), (1, at(1), "a"), (2, at(5), "b"), (3, None, "c")])
    target = run_events(spark, tmp_path, lake)
    arrive(spark, tmp_path, [(2, at(5), "b"), (4, at(9), None), (2, at(5, 3), "b again")])
    run_events(spark, tmp_path, lake)
    # Five days behind: too late to tell whether it is new. The same key again is late as well.
    arrive(spark, tmp_path, [(5, at(2), "late"), (5, at(2, 1), "later"), (6, at(10), "d"), (1, at(1), "a")])
    run_events(spark, tmp_path, lake)
    assert sorted(r.id for r in read_loaded(spark, target).collect()) == [1, 2, 6]
    assert [r.id for r in read_loaded(spark, target, valid=False).collect()] == [4]
    arrived = spark.read.schema(EVENT).json(str(tmp_path / "landing"))
    loaded = read_loaded(spark, target).select("id").unionByName(read_loaded(spark, target, valid=False).select("id"))
    assert [(r.id, r.v, r[REASON]) for r in late_rows(arrived, loaded, ["id"], "at").collect()] == [(5, "later", LATE)]
    letters = lake.read("DEAD_LETTER").select("_source", "_error_type").collect()
    assert sorted(map(tuple, letters)) == [("api", "null_or_coercion_failure"), ("api-no-time", NO_TIME)]


def test_a_batch_below_its_level_is_not_accepted(spark, lake, tmp_path):
    slo = Slo(min_rows=1, max_dead_pct=40.0)
    arrive(spark, tmp_path, [(1, at(1), "a"), (2, at(1), "b")])
    target = run_events(spark, tmp_path, lake, slo)
    first = lake.watermark("api")
    arrive(spark, tmp_path, [(3, at(2), None), (4, at(2), None), (5, at(2), "c")])
    with pytest.raises(Exception, match="66.7% of rows rejected"):
        run_events(spark, tmp_path, lake, slo)
    assert sorted(r.id for r in read_loaded(spark, target, gated=True).collect()) == [1, 2]
    assert lake.watermark("api") == first and not lake.exists("DEAD_LETTER")
    # The rule is changed; the batch is tried again, once.
    run_events(spark, tmp_path, lake, Slo(min_rows=1, max_dead_pct=70.0))
    assert sorted(r.id for r in read_loaded(spark, target, gated=True).collect()) == [1, 2, 5]
    assert sorted(r.id for r in read_loaded(spark, target, valid=False, gated=True).collect()) == [3, 4]
