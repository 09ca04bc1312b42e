"""Tables over several loads: merges by bucket, expiry by day, merged profiles, schema versions, rebuilds, samples."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.jobs import evolution
from goldseam.operators import sketches
from goldseam.operators.infer import infer_types
from goldseam.operators.profile import numeric_kinds, profile_columns, suggest_tests
from goldseam.operators.sample import bottom_rows
from goldseam.plans import adapt, build
from goldseam.plans.graph import Model, ModelGraph
from goldseam.sources.history import VersionedTable, merged_schema, wider

# --- merges ----------------------------------------------------------------

ROW = "id bigint, part string, v int"


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def merged_by_hand(table, updates):
    best = {}
    for key, part, v, gone in updates:
        if (key, part) not in best or v > best[key, part][0]:
            best[key, part] = (v, gone)
    for k, (v, gone) in best.items():
        if gone:
            table.pop(k, None)
        else:
            table[k] = v
    return table


def test_random_merges_equal_a_dictionary(spark, lake):
    pick, table = random.Random(4), {}
    lake.ensure_buckets("t", ROW, ["id", "part"], 8)
    for _ in range(4):
        updates = [(pick.choice([None, *range(30)]), pick.choice(["a", "b", None]), n, pick.random() < 0.3) for n in pick.sample(range(10**6), 40)]
        frame = spark.createDataFrame(updates, ROW + ", gone boolean")
        before = set(table)
        lake.merge(frame, "t", F.col("v"), deleted=F.col("gone"))
        table = merged_by_hand(table, updates)
        got = {(r.id, r.part): r.v for r in lake.read("t", "silver").collect()}
        assert got == table and lake.read("t", "silver").count() == len(table)
    assert before


def test_counts_of_a_merge_and_its_repetition(spark, lake):
    lake.ensure_buckets("t", "id bigint, v int", ["id"], 4)
    first = spark.createDataFrame([(i, 0) for i in range(100)], "id bigint, v int")
    assert lake.merge(first, "t", F.col("v")) == {"inserted": 100, "updated": 0, "deleted": 0, "buckets": 4}
    update = spark.createDataFrame([(5, 1), (6, 1), (200, 1), (7, -1), (300, -1)], "id bigint, v int")
    counts = lake.merge(update, "t", F.col("v"), deleted=F.col("v") < 0)
    assert {k: counts[k] for k in ("inserted", "updated", "deleted")} == {"inserted": 1, "updated": 2, "deleted": 1}
    once = sorted(map(tuple, lake.read("t", "silver").collect()))
    lake.merge(update, "t", F.col("v"), deleted=F.col("v") < 0)
    assert sorted(map(tuple, lake.read("t", "silver").collect())) == once
    assert lake.merge(update.limit(0), "t", F.col("v")) == {"inserted": 0, "updated": 0, "deleted": 0, "buckets": 0}


def test_only_touched_buckets_are_read_and_written(spark, lake):
    lake.ensure_buckets("t", "id bigint, v int", ["id"], 16)
    lake.merge(spark.range(1_000).select("id", F.lit(0).alias("v")), "t", F.col("v"))
    read = lambda: {r.b: r.f for r in lake.read("t", "silver").select(F.col("_bucket").alias("b"), F.input_file_name().alias("f")).distinct().collect()}
    before, files = read(), files_of(lake.root)
    counts = lake.merge(spark.createDataFrame([(17, 9)], "id bigint, v int"), "t", F.col("v"))
    after = read()
    assert counts["buckets"] == 1 and sum(before[b] != after[b] for b in before) == 1
    later = files_of(lake.root)
    assert all(later[f] == t for f, t in files.items())
    # What was written holds the rows of one bucket, not the table.
    new = [f for f in later if f not in files and "updates" not in f]
    assert 0 < spark.read.parquet(*new).count() < 150


def test_a_failing_merge_leaves_the_table(spark, lake):
    lake.ensure_buckets("t", "id bigint, v int", ["id"], 4)
    lake.merge(spark.range(20).select("id", F.lit(0).alias("v")), "t", F.col("v"))
    bad = spark.range(5).select("id", F.raise_error(F.lit("no")).cast("int").alias("v"))
    with pytest.raises(Exception, match="no"):
        lake.merge(bad, "t", F.col("v"))
    assert sorted(map(tuple, lake.read("t", "silver").drop("_bucket").collect())) == [(i, 0) for i in range(20)]
    with pytest.raises(ValueError, match="keys"):
        lake.ensure_buckets("u", "id bigint", ["nope"], 4)


def test_a_key_with_most_updates_is_combined_before_the_shuffle(spark, lake):
    lake.ensure_buckets("t", "id bigint, v bigint", ["id"], 4)
    updates = spark.range(30_000).select((F.col("id") % 3 * F.lit(0) + F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id"))).alias("id"), F.col("id").alias("v"))
    lake.merge(updates, "t", F.col("v"))
    assert lake.read("t", "silver").filter("id = 1").collect()[0].v == 29_999


# --- expiry ----------------------------------------------------------------


def test_days_expire_without_reading_a_file(spark, lake):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i)) for i in range(40)] + [(99, None)]
    frame = spark.createDataFrame(rows, "id bigint, at timestamp_ntz")
    lake.ensure_daily("RAW_T", frame.schema, audit=False)
    assert lake.append_daily(frame, "RAW_T", column="at") == 41
    assert lake.append_daily(frame.limit(0), "RAW_T", column="at") == 0
    before = files_of(lake.root)
    dropped = lake.expire_days("RAW_T", dt.date(2024, 1, 9), days=3)
    assert dropped == [dt.date(2024, 1, d) for d in range(1, 6)]
    after = files_of(lake.root)
    assert set(after) < set(before) and all(before[f] == t for f, t in after.items())
    assert sorted(r.ID for r in lake.read("RAW_T").collect()) == sorted(i for i, at in rows if at is None or at.date() >= dt.date(2024, 1, 6))
    assert lake.expire_days("RAW_T", dt.date(2024, 1, 9), days=3) == []
    # A day that expired can be loaded again.
    lake.append_daily(frame.filter("id < 2"), "RAW_T", column="at")
    assert {0, 1} <= {r.ID for r in lake.read("RAW_T").collect()}


# --- profiles --------------------------------------------------------------

WIDE = "k bigint, few string, blank string, num double, flag boolean, day date, many string, twice bigint"


def some_rows(n):
    return [
        (i, f"v{i % 40}", [" ", None, "", "x"][i % 4], -0.5 * (i % 7), None if i % 3 else i % 2 == 0, dt.date(2024, 1, 1 + i % 25),
         f"m{i % 900}", i if i != 77 else 3)
        for i in range(n)
    ]


def add_in_loads(spark, path, frame, loads):
    store = sketches.ProfileStore(spark, path)
    for load in range(loads):
        store.add(frame.filter(F.pmod(F.col("k"), F.lit(loads)) == load), str(load), numeric_kinds(frame.schema))
    return store


def test_merged_facts_equal_the_exact_profile(spark, tmp_path):
    frame = spark.createDataFrame(some_rows(2_000), WIDE)
    types = numeric_kinds(frame.schema)
    got = {r.column_name: r for r in add_in_loads(spark, str(tmp_path), frame, 3).profile().collect()}
    want = {r.column_name: r for r in profile_columns(frame, types).collect()}
    assert set(got) == set(want)
    for name, row in want.items():
        for fact in ("inferred_type", "null_rate", "sample_count", "is_unique", "ever_negative", "distinct_values"):
            assert got[name][fact] == row[fact], (name, fact)
        if got[name].exact:
            assert got[name].distinct_count == row.distinct_count and got[name].cardinality_ratio == row.cardinality_ratio
        else:
            assert abs(got[name].distinct_count - row.distinct_count) < 0.05 * row.distinct_count
    assert {n for n, r in got.items() if not r.exact} == {"many"}
    assert got["k"].is_unique and not got["twice"].is_unique
    suggested = [sorted(map(str, suggest_tests(p).collect())) for p in (
        add_in_loads(spark, str(tmp_path / "again"), frame, 2).profile(), profile_columns(frame, types))]
    assert suggested[0] == suggested[1]


def test_a_value_repeated_across_loads_is_not_unique(spark, tmp_path):
    store = sketches.ProfileStore(spark, str(tmp_path))
    types = {"k": "int"}
    store.add(spark.range(100).withColumnRenamed("id", "k"), "1", types)
    assert store.profile().first().is_unique
    store.add(spark.range(99, 200).withColumnRenamed("id", "k"), "2", types)
    row = store.profile().first()
    assert not row.is_unique and row.distinct_count == 200 and row.exact
    # The load is corrected: only it is added again.
    store.add(spark.range(100, 200).withColumnRenamed("id", "k"), "2", types)
    assert store.profile().first().is_unique


def test_a_load_is_profiled_without_the_others(spark, tmp_path):
    store = sketches.ProfileStore(spark, str(tmp_path))
    store.add(spark.range(50).withColumnRenamed("id", "k"), "1", {"k": "int"})
    before = files_of(str(tmp_path))
    store.add(spark.range(50, 70).withColumnRenamed("id", "k"), "2", {"k": "int"})
    after = files_of(str(tmp_path))
    assert all(after[f] == t for f, t in before.items()) and len(after) > len(before)
    assert store.profile().first().sample_count == 70


@pytest.mark.parametrize("distinct", [20, 21, 126, 127, 128, 129, 300])
def test_lists_are_whole_or_absent(spark, tmp_path, distinct):
    """Around the bounds of a listed column and of the item sketch, with a value that holds most rows."""
    value = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") / 3).cast("int") % (distinct - 1)))
    frame = spark.range(3_000).select(F.col("id").alias("k"), value.alias("c"))
    got = {r.column_name: r for r in add_in_loads(spark, str(tmp_path), frame, 4).profile().collect()}["c"]
    want = {r.column_name: r for r in profile_columns(frame, numeric_kinds(frame.schema)).collect()}["c"]
    assert got.distinct_values == want.distinct_values
    assert got.distinct_count == want.distinct_count if got.exact else abs(got.distinct_count - want.distinct_count) <= 0.05 * want.distinct_count
    assert got.exact == (want.distinct_count < sketches.FEW)


def test_profiles_of_nothing(spark, tmp_path):
    frame = spark.createDataFrame([], WIDE)
    got = add_in_loads(spark, str(tmp_path), frame, 2).profile().collect()
    assert len(got) == 8 and all(r.null_rate == 0 and r.sample_count == 0 and not r.is_unique and r.distinct_values == [] for r in got)


def test_one_scan_for_all_types(spark):
    frame = spark.createDataFrame(some_rows(10), WIDE)
    path_plan = sketches.column_facts(frame, numeric_kinds(frame.schema))._jdf.queryExecution().executedPlan().toString()
    assert path_plan.count("Scan ExistingRDD") == 1 and path_plan.count("Exchange") == 1


# --- schema versions -------------------------------------------------------


@pytest.mark.parametrize("one, other, want", [
    ("int", "bigint", "bigint"), ("bigint", "decimal(38,0)", "decimal(38,0)"), ("bigint", "double", "double"),
    ("decimal(38,0)", "double", "double"), ("decimal(10,2)", "decimal(8,4)", "decimal(12,4)"), ("int", "decimal(10,2)", "decimal(21,2)"),
    ("decimal(38,30)", "decimal(38,0)", "double"), ("date", "timestamp_ntz", "timestamp_ntz"), ("boolean", "int", "string"),
    ("string", "date", "string"), ("void", "int", "int"), ("float", "int", "float"), ("float", "decimal(10,2)", "double"),
])
def test_wider_types(one, other, want):
    a, b = (T.StructType.fromDDL(f"c {t}").fields[0].dataType for t in (one, other))
    assert wider(a, b).simpleString() == want and wider(b, a).simpleString() == want


def test_versions_are_read_as_written(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no such table"):
        table.read()
    assert table.append(spark.createDataFrame([(1, "a")], "id int, name string")) == (1, 1)
    # Another order or case is no new version.
    assert table.append(spark.createDataFrame([("b", 2)], "NAME string, id int")) == (1, 1)
    before = files_of(str(tmp_path / "t" / "rows"))
    assert table.append(spark.createDataFrame([(2**40, 1.5)], "id bigint, score double")) == (2, 1)
    assert table.append(spark.createDataFrame([("x7", True)], "id string, flag boolean")) == (3, 1)
    # An earlier version may go on.
    assert table.append(spark.createDataFrame([(3, "c")], "id int, name string")) == (1, 1)
    assert all(files_of(str(tmp_path / "t" / "rows"))[f] == t for f, t in before.items())
    got = table.read()
    assert got.schema.simpleString() == "struct<id:string,name:string,score:double,flag:boolean>"
    assert sorted(map(tuple, got.collect())) == [
        ("1", "a", None, None), (str(2**40), None, 1.5, None), ("2", "b", None, None), ("3", "c", None, None), ("x7", None, None, True)]
    two = table.read(2)
    assert two.schema.simpleString() == "struct<id:bigint,name:string,score:double>" and two.count() == 4
    log = {r.version: (r.added, r.widened) for r in table.log().collect()}
    assert log == {1: ("id,name", ""), 2: ("score", "id:int>bigint"), 3: ("flag", "id:bigint>string")}
    with pytest.raises(ValueError, match="collide"):
        table.append(spark.createDataFrame([(1, 2)], "a int, A int"))


def test_merged_schema_keeps_the_first_spelling():
    schemas = [T.StructType.fromDDL(s) for s in ("Id int, b date", "b timestamp_ntz, ID bigint, c int")]
    assert merged_schema(schemas).simpleString() == "struct<Id:bigint,b:timestamp_ntz,c:int>"


# --- rebuilds --------------------------------------------------------------


def chain(*pairs):
    return ModelGraph(Model(name, refs, lambda i: None) for name, refs in pairs)


def test_models_below_a_change():
    graph = chain(("c", ("b",)), ("a", ("RAW_1",)), ("b", ("a", "RAW_2")), ("d", ("RAW_2",)), ("e", ("d", "c")))
    assert graph.sources == ["RAW_1", "RAW_2"]
    assert all(graph.order.index(r) < graph.order.index(m) for m in graph.order for r in graph.models[m].refs if r in graph.models)
    assert graph.below(["RAW_1"]) == [m for m in graph.order if m != "d"]
    assert set(graph.below(["d"])) == {"d", "e"} and graph.below(["e"]) == ["e"]
    with pytest.raises(ValueError, match="no model refers"):
        graph.below(["RAW_9"])
    with pytest.raises(ValueError, match="refer to each other"):
        chain(("a", ("b",)), ("b", ("c",)), ("c", ("a",)))


def test_only_descendants_are_built_again(spark, lake):
    def counted(source):
        return lambda i: i[source].agg(F.count("*").alias("n"))

    graph = ModelGraph([
        Model("one", ("RAW_1",), lambda i: i["RAW_1"]), Model("two", ("RAW_2",), lambda i: i["RAW_2"]),
        Model("sum_one", ("one",), counted("one"), "gold"), Model("sum_two", ("two",), counted("two"), "gold"),
        Model("absent", ("RAW_3",), lambda i: i["RAW_3"]), Model("below_absent", ("absent", "one"), counted("one")),
    ])
    for table in ("RAW_1", "RAW_2"):
        lake.ensure(table, "ID bigint", audit=False)
        lake.reload(spark.range(3).toDF("ID"), table)
    assert set(graph.build(lake)) == {"one", "two", "sum_one", "sum_two"}
    before = files_of(lake.root)
    lake.reload(spark.range(5).toDF("ID"), "RAW_1")
    assert list(graph.build(lake, ["RAW_1"])) == ["one", "sum_one"]
    assert lake.read("sum_one", "gold").first().n == 5 and lake.read("sum_two", "gold").first().n == 3
    assert not [f for f in files_of(lake.root) if f not in before and ("two" in f or "RAW_2" in f)]


def test_layers_name_what_they_read():
    graph = build.layers(F.lit("2026-06-11").cast("date"))
    assert set(graph.sources) == set(build.BRONZE_TABLES.values())
    assert graph.below(["RAW_NATIONAL_TEAMS"]) == ["stg_national_teams", "mart_squad_profile"]


# --- samples ---------------------------------------------------------------


def test_samples_do_not_depend_on_the_cutting(spark, rows):
    frame = spark.range(2_000).select("id", (F.col("id") % 9).cast("string").alias("a b"), F.when(F.col("id") % 2 == 0, "x").alias("n"))
    want = rows(bottom_rows(frame, 50))
    assert len(want) == 50
    assert all(rows(bottom_rows(frame.repartition(n), 50)) == want for n in (1, 3, 11))
    parts = [bottom_rows(frame.filter(F.col("id") % 2 == p), 50) for p in (0, 1)]
    assert rows(bottom_rows(parts[0].unionByName(parts[1]), 50)) == want
    assert bottom_rows(frame, 5_000).count() == 2_000 and rows(bottom_rows(frame, 50, seed=1)) != want


def test_a_sample_is_taken_without_sorting_all_rows(spark):
    """Each task keeps its least rows; the caller's stripping must not turn that into a sort by ranges."""
    frame = spark.range(1_000).select(F.col("id").cast("string").alias("a"), F.lit(" x").alias("b"))
    plan = infer_types(frame, sample_rows=20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_parts_become_more_with_more_rows(spark, monkeypatch):
    dealt, lines = [], "/root/testdata/sf0.001"
    monkeypatch.setattr(evolution, "PART_ROWS", 1_000)
    monkeypatch.setattr(evolution, "infer_types", lambda df, sample_rows: dealt.append(df.rdd.getNumPartitions()) or infer_types(df, sample_rows))
    evolution.sample_types(spark, lines)
    assert dealt[1] == 7 + spark.read.parquet(f"{lines}/lineitem.parquet").count() // 1_000


def test_arrivals_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    folders = []
    monkeypatch.setattr(evolution, "scratch_path", lambda spark, label: folders.append(str(tmp_path / label)) or folders[-1])
    monkeypatch.setattr(adapt, "table", lambda s, d, name: s.read.parquet(f"{d}/{name}.parquet").repartition(3))
    evolution.events_once(spark, "/root/testdata/sf0.001")
    assert len(files_of(folders[0])) > 6  # three arrivals, not a file each
