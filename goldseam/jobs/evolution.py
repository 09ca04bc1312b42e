"""Registered queries on tables over several loads: merges, expiry, profiles, schemas, repeated and late rows, rebuilds."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.jobs.inputs import ANALYTICS, with_inputs
from goldseam.jobs.layers import _STAGED_GOALS, built_layers, new_lake
from goldseam.jobs.squads import as_of
from goldseam.operators.infer import infer_types
from goldseam.operators.profile import numeric_kinds, suggest_tests
from goldseam.operators.sample import bottom_rows
from goldseam.operators.sketches import ProfileStore
from goldseam.operators.split import REASON, flag_rows
from goldseam.plans import adapt, build
from goldseam.session import scratch_path
from goldseam.sources.history import VersionedTable
from goldseam.spec import Slo
from goldseam.streaming.incremental import late_rows, load_events, read_loaded


def bucket_merge(spark, sf_dir):
    """Orders merged by key three times: all of them, then changed and new ones, then repeated changes and deletions."""
    orders = adapt.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    one = orders.groupBy("o_orderkey").agg(F.max_by(F.struct(*orders.columns), F.struct("o_totalprice", "o_custkey")).alias("r")).select("r.*")
    lake, key = new_lake(spark), F.col("o_orderkey")
    lake.ensure_buckets("orders", one.schema, ["o_orderkey"], 16)
    version = F.col("o_totalprice")
    lake.merge(one.filter(key % 5 != 0), "orders", version)
    # Every update comes twice; the dearer one counts.
    changed = one.filter(key % 10 < 2).withColumn("o_orderstatus", F.lit("U"))
    lake.merge(changed.unionByName(changed.withColumn("o_totalprice", F.col("o_totalprice") + 1)), "orders", version)
    lake.merge(one.filter(key % 7 == 0), "orders", version, deleted=key % 14 == 0)
    return lake.read("orders", "silver").drop("_bucket")


def profile_merged(spark, sf_dir):
    """Facts of lines and orders from three loads each, profiled one by one and merged, with the tests they suggest."""
    frames = []
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        rows = adapt.table(spark, sf_dir, name)
        rows = rows.withColumn("sparse", F.when(F.col(key) % 9 == 0, F.concat(F.lit(" v"), F.col(key) % 5)))
        store, types = ProfileStore(spark, scratch_path(spark, "profile")), numeric_kinds(rows.schema)
        for load in range(3):
            store.add(rows.filter(F.col(key) % 3 == load), str(load), types)
        profile = store.profile()
        tests = suggest_tests(profile).select("column_name", "tests", "nonnegative")
        frames.append(profile.join(tests, "column_name").select(
            F.lit(name).alias("table_name"), "column_name", "null_rate", "sample_count", "is_unique", "ever_negative",
            F.when(F.col("is_unique") | (F.size("distinct_values") > 0), F.col("distinct_count")).alias("distinct_count"),
            F.array_join("distinct_values", "|").alias("distinct_values"), "least", "greatest",
            F.array_join("tests", ",").alias("tests"), "nonnegative",
        ))
    return reduce(DataFrame.unionByName, frames)


def retention_drop(spark, sf_dir):
    """Events laid out by day, of which the oldest days expire; rows without a time stay."""
    events = adapt.table(spark, sf_dir, "events")
    events = events.withColumn("ts", F.when(F.col("event_id") % 101 != 0, F.col("ts")))
    lake = new_lake(spark)
    lake.ensure_daily("RAW_EVENTS", events.schema, audit=False)
    for share in range(2):
        lake.append_daily(events.filter(F.col("event_id") % 2 == share), "RAW_EVENTS", column="ts")
    for _ in range(2):
        lake.expire_days("RAW_EVENTS", dt.date(2024, 4, 20))
    return lake.read("RAW_EVENTS").drop("_ingested_on").toDF(*events.columns)


#: Bounds of the three arrivals, one after another, and how late a row may be.
FIRST, SECOND, DELAY = "2024-01-12 00:00:00", "2024-01-20 00:00:00", "2 days"


def events_once(spark, sf_dir):
    """Three arrivals of events: some come again in the next one, some without a time, some far too late in the last."""
    landing, target, checkpoint = (scratch_path(spark, x) for x in ("landing", "once", "stream"))
    events = adapt.table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 50 != 0, F.col("ts")))
    held_back = F.coalesce((F.col("ts") < F.lit("2024-01-04 00:00:00").cast("timestamp_ntz")) & (F.col("event_id") % 4 == 0), F.lit(False))

    def between(low: str, high: str):
        return F.col("ts").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))

    first = events.filter(~held_back & (F.col("ts").isNull() | (F.col("ts") < F.lit(FIRST).cast("timestamp_ntz"))))
    again = events.filter(between("2024-01-11 00:00:00", FIRST) & (F.col("ts") < F.lit(FIRST).cast("timestamp_ntz")))
    second = events.filter(between(FIRST, SECOND) & (F.col("ts") < F.lit(SECOND).cast("timestamp_ntz"))).unionByName(again)
    third = events.filter(F.col("ts") >= F.lit(SECOND).cast("timestamp_ntz"))
    third = third.unionByName(third.filter("event_id % 3 = 0")).unionByName(events.filter(held_back))
    slo = Slo(min_rows=1, max_dead_pct=50.0)
    for arrived in (first, second, third):
        arrived.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(events.schema).parquet(landing)

        def flag(batch):
            return flag_rows(batch.withColumn("value", F.when(F.col("value") <= 400, F.col("value"))))

        for query in load_events(stream, flag, target, checkpoint, ["event_id"], "ts", DELAY, slo=slo):
            query.awaitTermination()
    loaded, rejected = read_loaded(spark, target, gated=True), read_loaded(spark, target, valid=False, gated=True)
    seen = loaded.select("event_id", F.lit("loaded").alias("outcome")).unionByName(
        rejected.select("event_id", F.lit("rejected").alias("outcome"))
    )
    late = late_rows(spark.read.parquet(landing), seen, ["event_id"], "ts").select("event_id", F.col(REASON).alias("outcome"))
    untimed = read_loaded(spark, f"{target}-no-time", valid=False).select("event_id", F.col(REASON).alias("outcome"))
    return seen.unionByName(late).unionByName(untimed)


def graph_rebuild(spark, sf_dir):
    """A change of the goals' Bronze table: its two descendants are built again, with the rows they then have."""
    lake, _ = built_layers(spark, sf_dir)
    table = build.BRONZE_TABLES["stg_historical_goals"]
    lake.reload(lake.read(table).filter("PENALTY = false or PENALTY is null"), table)
    built = build.layers(as_of()).build(lake, [table])
    goals = built["mart_goal_analytics"].select("team", "total_goals", "penalty_goals", "first_half_goals", "unique_scorers")
    return goals.withColumn("built", F.lit(",".join(built)))


def schema_versions(spark, sf_dir):
    """Customers in three loads of different columns and types, read as one table."""
    customers = adapt.table(spark, sf_dir, "customer")
    table, share = VersionedTable(spark, scratch_path(spark, "versions")), F.col("c_custkey") % 3
    table.append(customers.filter(share == 0).select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey")))
    table.append(customers.filter(share == 1).select(
        "c_custkey", "c_name", F.col("c_nationkey").cast("decimal(38,0)").alias("c_nationkey"), "c_mktsegment"))
    table.append(customers.filter(share == 2).select(
        "c_mktsegment", "c_custkey", (F.col("c_nationkey") + 0.5).cast("double").alias("c_nationkey"), "c_acctbal"))
    log = table.log().filter("version > 1").select(F.concat_ws(" ", "version", "added", "widened").alias("note"))
    return table.read().unionByName(log.select(F.col("note").alias("c_name")), allowMissingColumns=True)


#: Lines per part when a table is dealt anew: the parts become more, not larger, with more lines.
PART_ROWS = 250_000


def sample_types(spark, sf_dir):
    """What 200 rows of the lines say of their columns, the same 200 from one file or from many."""
    rows = adapt.table(spark, sf_dir, "lineitem")
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    more = rows.count() // PART_ROWS
    whole, parts = (infer_types(f, sample_rows=200) for f in (text, text.repartition(7 + more)))
    agree = whole.join(parts.withColumnRenamed("inferred_type", "again"), "column_name")
    other = bottom_rows(text.repartition(5 + more), 200).exceptAll(bottom_rows(text, 200)).agg(F.count("*").alias("n"))
    return agree.select("column_name", "inferred_type", (F.col("again") == F.col("inferred_type")).alias("same")).unionByName(
        other.select(F.lit("rows").alias("column_name"), F.lit("").alias("inferred_type"), (F.col("n") == 0).alias("same"))
    )


QUERIES = {
    "bucket_merge": bucket_merge,
    "profile_merged": profile_merged,
    "retention_drop": retention_drop,
    "events_once": events_once,
    "graph_rebuild": graph_rebuild,
    "schema_versions": schema_versions,
    "sample_types": sample_types,
}


def _facts_sql(table: str, key: str, columns: dict[str, str]) -> str:
    """Facts of a table's columns; ``columns`` gives the kind of each."""
    parts = []
    for column, kind in columns.items():
        value = f"nullif(trim({column}::varchar), '')" if kind == "str" else f"{column}::varchar"
        negative = f"bool_or({column} < 0)" if kind in ("int", "float") else "null::boolean"
        parts.append(f"""select '{table}' as table_name, '{column}' as column_name, '{kind}' as kind, count(*) as n,
            count({value}) as present, count(distinct {value}) as different, {negative} as negative,
            min({value}) as least, max({value}) as greatest,
            case when count(distinct {value}) between 1 and 20 then string_agg(distinct {value}, '|' order by {value}) else '' end as listed
            from (select *, case when {key} % 9 = 0 then ' v' || ({key} % 5)::varchar end as sparse from {table})""")
    return " union all ".join(parts)


_LINE = {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "float",
         "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "str", "l_linestatus": "str",
         "l_shipdate": "str", "sparse": "str"}
_ORDER = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "float", "o_orderdate": "str",
          "o_orderpriority": "str", "sparse": "str"}

ORACLE = {
    "bucket_merge": """with one as (
          select o_orderkey, arg_max(o_custkey, (o_totalprice, o_custkey)) as o_custkey,
            arg_max(o_orderstatus, (o_totalprice, o_custkey)) as o_orderstatus, max(o_totalprice) as o_totalprice
          from orders group by o_orderkey)
        select o_orderkey, o_custkey,
          case when o_orderkey % 10 < 2 and o_orderkey % 7 <> 0 then 'U' else o_orderstatus end as o_orderstatus,
          case when o_orderkey % 10 < 2 and o_orderkey % 7 <> 0 then o_totalprice + 1 else o_totalprice end as o_totalprice
        from one where (o_orderkey % 5 <> 0 or o_orderkey % 10 < 2 or o_orderkey % 7 = 0) and o_orderkey % 14 <> 0""",
    "profile_merged": f"""with facts as ({_facts_sql('lineitem', 'l_orderkey', _LINE)} union all {_facts_sql('orders', 'o_orderkey', _ORDER)}),
        judged as (select *, present >= 10 and different = present as is_unique from facts)
        select table_name, column_name, (n - present)::double / n as null_rate, present as sample_count, is_unique,
          negative as ever_negative, case when is_unique or listed <> '' then different end as distinct_count,
          listed as distinct_values, least, greatest,
          concat_ws(',', case when (n - present)::double / n <= 0.05 then 'not_null' end, case when is_unique then 'unique' end) as tests,
          kind in ('int', 'float') and coalesce(not negative, false) and present > 0 as nonnegative
        from judged""",
    "retention_drop": """select event_id, case when event_id % 101 <> 0 then ts end as ts, user_id, event_type, value, props
        from events where event_id % 101 = 0 or cast(ts as date) >= date '2024-04-20' - interval 90 day""",
    "events_once": """select event_id, case when event_id % 50 = 0 then 'no_event_time'
          when ts < timestamp '2024-01-04 00:00:00' and event_id % 4 = 0 then 'late_row'
          when value > 400 then 'rejected' else 'loaded' end as outcome from events""",
    "graph_rebuild": with_inputs(
        """select team, count(*) as total_goals, count(*) filter (where penalty) as penalty_goals,
             count(*) filter (where minute_bucket in ('0-15', '16-30', '31-45')) as first_half_goals,
             count(distinct scorer) as unique_scorers, 'stg_historical_goals,mart_goal_analytics' as built
           from bucketed where not penalty group by team""",
        _STAGED_GOALS, ANALYTICS,
    ),
    "schema_versions": """
        select c_custkey, case when c_custkey % 3 <> 2 then c_name end as c_name,
          c_nationkey + case when c_custkey % 3 = 2 then 0.5 else 0 end::double as c_nationkey,
          case when c_custkey % 3 <> 0 then c_mktsegment end as c_mktsegment, case when c_custkey % 3 = 2 then c_acctbal end as c_acctbal
        from customer
        union all select null, '2 c_mktsegment c_custkey:int>bigint,c_nationkey:int>decimal(38,0)', null, null, null
        union all select null, '3 c_acctbal c_nationkey:decimal(38,0)>double', null, null, null""",
    "sample_types": "select column_name, inferred_type, true as same from (values "
    + ", ".join(f"('{c}', '{t}')" for c, t in (
        ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"), ("l_quantity", "int"),
        ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "str"),
        ("l_linestatus", "str"), ("l_shipdate", "str"), ("rows", ""))) + ") t(column_name, inferred_type)",
}
