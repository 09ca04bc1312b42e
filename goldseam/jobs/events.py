"""Registered queries on events: coercion of text, files, incremental loads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from goldseam.functions import coerce
from goldseam.functions.casts import lenient_time
from goldseam.jobs.inputs import with_inputs
from goldseam.operators.flatten import flatten_children, flatten_parents
from goldseam.operators.governance import within_retention
from goldseam.operators.infer import infer_json_types
from goldseam.operators.split import dead_rows, flag_null_key, flag_rows, valid_rows
from goldseam.operators.state import newer_than, unseen
from goldseam.plans import adapt
from goldseam.session import scratch_path
from goldseam.sources.files import read_csv_typed, read_match_documents
from goldseam.sources.lake import Lake
from goldseam.streaming.incremental import load_new_files, read_loaded

CUTOFF = dt.datetime(2024, 1, 10)
#: Events per group of three arrays, so that files of arrays are large, and more of them come with more events.
ARRAY_EVENTS = 2_000_000


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value and key as text, written the many ways that files contain."""
    events = adapt.table(spark, sf_dir, "events")
    value, key = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    form = F.col("event_id") % 12
    text = (
        F.when(form == 0, value)
        .when(form == 1, F.concat(F.lit(" \t"), value, F.lit("\n ")))
        .when(form == 2, F.concat(F.lit("-"), key))
        .when(form == 3, F.concat(key, F.lit("e2")))
        .when(form == 4, F.concat(F.lit("1_0"), key))
        .when(form == 5, F.concat(key, F.lit("d")))
        .when(form == 6, F.lit(""))
        .when(form == 7, F.concat(F.lit(" "), F.col("event_type")))
        .when(form == 8, F.lit("   "))
        .when(form == 9, F.concat(F.lit("."), key))
        .when(form == 10, F.concat(F.lit("9876543210"), F.lpad(key, 10, "0")))
    )
    words = F.array(*[F.lit(w) for w in ("TRUE", " y ", "0", "maybe", "1", "Yes", "f", "\tt\n", "", "no")])
    word = F.get(words, (F.col("user_id") % 11).cast("int"))
    return events.select("event_id", text.alias("raw"), word.alias("word"))


def coerce_strict(spark, sf_dir):
    """Database rules: truth of any text, no fractions for integers, no stripping."""
    rows = messy(spark, sf_dir)
    return rows.select(
        "event_id",
        coerce.coerce_strict(F.col("raw"), "bool").alias("as_bool"),
        coerce.coerce_strict(F.col("raw"), "int").alias("as_int"),
        coerce.coerce_strict(F.col("raw"), "float").alias("as_float"),
        coerce.coerce_strict(F.col("raw"), "str").alias("as_str"),
    )


def clock(spark, sf_dir):
    """Times of day, some with seconds, some with a zone, some impossible."""
    events = adapt.table(spark, sf_dir, "events")
    form = F.col("event_id") % 4
    text = (
        F.when(form == 0, F.date_format("ts", "HH:mm"))
        .when(form == 1, F.date_format("ts", "H:mm:ss"))
        .when(form == 2, F.concat(F.date_format("ts", "HH:mm"), F.lit(" UTC-6")))
        .otherwise(F.concat(F.lit("25:"), F.date_format("ts", "mm")))
    )
    return events.select("event_id", lenient_time(text).alias("clock"))


def src_csv_typed(spark, sf_dir):
    """Events written as CSV, then read back with coercion to their types."""
    path = scratch_path(spark, "csv")
    events = adapt.table(spark, sf_dir, "events")
    note = F.concat(F.col("event_type"), F.lit(',\n"'), F.get_json_object("props", "$.k"), F.lit('"'))
    (
        events.select(
            F.col("event_id").cast("string").alias("event_id"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
            F.col("value").cast("string").alias("value"),
            (F.col("event_type") == "click").cast("string").alias("is_click"),
            "props",
            note.alias("note"),
        ).write.csv(path, header=True, quote='"', escape='"')
    )
    types = {"event_id": "int", "ts": "str", "value": "float", "is_click": "bool", "props": "str", "note": "str"}
    return read_csv_typed(spark, path, types)


def src_csv_folder(spark, sf_dir):
    """Events in one folder of CSV files: two orders of columns, one column only some have, and values with line breaks."""
    path = scratch_path(spark, "csv")
    events = adapt.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("value").cast("string").alias("value"),
        "event_type",
        "props",
    )
    form = F.col("event_id").cast("bigint") % 3
    lines = F.concat(F.col("event_type"), F.lit("\n"), F.col("user_id")).alias("event_type")
    for part in (
        events.filter(form == 0),
        events.filter(form == 1).select("props", "event_type", "value", "event_id", "user_id"),
        events.filter(form == 2).select(lines, "event_id", "props", "value"),
    ):
        part.write.mode("append").csv(path, header=True, quote='"', escape='"')
    types = {"event_id": "int", "user_id": "int", "value": "float", "event_type": "str", "props": "str"}
    return read_csv_typed(spark, path, types, cut=True)


def seed_load(spark, sf_dir):
    """A seed file whose columns are all text, whatever they look like: codes keep their zeros."""
    path = scratch_path(spark, "seed")
    nations = adapt.table(spark, sf_dir, "nation")
    code = F.format_string("%04d", F.col("n_nationkey"))
    nations.select(code.alias("code"), F.concat(F.lit(" "), "n_name").alias("former"), F.lit("1.0").alias("current"), F.lit("2024-01-01").alias("since")).write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False
    )
    return read_csv_typed(spark, path, dict.fromkeys(("code", "former", "current", "since"), "str"))


def wide_integers(spark, sf_dir):
    """Whole numbers at and beyond the bounds of doubles and of 64 bits, each with the event's own digits."""
    events = adapt.table(spark, sf_dir, "events")
    heads = F.array(*[F.lit(h) for h in ("", "-", "900719925474", "922337203685477", "98765432109876", " +1_0")])
    raw = F.concat(F.get(heads, (F.col("event_id") % 6).cast("int")), F.lpad(F.col("event_id").cast("string"), 12, "7"))
    return events.select("event_id", coerce.coerce_wide_int(raw).cast("string").alias("as_wide"))


def dead_letter_sink(spark, sf_dir):
    """Events with gaps are rejected into the dead-letter table; the load runs twice and leaves them there once."""
    events = adapt.table(spark, sf_dir, "events").withColumns(
        {
            "value": F.when(F.col("user_id") % 7 != 0, F.col("value")),
            "ts": F.when(F.col("event_id") % 50 != 0, F.col("ts")),
        }
    )
    lake = _events_lake(spark, events)
    at = F.lit("2026-06-11 00:00:00").cast("timestamp_ntz")
    for _ in range(2):
        *_, folder, dead = lake.reload_split(flag_rows(events), "RAW_EVENTS")
        lake.append_dead_letters(dead, "events", "run-1", at, required=events.columns)
        lake.point("RAW_EVENTS", folder)
    letters = lake.read("DEAD_LETTER").select(
        F.col("_source").alias("source"),
        F.col("_batch_id").alias("batch"),
        F.col("_error_type").alias("error_type"),
        F.col("_error_detail").alias("error_detail"),
        F.variant_get("_raw_payload", "$.event_id", "long").alias("event_id"),
        F.variant_get("_raw_payload", "$.event_type", "string").alias("event_type"),
    )
    kept = lake.read("RAW_EVENTS").select(F.col("EVENT_ID").alias("event_id"), F.col("EVENT_TYPE").alias("event_type"))
    return letters.unionByName(kept, allowMissingColumns=True)


def documents(events: DataFrame) -> DataFrame:
    """One match document per event: two matches, some without score or goals."""
    k = F.get_json_object("props", "$.k").cast("int")
    even = F.col("event_id") % 2 == 0
    goal = F.struct(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("name"),
        (k % 90).cast("string").alias("minute"),
        F.when(F.col("event_type") == "error", F.lit(True)).alias("owngoal"),
        (F.col("event_type") == "purchase").alias("penalty"),
    )
    full = F.struct(
        F.array(k % 5, k % 3).alias("ft"), F.array(k % 2).alias("ht")  # half time: one of two scores
    )
    goals = F.array_repeat(goal, k % 4)

    def match(team1: str, team2: str, scored: bool):
        score = full if scored else F.when(even, full)
        return F.struct(
            F.date_format("ts", "yyyy-MM-dd").alias("date"),
            F.date_format("ts", "HH:mm").alias("time"),
            F.concat(F.lit("Round "), (k % 7).cast("string")).alias("round"),
            F.when(even, F.lit("Group A")).alias("group"),
            F.col("event_type").alias("ground"),
            F.lit(team1).alias("team1"),
            F.lit(team2).alias("team2"),
            score.alias("score"),
            goals.alias("goals1"),
            (F.when(even, goals) if scored else F.slice(goals, 1, 1)).alias("goals2"),
        )

    return events.select("event_id", F.array(match("Alpha", "Beta", True), match("Gamma", "Delta", False)).alias("matches"))


def src_json_nested(spark, sf_dir):
    """Nested documents through a landing folder, one per line, then flattened to matches."""
    path = scratch_path(spark, "json")
    documents(adapt.table(spark, sf_dir, "events")).drop("event_id").write.json(path)
    read = read_match_documents(spark, path, multi_line=False)
    goals = flatten_children(read).groupBy("match_num", "match_date", "scoring_team").agg(
        F.count("*").alias("n_goals"), F.count_if("is_own_goal").alias("n_own_goals")
    )
    matches = flatten_parents(read).groupBy("match_num", "match_date", "team1_name", "team2_name").agg(
        F.count("*").alias("n_matches"),
        F.sum("score_ft_team1").alias("ft1"),
        F.sum("score_ft_team2").alias("ft2"),
        F.sum("score_ht_team1").alias("ht1"),
        F.count("score_ht_team2").alias("n_ht2"),
    )
    return (
        matches.withColumn("scoring_team", F.explode(F.array("team1_name", "team2_name")))
        .join(goals, ["match_num", "match_date", "scoring_team"], "left")
        .fillna(0, ["n_goals", "n_own_goals"])
    )


def src_json_array(spark, sf_dir):
    """The documents as files of one array each, without line breaks at document ends, cut into documents by many tasks."""
    path = scratch_path(spark, "json")
    docs = documents(adapt.table(spark, sf_dir, "events").withColumn("event_type", F.concat("event_type", F.lit('} "\\ ]'))))
    part = F.floor(F.col("event_id") / ARRAY_EVENTS) * 3 + F.col("event_id") % 3
    lines = docs.select(part.alias("part"), F.col("event_id").alias("at"), F.concat(F.lit(","), F.to_json(F.struct("matches"))).alias("value"))
    ends = docs.select(part.alias("part")).distinct().select("part", F.inline(F.array(
        F.struct(F.lit(-1).cast("long").alias("at"), F.lit("[null").alias("value")),
        F.struct(F.lit(2**62).alias("at"), F.lit("]").alias("value")),
    )))
    lines = lines.unionByName(ends).repartition("part").sortWithinPartitions("part", "at").select("part", "value")
    lines.write.partitionBy("part").option("lineSep", " ").text(path)
    read = read_match_documents(spark, path, cut=True)
    return flatten_parents(read).groupBy("match_date", "team1_name", "ground").agg(
        F.count("*").alias("n_matches"), F.sum("score_ft_team1").alias("ft1"), F.sum("score_ft_team2").alias("ft2")
    )


def infer_json(spark, sf_dir):
    """Types of the fields of JSON lines; odd rows hold other types or nulls."""
    events = adapt.table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    line = F.to_json(
        F.struct(
            "event_id",
            "value",
            "event_type",
            (F.col("user_id") > 10).alias("is_late"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            F.lit(None).cast("string").alias("nothing"),
        ),
        {"ignoreNullFields": "false"},
    )
    # A boolean among whole numbers is a whole number; a text among them makes text.
    mixed = F.when(even, F.lit(',"mixed":1,"texts":2}')).otherwise(F.lit(',"mixed":true,"texts":"x"}'))
    rows = events.select(F.parse_json(F.concat(F.rtrim(line, F.lit("}")), mixed)).alias("doc"))
    return infer_json_types(rows, "doc")


def _events_lake(spark, events) -> Lake:
    path = scratch_path(spark, "lake")
    lake = Lake(spark, path, prefix=path.rsplit("-", 1)[1][:8] + "_")
    lake.ensure("RAW_EVENTS", events.schema, audit=False)
    return lake


def incremental_load(spark, sf_dir):
    """Two loads: the first up to a day, the second whatever is newer than its watermark."""
    events = adapt.table(spark, sf_dir, "events")
    lake = _events_lake(spark, events)
    for run, available in (("run-1", events.filter(F.col("ts") <= F.lit(CUTOFF))), ("run-2", events)):
        seen = Observation()
        new = newer_than(available, "ts", lake.watermark("events")).observe(seen, F.max("ts").alias("last"))
        rows = lake.append(new, "RAW_EVENTS")
        last = seen.get["last"] or lake.watermark("events")
        lake.move_watermark("events", last, rows, run, updated_at=F.lit(last))
    loaded = lake.read("RAW_EVENTS").groupBy(F.col("event_type").alias("item"))
    mark = lake.read("INGESTION_WATERMARKS").select(
        F.col("last_batch_id").alias("item"), F.col("rows_loaded").alias("n"), F.col("last_loaded_at").alias("at")
    )
    return loaded.agg(F.count("*").alias("n"), F.max("ts").alias("at")).unionByName(mark)


def incremental_late(spark, sf_dir):
    """Two loads of events of which some have no time and some arrive late: the first are rejected, the second found."""
    no_time, late = F.col("event_id") % 50 == 0, F.col("event_id") % 33 == 0
    events = adapt.table(spark, sf_dir, "events").withColumn("ts", F.when(~no_time, F.col("ts")))
    lake, overlap = _events_lake(spark, events), dt.timedelta(days=400)
    at = F.lit("2026-06-11 00:00:00").cast("timestamp_ntz")
    early = events.filter(no_time | ((F.col("ts") <= F.lit(CUTOFF)) & ~late))
    for run, available in (("run-1", early), ("run-2", events.filter(~no_time))):
        flagged, mark = flag_null_key(available, "ts", "null_ts"), lake.watermark("events")
        if mark is None:
            lake.append_dead_letters(dead_rows(flagged), "events", run, at, required=["ts"])
        new = unseen(
            newer_than(valid_rows(flagged), "ts", mark, overlap), lake.read("RAW_EVENTS"), "event_id", "ts", mark, overlap
        )
        seen = Observation()
        rows = lake.append(new.observe(seen, F.max("ts").alias("last")), "RAW_EVENTS")
        last = seen.get["last"] or mark
        lake.move_watermark("events", last, rows, run, updated_at=F.lit(last))
    letters = lake.read("DEAD_LETTER").select(
        F.variant_get("_raw_payload", "$.event_id", "long").alias("event_id"),
        F.concat_ws(":", "_batch_id", "_error_type", "_error_detail").alias("outcome"),
    )
    return letters.unionByName(lake.read("RAW_EVENTS").select(F.col("EVENT_ID").alias("event_id"), F.lit("loaded").alias("outcome")))


def incremental_stream(spark, sf_dir):
    """Files that arrive between two runs of a stream; each is loaded once, split into valid and rejected."""
    landing, target, checkpoint = (scratch_path(spark, x) for x in ("landing", "loaded", "stream"))
    events = adapt.table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") <= 400, F.col("value")))
    late = F.col("ts") > F.lit(CUTOFF)
    for arrived in (events.filter(~late), events.filter(late)):
        arrived.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(events.schema).parquet(landing)
        load_new_files(stream, flag_rows, target, checkpoint).awaitTermination()
    return read_loaded(spark, target).select("*", F.col("_batch_id").cast("int").alias("batch")).drop("_batch_id")


def retention(spark, sf_dir):
    events = adapt.table(spark, sf_dir, "events")
    as_of = F.lit("2024-04-20 00:00:00").cast("timestamp_ntz")
    return within_retention(events, as_of, "ts")


QUERIES = {
    "coerce_bool": lambda s, d: messy(s, d).select("event_id", coerce.coerce_bool(F.col("word")).alias("as_bool")),
    "coerce_int": lambda s, d: messy(s, d).select("event_id", coerce.coerce_int(F.col("raw")).alias("as_int")),
    "coerce_float": lambda s, d: messy(s, d).select("event_id", coerce.coerce_float(F.col("raw")).alias("as_float")),
    "coerce_str": lambda s, d: messy(s, d).select("event_id", coerce.coerce_str(F.col("raw")).alias("as_str")),
    "coerce_strict": coerce_strict,
    "lenient_time": clock,
    "src_csv_typed": src_csv_typed,
    "src_csv_folder": src_csv_folder,
    "seed_load": seed_load,
    "coerce_wide_int": wide_integers,
    "dead_letter_sink": dead_letter_sink,
    "src_json_nested": src_json_nested,
    "src_json_array": src_json_array,
    "infer_json": infer_json,
    "incremental_load": incremental_load,
    "incremental_late": incremental_late,
    "incremental_stream": incremental_stream,
    "retention": retention,
}

_MESSY = r"""messy as (
  select event_id, case event_id % 12
      when 0 then v when 1 then ' ' || chr(9) || v || chr(10) || ' ' when 2 then '-' || k when 3 then k || 'e2'
      when 4 then '1_0' || k when 5 then k || 'd' when 6 then '' when 7 then ' ' || event_type when 8 then '   '
      when 9 then '.' || k when 10 then '9876543210' || lpad(k, 10, '0') end as raw,
    ['TRUE', ' y ', '0', 'maybe', '1', 'Yes', 'f', chr(9) || 't' || chr(10), '', 'no'][cast(user_id % 11 as int) + 1] as word
  from (select *, cast(value as varchar) as v, json_extract_string(props, '$.k') as k from events)),
stripped as (
  select *, trim(raw, ' ' || chr(9) || chr(10)) as s from messy),
numbers as (
  select *, case when regexp_full_match(s, '[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d+)?')
                 then cast(replace(s, '_', '') as double) end as x from stripped)"""


def _messy(query: str) -> str:
    return with_inputs(query, _MESSY)


_DOCS = """docs as (
  select *, cast(json_extract_string(props, '$.k') as int) as k, event_id % 2 = 0 as even from events),
matches as (
  select 0 as match_num, 'Alpha' as team1, 'Beta' as team2, true as scored,
         k % 4 as n1, case when even then k % 4 else 0 end as n2, * from docs
  union all
  select 1, 'Gamma', 'Delta', even, k % 4, case when k % 4 > 0 then 1 else 0 end, * from docs),
sides as (
  select *, team1 as scoring_team, n1 as n from matches union all select *, team2, n2 from matches)"""

ORACLE = {
    "coerce_bool": _messy(
        """select event_id, case when word <> '' then
             trim(lower(word), ' ' || chr(9) || chr(10)) in ('true', '1', 'yes', 't', 'y') end as as_bool from messy"""
    ),
    "coerce_int": _messy(
        "select event_id, case when abs(x) < 9.2e18 then cast(trunc(x) as bigint) end as as_int from numbers"
    ),
    "coerce_float": _messy("select event_id, x as as_float from numbers"),
    "coerce_str": _messy("select event_id, case when raw <> '' then s end as as_str from stripped"),
    "coerce_strict": _messy(
        r"""select event_id, raw <> '' as as_bool,
              case when regexp_full_match(s, '[+-]?\d(_?\d)*') then try_cast(replace(s, '_', '') as bigint) end as as_int,
              x as as_float, raw as as_str from numbers"""
    ),
    "lenient_time": """select event_id, case event_id % 4 when 0 then strftime(ts, '%H:%M:00')
                       when 1 then strftime(ts, '%H:%M:%S') end as clock from events""",
    "src_csv_typed": """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, value, event_type = 'click' as is_click,
                        props, event_type || ',' || chr(10) || '"' || json_extract_string(props, '$.k') || '"' as note
                        from events""",
    "src_csv_folder": """select event_id, case when event_id % 3 <> 2 then user_id end as user_id, value,
                         case when event_id % 3 = 2 then event_type || chr(10) || user_id else event_type end as event_type,
                         props from events""",
    "seed_load": """select lpad(cast(n_nationkey as varchar), 4, '0') as code, n_name as former, '1.0' as current,
                      '2024-01-01' as since from nation""",
    "coerce_wide_int": """select event_id, cast(trim(['', '-', '900719925474', '922337203685477', '98765432109876', '10'][
                            cast(event_id % 6 as int) + 1] || lpad(cast(event_id as varchar), 12, '7')) as decimal(38,0))::varchar
                          as as_wide from events""",
    "dead_letter_sink": """
        select 'events' as source, 'run-1' as batch, 'null_or_coercion_failure' as error_type,
          concat_ws(',', case when event_id % 50 = 0 then 'ts' end, case when user_id % 7 = 0 then 'value' end)
            as error_detail, event_id, event_type
        from events where event_id % 50 = 0 or user_id % 7 = 0 union all
        select null, null, null, null, event_id, event_type from events where event_id % 50 <> 0 and user_id % 7 <> 0""",
    "src_json_array": r"""with docs as (
          select strftime(ts, '%Y-%m-%d') as match_date, cast(json_extract_string(props, '$.k') as int) as k,
            event_id % 2 = 0 as even, event_type || '} "\ ]' as ground from events)
        select match_date, 'Alpha' as team1_name, ground, count(*) as n_matches, cast(sum(k % 5) as bigint) as ft1,
          cast(sum(k % 3) as bigint) as ft2 from docs group by match_date, ground
        union all select match_date, 'Gamma', ground, count(*), cast(sum(case when even then k % 5 end) as bigint),
          cast(sum(case when even then k % 3 end) as bigint) from docs group by match_date, ground""",
    "src_json_nested": with_inputs(
        """select cast(match_num as bigint) as match_num, strftime(ts, '%Y-%m-%d') as match_date,
             team1 as team1_name, team2 as team2_name, scoring_team, count(*) as n_matches,
             cast(sum(case when scored then k % 5 end) as bigint) as ft1,
             cast(sum(case when scored then k % 3 end) as bigint) as ft2,
             cast(sum(case when scored then k % 2 end) as bigint) as ht1, cast(0 as bigint) as n_ht2,
             cast(sum(n) as bigint) as n_goals,
             cast(sum(case when event_type = 'error' then n else 0 end) as bigint) as n_own_goals
           from sides group by match_num, match_date, team1, team2, scoring_team""",
        _DOCS,
    ),
    "infer_json": """with v as (select count(*) as n from events)
        select 'event_id' as column_name, 'int' as inferred_type from v union all
        select 'value', case when bool_and(value = floor(value)) then 'int' else 'float' end from events union all
        select 'event_type', 'str' from v union all select 'is_late', 'bool' from v union all
        select 'k', case when bool_and(json_type(props, '$.k') in ('UBIGINT', 'BIGINT')) then 'int' else 'str' end
        from events union all
        select 'nothing', 'str' from v union all select 'mixed', 'int' from v union all select 'texts', 'str' from v""",
    "incremental_load": f"""
        select event_type as item, count(*) as n, max(ts) as at from events group by event_type union all
        select 'run-2', count(*) filter (where ts > timestamp '{CUTOFF}'), max(ts) from events""",
    "incremental_late": """select event_id,
        case when event_id % 50 = 0 then 'run-1:null_ts:ts' else 'loaded' end as outcome from events""",
    "incremental_stream": f"""
        select event_id, ts, user_id, event_type, value, props, cast(ts > timestamp '{CUTOFF}' as int) as batch
        from events where value <= 400""",
    "retention": "select * from events where ts >= timestamp '2024-04-20 00:00:00' - interval 90 day",
}
