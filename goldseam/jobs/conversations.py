"""Registered queries on conversations and documents: flattening, question logs, personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.functions.text import strip_code_fences, strip_semicolons
from goldseam.jobs.inputs import with_inputs
from goldseam.operators.flatten import (
    flatten_children,
    flatten_parents,
    flatten_players,
    flatten_teams,
    flatten_variant_parents,
    with_player_ids,
)
from goldseam.operators.governance import PII_SHAPES, count_pii_values
from goldseam.operators.joins import preceding_context
from goldseam.plans import adapt, ask
from goldseam.plans.silver import LOADED_AT, stage

KEEP = ["conv_id", "turn"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a document: its lines are the matches, their words the goals.

    Every third line has no score, a line of odd length only one of two scores.
    A document is made from one row, so none grows with the conversation.
    """

    def match(line: Column, nth: Column) -> Column:
        words = F.split(line, " ")
        half = F.floor(F.size(words) / 2).cast("int")
        ft = F.when(F.length(line) % 2 == 0, F.array(F.size(words) % 7, F.length(line) % 5)).otherwise(
            F.array(F.size(words) % 7)
        )

        def goal(word: Column, at: Column) -> Column:
            return F.struct(
                word.alias("name"),
                (at % 95).cast("string").alias("minute"),
                F.when(F.length(word) == 2, F.lit(True)).alias("owngoal"),
                (F.length(word) > 9).alias("penalty"),
            )

        return F.struct(
            F.when(F.col("turn") % 4 != 3, F.format_string("2026-06-%02d", nth % 40 + 1)).alias("date"),
            F.concat((F.col("turn") + 10).cast("string"), F.lit(":30")).alias("time"),
            F.concat(F.lit("Round "), nth.cast("string")).alias("round"),
            F.when(nth % 2 == 0, F.lit("Group A")).alias("group"),
            F.col("role").alias("ground"),
            F.concat(F.lit("Team "), F.col("conv_id").cast("string")).alias("team1"),
            F.col("role").alias("team2"),
            F.when(nth % 3 != 2, F.struct(ft.alias("ft"), F.array(nth % 2).alias("ht"))).alias("score"),
            F.when(half > 0, F.transform(F.slice(words, F.lit(1), half), goal)).alias("goals1"),
            F.transform(F.slice(words, half + 1, F.size(words)), goal).alias("goals2"),
        )

    return adapt.table(spark, sf_dir, "conversations").select(*KEEP, F.transform(_lines(F.col("text")), match).alias("matches"))


def parents(spark, sf_dir):
    return flatten_parents(documents(spark, sf_dir), KEEP)


def children(spark, sf_dir):
    return flatten_children(documents(spark, sf_dir), KEEP)


def parents_parity(spark, sf_dir):
    """From VARIANT documents: a missing text is empty, a JSON null the word None."""
    docs = documents(spark, sf_dir)
    # Dropping null fields leaves some texts missing; the date is put back as a JSON null.
    body = F.to_json(F.struct(F.transform("matches", lambda m: m.dropFields("date", "goals1", "goals2")).alias("matches")))
    nulls = F.replace(body, F.lit('"time":"13:30"'), F.lit('"time":null'))
    return flatten_variant_parents(docs.select(*KEEP, F.parse_json(nulls).alias("doc")), "doc", KEEP)


def squads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a team, its words as players; every fifth player has no club."""

    def player(word: Column, at: Column) -> Column:
        club = F.struct(F.concat(F.lit("FC "), F.col("role")).alias("name"), F.left(word, F.lit(2)).alias("country"))
        return F.struct(
            word.alias("name"),
            F.element_at(F.array(*[F.lit(p) for p in ("GK", "DF", "MF", "FW")]), (at % 4 + 1).cast("int")).alias("pos"),
            F.when(at % 3 != 0, at + 1).alias("number"),
            F.lit("2000-01-01").alias("date_of_birth"),
            F.when(at % 5 != 0, club).alias("club"),
        )

    return adapt.table(spark, sf_dir, "conversations").select(
        *KEEP,
        F.concat(F.lit("Team "), F.col("conv_id").cast("string")).alias("name"),
        F.when(F.col("turn") > 0, F.col("turn").cast("string")).alias("fifa_code"),
        F.col("role").alias("group"),
        F.transform(F.split("text", " "), player).alias("players"),
    )


def flatten_squads(spark, sf_dir):
    """Players numbered over the whole document order: conversation, turn, position."""
    players = flatten_players(squads(spark, sf_dir), KEEP)
    return with_player_ids(players, [*KEEP, "player_pos"])


def stage_api_matches(spark, sf_dir):
    return stage(parents(spark, sf_dir), "stg_worldcup_api").drop(LOADED_AT)


def stage_api_goals(spark, sf_dir):
    return stage(children(spark, sf_dir), "stg_worldcup_api_secondary").drop(LOADED_AT)


def context_last3(spark, sf_dir):
    turns = adapt.table(spark, sf_dir, "conversations").select(*KEEP, "role", "text")
    line = ask.context_line(F.col("text"), F.col("role"))
    return preceding_context(turns, "conv_id", "turn", line, ask.CONTEXT_TURNS, "context").drop("role", "text")


def intent_route(spark, sf_dir):
    openings = F.array(*[F.lit(o) for o in ("What Tables ", "which team ", "LIST TABLES ", "describe the SCHEMA ")])
    question = F.concat(F.element_at(openings, (F.col("turn") % 4 + 1).cast("int")), F.col("text"))
    return adapt.table(spark, sf_dir, "conversations").select(*KEEP, ask.route(question).alias("route"))


HEADS = (
    "select ", "WITH x as ", "explain ", " Select updated_at from ", "select 1; drop table ",
    "with y as (select 1) delete from ", "",
)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement log: SQL heads before the text of each turn; a few are blank."""
    n = F.col("conv_id") + F.col("turn")
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (n % len(HEADS) + 1).cast("int"))
    sql = F.when(n % 17 == 16, F.lit("  \n")).otherwise(F.concat(head, F.col("text")))
    return adapt.table(spark, sf_dir, "conversations").select(*KEEP, "text", sql.alias("sql"))


def sql_audit(spark, sf_dir):
    log = statements(spark, sf_dir)
    return log.select(*KEEP, ask.audit_sql(F.col("sql")).alias("refused"))


def clean_sql(spark, sf_dir):
    """Statements out of Markdown fences, without closing semicolons."""
    fenced = F.concat(F.lit("```sql\nselect "), F.col("text"), F.lit(";; \n```"))
    turns = adapt.table(spark, sf_dir, "conversations")
    return turns.select(*KEEP, strip_semicolons(strip_code_fences(fenced)).alias("sql"))


def eval_summary(spark, sf_dir):
    log = statements(spark, sf_dir)
    results = log.select(
        "sql",
        F.when(F.col("turn") % 2 == 0, "TION").otherwise("select").alias("expected_table"),
        ask.audit_sql(F.col("sql")).isNull().alias("success"),
        F.round(F.length("text") / F.lit(100.0), 2).alias("latency_sec"),
    )
    return ask.summarize_evaluation(results)


def pii_values(spark, sf_dir):
    return count_pii_values(adapt.table(spark, sf_dir, "documents"), "text", ["doc_id", "lang"])


QUERIES = {
    "flatten_parent": parents,
    "flatten_parent_parity": parents_parity,
    "flatten_child": children,
    "flatten_teams": lambda s, d: flatten_teams(squads(s, d), KEEP),
    "flatten_squads": flatten_squads,
    "stage_api_matches": stage_api_matches,
    "stage_api_goals": stage_api_goals,
    "context_last3": context_last3,
    "intent_route": intent_route,
    "sql_audit": sql_audit,
    "clean_sql": clean_sql,
    "eval_summary": eval_summary,
    "pii_values": pii_values,
}

_LINES = """numbered as (
  select c.conv_id, c.turn, c.role, string_split(c.text, chr(10)) as lines from conversations c),
lines as (
  select conv_id, turn, role, lines[i + 1] as line, i as nth
  from (select *, unnest(range(len(lines))) as i from numbered)),
worded as (
  select *, string_split(line, ' ') as words, len(string_split(line, ' ')) as n_words from lines),
parents as (
  select conv_id, turn, nth as match_num,
    case when turn % 4 <> 3 then '2026-06-' || lpad(cast(nth % 40 + 1 as varchar), 2, '0') else '' end as match_date,
    cast(turn + 10 as varchar) || ':30' as match_time, 'Round ' || cast(nth as varchar) as round_name,
    case when nth % 2 = 0 then 'Group A' else '' end as group_name, role as ground,
    'Team ' || cast(conv_id as varchar) as team1_name, role as team2_name,
    case when nth % 3 <> 2 then cast(n_words % 7 as bigint) end as score_ft_team1,
    case when nth % 3 <> 2 and length(line) % 2 = 0 then cast(length(line) % 5 as bigint) end as score_ft_team2,
    case when nth % 3 <> 2 then cast(nth % 2 as bigint) end as score_ht_team1,
    cast(null as bigint) as score_ht_team2
  from worded),
each as (
  select *, unnest(range(n_words)) as w from worded),
goals as (
  select conv_id, turn, nth as match_num,
    case when turn % 4 <> 3 then '2026-06-' || lpad(cast(nth % 40 + 1 as varchar), 2, '0') else '' end as match_date,
    'Round ' || cast(nth as varchar) as round_name,
    'Team ' || cast(conv_id as varchar) as team1_name, role as team2_name,
    case when w < n_words // 2 then 'Team ' || cast(conv_id as varchar) else role end as scoring_team,
    words[w + 1] as scorer_name,
    cast((case when w < n_words // 2 then w else w - n_words // 2 end) % 95 as varchar) as minute,
    w < n_words // 2 as is_team1_goal, length(words[w + 1]) = 2 as is_own_goal, length(words[w + 1]) > 9 as is_penalty
  from each)"""

_PLAYERS = """split as (
  select *, string_split(text, ' ') as words from conversations),
each as (
  select *, unnest(range(len(words))) as p from split)"""

_LOG = """log as (
  select *, case when (conv_id + turn) % 17 = 16 then '  ' || chr(10) else
    ['select ', 'WITH x as ', 'explain ', ' Select updated_at from ', 'select 1; drop table ',
     'with y as (select 1) delete from ', ''][cast((conv_id + turn) % 7 as int) + 1] || text end as sql
  from conversations),
audited as (
  select *, case
    when regexp_full_match(sql, '\\s*') then 'empty'
    when not regexp_matches(sql, '^\\s*(WITH|SELECT)\\b', 'i') then 'start'
    when regexp_matches(sql, '\\bDROP\\b', 'i') then 'DROP'
    when regexp_matches(sql, '\\bDELETE\\b', 'i') then 'DELETE'
    when regexp_matches(sql, '\\bUPDATE\\b', 'i') then 'UPDATE'
    when regexp_matches(sql, '\\bALTER\\b', 'i') then 'ALTER'
    when regexp_matches(sql, '\\bTRUNCATE\\b', 'i') then 'TRUNCATE'
    when regexp_matches(sql, '\\bINSERT\\b', 'i') then 'INSERT'
    when regexp_matches(sql, '\\bMERGE\\b', 'i') then 'MERGE'
    when regexp_matches(sql, '\\bCREATE\\b', 'i') then 'CREATE'
    when regexp_matches(sql, '\\bGRANT\\b', 'i') then 'GRANT'
    when regexp_matches(sql, '\\bREVOKE\\b', 'i') then 'REVOKE' end as refused
  from log)""".replace("\\\\", "\\")

ORACLE = {
    "flatten_parent": with_inputs("select * from parents", _LINES),
    "flatten_parent_parity": with_inputs(
        """select * replace ('' as match_date, case when match_time = '13:30' then 'None' else match_time end as match_time)
           from parents""",
        _LINES,
    ),
    "flatten_child": with_inputs("select * from goals", _LINES),
    "flatten_teams": """select conv_id, turn, 'Team ' || cast(conv_id as varchar) as team_name,
                        case when turn > 0 then cast(turn as varchar) else '' end as fifa_code, role as group_name
                        from conversations""",
    "flatten_squads": with_inputs(
        """select 'P' || case when id < 100000 then lpad(cast(id as varchar), 5, '0') else cast(id as varchar) end
               as player_id,
             conv_id, turn, team_name, player_pos, player_name, position, jersey_number, club_name, club_country,
             date_of_birth
           from (select *, row_number() over (order by conv_id, turn, p) as id, cast(p as int) as player_pos,
             'Team ' || cast(conv_id as varchar) as team_name, words[p + 1] as player_name,
             ['GK', 'DF', 'MF', 'FW'][p % 4 + 1] as position,
             case when p % 3 <> 0 then p + 1 end as jersey_number,
             case when p % 5 <> 0 then 'FC ' || role else '' end as club_name,
             case when p % 5 <> 0 then left(words[p + 1], 2) else '' end as club_country,
             '2000-01-01' as date_of_birth from each)""",
        _PLAYERS,
    ),
    "stage_api_matches": with_inputs(
        """select match_num, try_cast(match_date as date) as match_date, match_time || ':00' as match_time,
             lower(round_name) as round_name, lower(group_name) as group_name, lower(ground) as ground,
             lower(team1_name) as team1_name, lower(team2_name) as team2_name,
             score_ft_team1, score_ft_team2, score_ht_team1, score_ht_team2 from parents""",
        _LINES,
    ),
    "stage_api_goals": with_inputs(
        """select match_num, try_cast(match_date as date) as match_date, lower(round_name) as round_name,
             lower(team1_name) as team1_name, lower(team2_name) as team2_name, lower(scoring_team) as scoring_team,
             lower(scorer_name) as scorer_name, minute, is_team1_goal, is_own_goal, is_penalty from goals""",
        _LINES,
    ),
    "context_last3": """
        select conv_id, turn, coalesce(string_agg('Q: ' || text || chr(10) || 'A: ' || role, chr(10)) over (
          partition by conv_id order by turn rows between 3 preceding and 1 preceding), '') as context
        from conversations""",
    "intent_route": """
        select conv_id, turn, case when contains(q, 'what tables') or contains(q, 'what data')
          or contains(q, 'what columns') or contains(q, 'list tables') or contains(q, 'what can you')
          or contains(q, 'schema') or contains(q, 'metadata') or contains(q, 'what fields')
          then 'metadata' else 'data' end as route
        from (select *, lower(['What Tables ', 'which team ', 'LIST TABLES ', 'describe the SCHEMA '][turn % 4 + 1]
                              || text) as q from conversations)""",
    "sql_audit": with_inputs("select conv_id, turn, refused from audited", _LOG),
    "clean_sql": """select conv_id, turn, trim(rtrim('select ' || text || ';;', ';'), ' ' || chr(10)) as sql
                    from conversations""",
    "eval_summary": with_inputs(
        """select count(*) as total, count(*) filter (where refused is null) as successes,
             round(100.0::double * count(*) filter (where refused is null) / count(*), 0) as success_pct,
             count(*) filter (where hit) as correct_table,
             round(100.0::double * count(*) filter (where hit) / count(*), 0) as correct_table_pct,
             round(avg(round(length(text) / 100.0::double, 2)), 2) as avg_latency_sec
           from (select *, contains(lower(sql), case when turn % 2 = 0 then 'tion' else 'select' end) as hit
                 from audited)""",
        _LOG,
    ),
    "pii_values": f"""
        select * from (select doc_id, lang,
          cast(len(regexp_extract_all(text, '{PII_SHAPES["email"]}')) as int) as n_email,
          cast(len(regexp_extract_all(text, '{PII_SHAPES["phone"]}')) as int) as n_phone from documents)
        where n_email > 0 or n_phone > 0""",
}
