"""The adapted inputs as SQL text, for the comparison side of the registered queries."""

AS_OF = "date '2026-06-11'"

MATCHES = """matches as (
  select cast(o.o_orderdate as date) as match_date,
         lower(hn.n_name) as home_team, lower(an.n_name) as away_team,
         cast(l.l_quantity as int) % 6 as home_score,
         cast(l.l_partkey % 5 as int) as away_score,
         lower(o.o_orderpriority) as tournament, l.l_returnflag = 'N' as neutral
  from lineitem l
  join orders o    on l.l_orderkey = o.o_orderkey
  join customer cu on o.o_custkey = cu.c_custkey
  join nation hn   on cu.c_nationkey = hn.n_nationkey
  join supplier su on l.l_suppkey = su.s_suppkey
  join nation an   on su.s_nationkey = an.n_nationkey
  where hn.n_nationkey <> an.n_nationkey)"""

GOALS = """goals as (
  select concat('team_', cast(user_id % 20 as varchar)) as team,
         concat('user_', cast(user_id as varchar)) as scorer,
         case when value > 400 then null
              else cast(cast(floor(value) as bigint) % 100 as int) end as minute,
         event_type = 'error' as own_goal, event_type = 'purchase' as penalty
  from events)"""

TEAMS = """teams as (
  select lower(n_name) as team_name, cast(n_nationkey as varchar) as fifa_code,
         cast(n_regionkey as varchar) as group_name
  from nation where n_regionkey <> 0)"""

PLAYERS = """players as (
  select o.o_orderkey as player_id, lower(n.n_name) as team_name,
         case substr(o.o_orderpriority, 1, 1) when '1' then 'gk' when '2' then 'df'
              when '3' then 'mf' when '4' then 'fw' else 'xx' end as position,
         case when o.o_orderkey % 11 = 0 then null
              else cast(o.o_orderkey % 25 as varchar) end as club_country,
         cast(o.o_orderdate as date) as date_of_birth
  from orders o
  join customer cu on o.o_custkey = cu.c_custkey
  join nation n    on cu.c_nationkey = n.n_nationkey)"""

PERSPECTIVES = """seen as (
  select tournament, match_date, home_team as team, home_score as goals_for, away_score as goals_against,
         'home' as venue from matches
  union all
  select tournament, match_date, away_team, away_score, home_score, 'away' from matches),
perspectives as (
  select *, case when goals_for > goals_against then 'win' when goals_for < goals_against then 'loss'
                 else 'draw' end as result from seen)"""

PERFORMANCE = """performance as (
  select team, tournament, count(*) as matches_played,
    count(*) filter (where result = 'win') as wins,
    count(*) filter (where result = 'draw') as draws,
    count(*) filter (where result = 'loss') as losses,
    round(100.0::double * count(*) filter (where result = 'win') / count(*), 1) as win_pct,
    cast(sum(case result when 'win' then 3 when 'draw' then 1 else 0 end) as bigint) as points,
    cast(sum(goals_for) as bigint) as goals_for,
    cast(sum(goals_against) as bigint) as goals_against,
    cast(sum(goals_for) - sum(goals_against) as bigint) as goal_difference,
    round(sum(goals_for)::double / count(*), 2) as avg_goals_scored_per_match,
    round(sum(goals_against)::double / count(*), 2) as avg_goals_conceded_per_match,
    count(*) filter (where goals_against = 0) as clean_sheets,
    count(*) filter (where goals_for = 0) as failed_to_score,
    max(goals_for - goals_against) as biggest_win_margin,
    count(*) filter (where venue = 'home') as home_matches,
    count(*) filter (where venue = 'away') as away_matches,
    count(*) filter (where venue = 'home' and result = 'win') as home_wins,
    count(*) filter (where venue = 'away' and result = 'win') as away_wins
  from perspectives group by team, tournament)"""

PER_TEAM = """per_team as (
  select team, cast(sum(points) as bigint) as points, cast(sum(clean_sheets) as bigint) as clean_sheets,
    cast(sum(goal_difference) as bigint) as goal_difference,
    round(100.0::double * sum(wins)::double / sum(matches_played)::double, 1) as win_pct
  from performance group by team)"""

BUCKETS = """bucketed as (
  select *, case when minute between 0 and 15 then '0-15' when minute between 16 and 30 then '16-30'
    when minute between 31 and 45 then '31-45' when minute between 46 and 60 then '46-60'
    when minute between 61 and 75 then '61-75' when minute between 76 and 90 then '76-90'
    when minute > 90 then '90+' else 'unknown' end as minute_bucket
  from goals)"""

ANALYTICS = """analytics as (
  select team, count(*) as total_goals,
    count(*) filter (where penalty) as penalty_goals,
    round(100.0::double * count(*) filter (where penalty) / count(*), 1) as penalty_goal_pct,
    count(*) filter (where own_goal) as own_goals_against,
    count(*) filter (where minute_bucket in ('0-15', '16-30', '31-45')) as first_half_goals,
    count(*) filter (where minute_bucket in ('46-60', '61-75', '76-90', '90+')) as second_half_goals,
    count(*) filter (where minute_bucket = '90+') as stoppage_time_goals,
    count(distinct scorer) as unique_scorers
  from bucketed group by team)"""

SQUADS = f"""aged as (
  select p.team_name, p.position, year({AS_OF}) - year(p.date_of_birth) as age,
         case when p.club_country <> t.fifa_code then 1 else 0 end as abroad
  from players p left join teams t on p.team_name = t.team_name),
squads as (
  select team_name, count(*) as squad_size, round(avg(age), 1) as avg_age,
    cast(min(age) as int) as youngest_player_age, cast(max(age) as int) as oldest_player_age,
    count(*) filter (where position = 'gk') as goalkeepers,
    count(*) filter (where position = 'df') as defenders,
    count(*) filter (where position = 'mf') as midfielders,
    count(*) filter (where position = 'fw') as forwards,
    cast(sum(abroad) as bigint) as players_at_foreign_clubs,
    round(100.0::double * sum(abroad)::double / count(*), 1) as legionnaire_pct
  from aged group by team_name)"""


def with_inputs(query: str, *inputs: str) -> str:
    return "with " + ",\n".join(inputs) + "\n" + query


MATCH_CHAIN = (MATCHES, PERSPECTIVES, PERFORMANCE, PER_TEAM)
GOAL_CHAIN = (GOALS, BUCKETS, ANALYTICS)
SQUAD_CHAIN = (TEAMS, PLAYERS, SQUADS)
