"""Registered queries on whole tables: profiles, tests, catalogs, control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.operators.governance import dictionary_entries, replace_models, schema_difference, tag_pii_columns
from goldseam.operators.infer import infer_types, policy_types, retype
from goldseam.operators.joins import orphan_keys
from goldseam.operators.profile import (
    categorical_catalog,
    numeric_kinds,
    profile_columns,
    suggest_tests,
)
from goldseam.operators.quality import (
    at_least,
    check_slos,
    duplicates,
    not_null,
    null_counts,
    reconcile,
    run_expectations,
    summarize_tests,
    unexpected_values,
    unique,
    violations,
)
from goldseam.operators.state import absent_seeds, summarize_runs, upsert
from goldseam.plans import adapt
from goldseam.plans.build import stage_with_tests
from goldseam.plans.silver import LOADED_AT, capital_columns, stage_generic, stage_rules
from goldseam.session import scratch_path
from goldseam.sources.database import infer_declared, read_sqlite, write_sqlite_shards
from goldseam.sources.lake import Lake, normalise_columns, with_audit
from goldseam.spec import Slo


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def load_time():
    return F.lit("2026-06-11 00:00:00").cast("timestamp_ntz")


def table_profile(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = adapt.table(spark, sf_dir, name)
    return profile_columns(df, numeric_kinds(df.schema))


def profiles(spark, sf_dir):
    facts = table_profile(spark, sf_dir, "lineitem").unionByName(table_profile(spark, sf_dir, "orders"))
    return facts.withColumn("distinct_values", F.array_join("distinct_values", "|"))


def suggested(spark, sf_dir):
    tests = suggest_tests(table_profile(spark, sf_dir, "lineitem").unionByName(table_profile(spark, sf_dir, "orders")))
    return tests.withColumns(
        {"tests": F.array_join("tests", ","), "categorical_values": F.array_join("categorical_values", "|")}
    )


def infer_schema(spark, sf_dir):
    inferred = infer_types(as_text(adapt.table(spark, sf_dir, "lineitem")))
    return inferred.unionByName(infer_types(as_text(adapt.table(spark, sf_dir, "orders"))))


DECLARATIONS = {
    "o_orderkey": "BIGINT",
    "o_custkey": "integer",
    "o_orderstatus": "CHAR(1)",
    "o_totalprice": "DECIMAL(15,2)",
    "o_orderdate": "TIMESTAMP",
    "o_orderpriority": "VARCHAR(20)",
}


def infer_declared_types(spark, sf_dir):
    return infer_declared(as_text(adapt.table(spark, sf_dir, "orders")), DECLARATIONS)


def type_policy(spark, sf_dir):
    """Lines as text under the names a source would use, re-typed by name and content."""
    lines = adapt.table(spark, sf_dir, "lineitem")
    text = as_text(
        lines.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_num"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("extended_price"),
            F.col("l_discount").alias("discount"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_returned"),
            F.col("l_linestatus").alias("line_status"),
            F.col("l_suppkey").alias("supplier"),
            F.col("l_partkey").alias("part"),
            F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("return_mark"),
        )
    )
    return retype(text, policy_types(text))


def pii_columns(spark, sf_dir):
    people = adapt.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.concat(F.lit("+1 "), F.col("c_custkey").cast("string")).alias("phone"),
        F.when(F.col("c_custkey") % 3 != 0, F.lit("unknown")).alias("home_address"),
        F.col("c_mktsegment").alias("tournament"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
    )
    return tag_pii_columns(people)


def catalog(spark, sf_dir):
    names = ("orders", "lineitem", "customer", "events")
    frames = [categorical_catalog(adapt.table(spark, sf_dir, n), n) for n in names]
    # A column with nulls, which the ratio leaves out and the list does not.
    sparse = adapt.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    )
    frames.append(categorical_catalog(sparse, "sparse_orders"))
    joined = frames[0]
    for frame in frames[1:]:
        joined = joined.unionByName(frame)
    return joined.withColumn("distinct_values", F.array_join("distinct_values", "|", "NULL"))


def dq_not_null(spark, sf_dir):
    lines = adapt.table(spark, sf_dir, "lineitem")
    return null_counts(lines.withColumn("l_tax", F.when(F.col("l_tax") > 0, F.col("l_tax"))))


def dq_between(spark, sf_dir):
    accounts = adapt.table(spark, sf_dir, "customer").withColumn("c_acctbal", F.col("c_acctbal") - 500)
    return violations(accounts, at_least("c_acctbal", 0)).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


LINE_TESTS = (
    not_null("l_orderkey"), not_null("l_partkey"), not_null("l_shipdate"), unique("l_orderkey", "l_linenumber"),
    at_least("l_quantity", 0), at_least("l_discount", 0.01),
)
ORDER_TESTS = (not_null("o_orderkey"), unique("o_orderkey"), at_least("o_totalprice", 0))


def dq_summary(spark, sf_dir):
    lines = run_expectations(adapt.table(spark, sf_dir, "lineitem"), "stg_lineitem", list(LINE_TESTS))
    orders = run_expectations(adapt.table(spark, sf_dir, "orders"), "stg_orders", list(ORDER_TESTS))
    models = adapt.table(spark, sf_dir, "orders").select(
        F.element_at(F.array(F.lit("stg_lineitem"), F.lit("stg_orders"), F.lit("stg_part")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("model")
    )
    summary = summarize_tests(lines.unionByName(orders), models)
    return summary.withColumn("failures", F.array_join("failures", ","))


def dq_reconcile(spark, sf_dir):
    bronze = adapt.table(spark, sf_dir, "lineitem")
    return reconcile({"bronze": bronze, "silver": stage_generic(bronze)})


def dq_relationships(spark, sf_dir):
    """Customers' nations against a parent that lacks one region."""
    nations = adapt.table(spark, sf_dir, "nation").filter(F.col("n_regionkey") != 0)
    return orphan_keys(adapt.table(spark, sf_dir, "customer"), "c_nationkey", nations, "n_nationkey")


def slo_check(spark, sf_dir):
    """Orders as loads of one source per priority; a row without a large price is rejected."""
    orders = adapt.table(spark, sf_dir, "orders")
    limit = F.when(F.col("o_orderpriority") == "5-LOW", 100000).otherwise(15000)
    dead = F.col("o_totalprice") < limit
    loads = orders.groupBy(F.lower("o_orderpriority").alias("source_name")).agg(
        F.count_if(~dead).alias("rows_loaded"), F.count_if(dead).alias("rows_dead")
    )
    return check_slos(loads, {"1-urgent": Slo(min_rows=1_000_000_000), "2-high": Slo(min_rows=1, max_dead_pct=1.0)})


def run_summary(spark, sf_dir):
    """The order table as a run log: one run per order, one source per priority."""
    status = (
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    )
    log = adapt.table(spark, sf_dir, "orders").select(
        F.lower("o_orderpriority").alias("source_name"),
        F.col("o_orderkey").alias("run_no"),
        status.alias("status"),
        F.floor("o_totalprice").alias("rows_ingested"),
        (F.col("o_custkey") % 7).alias("dead_letter_count"),
    )
    return summarize_runs(log)


def name_normalise(spark, sf_dir):
    parts = adapt.table(spark, sf_dir, "part")
    return normalise_columns(parts.toDF("part key", "part-name", "part.brand", "Part Type", "size", "retail price"))


def run_stage_generic(spark, sf_dir):
    bronze = with_audit(normalise_columns(adapt.table(spark, sf_dir, "lineitem")), "lineitem", "run-1", load_time())
    return stage_generic(bronze).drop(LOADED_AT)


def run_stage_with_tests(spark, sf_dir):
    """Orders with gaps, few in one column and many in another, staged and tested by what their values suggest."""
    orders = adapt.table(spark, sf_dir, "orders").withColumns(
        {
            "o_orderpriority": F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderpriority")),
            "o_custkey": F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")),
        }
    )
    bronze = with_audit(normalise_columns(orders), "orders", "run-1", load_time())
    return stage_with_tests(bronze, "stg_orders", "RAW_ORDERS", ["o_totalprice"]).outcomes


def run_stage_rules(spark, sf_dir):
    """Orders under raw names: days and moments as text, a 0/1 flag, text in capitals."""
    orders = adapt.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderKey"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order Date"),
        F.when(F.col("o_custkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise("soon")
        .alias("shippedAt"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("IS_FINAL"),
        F.upper("o_orderpriority").alias("priority"),
        F.concat(F.lit("Note "), F.col("o_orderstatus")).alias("note"),
    )
    bronze = with_audit(orders, "orders", "run-1", load_time())
    return stage_rules(bronze, capital_columns(bronze)).drop(LOADED_AT)


def seed_if_absent(spark, sf_dir):
    """Suppliers' nations seeded into a table that has the nations of some regions."""
    nation = adapt.table(spark, sf_dir, "nation")
    table = nation.filter(F.col("n_regionkey") < 3)
    seeds = adapt.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.lit("seeded").alias("n_name"), F.lit(-1).alias("n_regionkey")
    )
    return table.unionByName(absent_seeds(seeds, table, "n_nationkey"))


def watermark_upsert(spark, sf_dir):
    """Two rounds of updates on a watermark table with one source per customer."""
    customers = adapt.table(spark, sf_dir, "customer")

    def marks(rows: DataFrame, batch: str, day: str) -> DataFrame:
        at = F.lit(day).cast("timestamp_ntz")
        return rows.select(
            F.lower("c_name").alias("source_name"),
            at.alias("last_loaded_at"),
            F.lit(batch).alias("last_batch_id"),
            F.col("c_custkey").alias("rows_loaded"),
            at.alias("updated_at"),
        )

    first = marks(customers.filter("c_custkey % 2 = 0"), "b1", "2026-06-10 00:00:00")
    both = marks(customers.filter("c_custkey % 3 = 0"), "b2", "2026-06-11 00:00:00").unionByName(
        marks(customers.filter("c_custkey % 9 = 0"), "b3", "2026-06-12 00:00:00")
    )
    return upsert(first, both, "source_name", F.col("updated_at"))


def schema_drift(spark, sf_dir):
    """A second batch brings a new column; old rows have no value in it."""
    path = scratch_path(spark, "lake")
    lake = Lake(spark, path, prefix=path.rsplit("-", 1)[1][:8] + "_")
    customers = adapt.table(spark, sf_dir, "customer")
    first = customers.filter("c_custkey % 2 = 0").drop("c_mktsegment")
    lake.ensure("RAW_CUSTOMER", first.schema, audit=False)
    lake.append(first, "RAW_CUSTOMER")
    second = customers.filter("c_custkey % 2 = 1").withColumnRenamed("c_mktsegment", "market-segment")
    lake.apply_drift("RAW_CUSTOMER", second.schema)
    lake.append(second, "RAW_CUSTOMER")
    return lake.read("RAW_CUSTOMER")


def schema_diff(spark, sf_dir):
    """Schema of a table against a later batch, with the rows each side has for a column."""
    old = adapt.table(spark, sf_dir, "customer")
    new = old.drop("c_acctbal").withColumns({"c_nationkey": F.col("c_nationkey").cast("string"), "c_email": F.col("c_name")})
    changes = schema_difference(old, old.schema, new.schema)
    present = null_counts(old).withColumn("column_name", F.upper("column_name"))
    return changes.join(present, "column_name", "left").withColumnRenamed("n_null", "old_nulls")


def src_db_table(spark, sf_dir):
    """Customers handed over as database files, then read back in row ranges."""
    folder = scratch_path(spark, "sqlite")
    declared = {
        "c_custkey": "INTEGER", "c_name": "VARCHAR(40)", "c_nationkey": "INT", "c_acctbal": "REAL", "c_mktsegment": "TEXT",
    }
    write_sqlite_shards(adapt.table(spark, sf_dir, "customer"), folder, "customer", declared).agg(F.sum("n_rows")).collect()
    return read_sqlite(spark, folder, "customer")


def data_dictionary(spark, sf_dir):
    """Entries of two models, one of them replaced after its tests were suggested anew."""

    def entries(name: str) -> DataFrame:
        return dictionary_entries(suggest_tests(table_profile(spark, sf_dir, name)), f"stg_{name}", f"RAW_{name.upper()}")

    stale = entries("customer").withColumn("description", F.lit("old"))
    merged = replace_models(stale.unionByName(entries("supplier")), entries("customer"), ["stg_customer"])
    return merged.withColumn("tests", F.array_join("tests", ","))


QUERIES = {
    "profile_columns": profiles,
    "suggest_tests": suggested,
    "infer_schema": infer_schema,
    "infer_declared": infer_declared_types,
    "type_policy": type_policy,
    "pii_columns": pii_columns,
    "categorical_catalog": catalog,
    "dq_not_null": dq_not_null,
    "dq_unique": lambda s, d: duplicates(adapt.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "dq_between": dq_between,
    "dq_summary": dq_summary,
    "dq_reconcile": dq_reconcile,
    "dq_relationships": dq_relationships,
    "dq_accepted_values": lambda s, d: unexpected_values(
        adapt.table(s, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]
    ),
    "slo_check": slo_check,
    "run_summary": run_summary,
    "name_normalise": name_normalise,
    "stage_generic": run_stage_generic,
    "stage_with_tests": run_stage_with_tests,
    "stage_rules": run_stage_rules,
    "seed_if_absent": seed_if_absent,
    "watermark_upsert": watermark_upsert,
    "schema_drift": schema_drift,
    "schema_diff": schema_diff,
    "src_db_table": src_db_table,
    "data_dictionary": data_dictionary,
}

_LINE_COLUMNS = {
    "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "float",
    "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "str", "l_linestatus": "str",
    "l_shipdate": "str",
}
_ORDER_COLUMNS = {
    "o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "float", "o_orderdate": "str",
    "o_orderpriority": "str",
}
_CUSTOMER_COLUMNS = {"c_custkey": "int", "c_name": "str", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "str"}
_SUPPLIER_COLUMNS = {"s_suppkey": "int", "s_name": "str", "s_nationkey": "int", "s_acctbal": "float"}


def _facts_sql(table: str, columns: dict[str, str]) -> str:
    """Facts per column in plain SQL: one aggregate query per column."""

    def one(c: str, kind: str) -> str:
        value = f"nullif(trim(cast({c} as varchar)), '')"
        negative = f"bool_or({c} < 0)" if kind in ("int", "float") else "cast(null as boolean)"
        return f"""select '{c}' as column_name, '{kind}' as inferred_type, count(*) as total,
            count({value}) as sample_count, count(distinct {value}) as distinct_count, {negative} as ever_negative,
            string_agg(distinct {value}, '|' order by {value}) as listed from {table}"""

    return " union all ".join(one(c, kind) for c, kind in columns.items())


def _profile_sql(*parts: str) -> str:
    return f"""facts as ({' union all '.join(parts)}),
profile as (
  select column_name, inferred_type, (total - sample_count)::double / total as null_rate, distinct_count, sample_count,
    coalesce(distinct_count::double / nullif(sample_count, 0), 0) as cardinality_ratio,
    sample_count >= 10 and distinct_count = sample_count as is_unique, ever_negative,
    case when distinct_count <= 20 then coalesce(listed, '') else '' end as distinct_values
  from facts),
suggested as (
  select column_name,
    concat_ws(',', case when null_rate <= 0.05 then 'not_null' end, case when is_unique then 'unique' end) as tests,
    inferred_type in ('int', 'float') and coalesce(not ever_negative, false) and sample_count > 0 as nonnegative,
    inferred_type = 'str' and not is_unique and sample_count >= 20 and cardinality_ratio <= 0.05
      and distinct_count >= 2 as candidate_categorical,
    case when inferred_type = 'str' and not is_unique and sample_count >= 20 and cardinality_ratio <= 0.05
      and distinct_count >= 2 then distinct_values end as categorical_values
  from profile)"""


_FACTS = _profile_sql(_facts_sql("lineitem", _LINE_COLUMNS), _facts_sql("orders", _ORDER_COLUMNS))


def _catalog_sql(table: str, column: str, source: str | None = None) -> str:
    return f"""select '{table}' as table_name, '{column}' as column_name, count(distinct {column}) as distinct_count,
        count(*) as total, array_to_string(list_transform(list_sort(list(distinct {column}), 'ASC', 'NULLS LAST'),
          lambda x: x) || case when count(*) > count({column}) then ['NULL'] else [] end, '|') as distinct_values
        from {source or table} having count(*) > 0 and count(distinct {column})::double / count(*) <= 0.10
        and count(distinct {column}) <= 60"""


def _kind_sql(table: str, column: str, numeric: bool) -> str:
    if not numeric:
        return f"select '{column}' as column_name, 'str' as inferred_type from (select count(*) from {table})"
    return f"""select '{column}' as column_name, case when bool_and(cast({column} as double) in (0, 1)
        and contains(cast({column} as varchar), '.') = false) then 'bool'
        when bool_and({column} = floor({column})) then 'int' else 'float' end as inferred_type from {table}"""


def _dictionary_sql(name: str) -> str:
    return f"""select 'stg_{name}' as model, column_name,
        'Raw ' || replace(column_name, '_', ' ') || ' from Bronze RAW_{name.upper()}' as description,
        concat_ws(',', nullif(tests, ''), case when nonnegative then 'at_least_0' end) as tests,
        column_name in ('c_name', 's_name') as pii, candidate_categorical
        from suggested where column_name like '{name[0]}\\_%' escape '\\'"""


def _suggested_tests_sql(columns: dict[str, str], optional: tuple[str, ...]) -> str:
    """The suggested tests of the CTE ``src`` and their failures: a test is a row where its condition holds."""
    tests = []
    for c, kind in columns.items():
        if c not in optional:
            tests.append(f"select 'not_null_{c}' as test_name, count(*) - count({c}) as failures from src "
                         f"having (count(*) - count({c}))::double / count(*) <= 0.05")
        tests.append(f"select 'unique_{c}', 0 from src having count({c}) >= 10 and count(distinct {c}) = count({c})")
        if kind != "str":
            tests.append(f"select 'at_least_{c}', 0 from src having count({c}) > 0 and min({c}) >= 0")
    return f"""select 'stg_orders' as model, test_name, case when failures = 0 then 'pass' else 'fail' end as status,
        cast(failures as bigint) as failures from ({' union all '.join(tests)})"""


ORACLE = {
    "profile_columns": f"with {_FACTS} select * from profile",
    "suggest_tests": f"with {_FACTS} select * from suggested",
    "infer_schema": " union all ".join(
        [_kind_sql("lineitem", c, k != "str") for c, k in _LINE_COLUMNS.items()]
        + [_kind_sql("orders", c, k != "str") for c, k in _ORDER_COLUMNS.items()]
    ),
    "infer_declared": """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate,
        o_orderpriority from orders""",
    "type_policy": """select cast(l_orderkey as varchar) as order_id, cast(l_linenumber as varchar) as line_num,
        cast(l_quantity as bigint) as quantity, l_extendedprice as extended_price, l_discount as discount,
        strftime(l_shipdate, '%Y-%m-%d') as ship_date, l_returnflag = 'R' as is_returned,
        l_linestatus as line_status, l_suppkey as supplier, l_partkey as part, l_tax as tax, l_returnflag as return_mark
        from lineitem""",
    "pii_columns": """
        select 'customer_id' as column_name, false as pii, count(*) as non_null, count(distinct c_custkey) as distinct_values
        from customer union all
        select 'customer_name', true, count(c_name), count(distinct c_name) from customer union all
        select 'phone', true, count(*), count(distinct c_custkey) from customer union all
        select 'home_address', true, count(*) filter (where c_custkey % 3 <> 0), 1 from customer union all
        select 'tournament', false, count(c_mktsegment), count(distinct c_mktsegment) from customer union all
        select 'nation', false, count(c_nationkey), count(distinct c_nationkey) from customer union all
        select 'balance', false, count(c_acctbal), count(distinct c_acctbal) from customer""",
    "categorical_catalog": " union all ".join(
        [
            _catalog_sql(t, c)
            for t, c in (
                ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"),
                ("lineitem", "l_linestatus"), ("customer", "c_name"), ("customer", "c_mktsegment"),
                ("events", "event_type"), ("events", "props"),
            )
        ]
        + [_catalog_sql("sparse_orders", "status", "(select case when o_orderstatus <> 'P' then o_orderstatus end as status from orders)")]
    ),
    "dq_not_null": " union all ".join(
        f"select '{c}' as column_name, count(*) filter (where {'not (l_tax > 0)' if c == 'l_tax' else f'{c} is null'})"
        " as n_null from lineitem"
        for c in _LINE_COLUMNS
    ),
    "dq_unique": """select l_orderkey, l_linenumber, count(*) as n_rows from lineitem
                    group by l_orderkey, l_linenumber having count(*) > 1""",
    "dq_between": """select c_custkey, round(c_acctbal - 500, 2) as c_acctbal from customer
                     where c_acctbal - 500 < 0""",
    "dq_summary": """with t as (
        select 'stg_lineitem' as model, 'at_least_l_discount' as test, count(*) filter (where l_discount < 0.01) as n
        from lineitem union all
        select 'stg_lineitem', 'at_least_l_quantity', count(*) filter (where l_quantity < 0) from lineitem union all
        select 'stg_lineitem', 'not_null_l_orderkey', count(*) filter (where l_orderkey is null) from lineitem union all
        select 'stg_lineitem', 'not_null_l_partkey', count(*) filter (where l_partkey is null) from lineitem union all
        select 'stg_lineitem', 'not_null_l_shipdate', count(*) filter (where l_shipdate is null) from lineitem union all
        select 'stg_lineitem', 'unique_l_orderkey_l_linenumber', count(*) from (
          select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) union all
        select 'stg_orders', 'not_null_o_orderkey', count(*) filter (where o_orderkey is null) from orders union all
        select 'stg_orders', 'unique_o_orderkey', count(*) from (
          select 1 from orders group by o_orderkey having count(*) > 1) union all
        select 'stg_orders', 'at_least_o_totalprice', count(*) filter (where o_totalprice < 0) from orders)
        select model, count(*) as total, count(*) filter (where n = 0) as passed, count(*) filter (where n > 0) as failed,
          coalesce(string_agg(case when n > 0 then test end, ',' order by test), '') as failures,
          count(*) filter (where n > 0) = 0 as all_passed,
          case when count(*) filter (where n > 0) = 0 then 'passed' else 'failed' end as gate
        from t group by model union all
        select 'stg_part', 0, 0, 0, '', false, 'passed_with_warning'""",
    "dq_reconcile": "select count(*) as bronze_rows, count(*) as silver_rows, true as rows_match from lineitem",
    "dq_relationships": """select c_nationkey, count(*) as n_rows from customer where c_nationkey not in (
                           select n_nationkey from nation where n_regionkey <> 0) group by c_nationkey""",
    "dq_accepted_values": """select c_mktsegment, count(*) as n_rows from customer
                             where c_mktsegment not in ('BUILDING', 'MACHINERY') group by c_mktsegment""",
    "slo_check": """with loads as (
        select lower(o_orderpriority) as source_name, count(*) filter (where not dead) as rows_loaded,
          count(*) filter (where dead) as rows_dead
        from (select *, o_totalprice < case when o_orderpriority = '5-LOW' then 100000 else 15000 end as dead from orders)
        group by 1),
        rated as (select *, 100.0::double * rows_dead / (rows_loaded + rows_dead) as rate from loads),
        judged as (select *, case when source_name = '1-urgent' and rows_loaded < 1000000000 then 'min_rows'
          when rate > case when source_name = '2-high' then 1.0 else 5.0 end then 'dead_letter_rate' end as breach
          from rated)
        select source_name, rows_loaded, rows_dead, round(rate, 1) as dead_pct, breach, breach is null as slo_passed
        from judged""",
    "run_summary": """select lower(o_orderpriority) as source_name, count(*) as n_runs,
        count(*) filter (where o_orderstatus = 'F') as n_done,
        arg_max(case o_orderstatus when 'F' then 'done' when 'O' then 'failed' else 'running' end, o_orderkey)
          as last_status,
        cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as rows_ingested,
        cast(sum(o_custkey % 7) as bigint) as dead_letter_count from orders group by 1""",
    "name_normalise": """select p_partkey as PART_KEY, p_name as PART_NAME, p_brand as PART_BRAND, p_type as PART_TYPE,
        p_size as SIZE, p_retailprice as RETAIL_PRICE from part""",
    "stage_generic": "select * from lineitem",
    "stage_with_tests": """with src as (select * replace (
          case when o_orderkey % 50 <> 0 then o_orderpriority end as o_orderpriority,
          case when o_orderkey % 10 <> 0 then o_custkey end as o_custkey) from orders) """
    + _suggested_tests_sql(_ORDER_COLUMNS, ("o_totalprice",)),
    "stage_rules": """select o_orderkey as order_key, cast(o_orderdate as date) as order_date,
        case when o_custkey % 2 = 0 then date_trunc('second', o_orderdate) end as shipped_at,
        o_orderstatus = 'F' as is_final, lower(o_orderpriority) as priority, 'Note ' || o_orderstatus as note
        from orders""",
    "seed_if_absent": """select * from nation where n_regionkey < 3 union all
        select distinct s_nationkey, 'seeded', -1 from supplier
        where s_nationkey not in (select n_nationkey from nation where n_regionkey < 3)""",
    "watermark_upsert": """
        select lower(c_name) as source_name,
          case when c_custkey % 9 = 0 then timestamp '2026-06-12' when c_custkey % 3 = 0 then timestamp '2026-06-11'
               else timestamp '2026-06-10' end as last_loaded_at,
          case when c_custkey % 9 = 0 then 'b3' when c_custkey % 3 = 0 then 'b2' else 'b1' end as last_batch_id,
          c_custkey as rows_loaded,
          case when c_custkey % 9 = 0 then timestamp '2026-06-12' when c_custkey % 3 = 0 then timestamp '2026-06-11'
               else timestamp '2026-06-10' end as updated_at
        from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0""",
    "schema_drift": """select c_custkey as C_CUSTKEY, c_name as C_NAME, c_nationkey as C_NATIONKEY, c_acctbal as C_ACCTBAL,
        case when c_custkey % 2 = 1 then c_mktsegment end as MARKET_SEGMENT from customer""",
    "schema_diff": """
        select 'C_ACCTBAL' as column_name, 'removed' as change, 'double' as old_type, cast(null as varchar) as new_type,
          count(*) filter (where c_acctbal is null) as old_nulls from customer union all
        select 'C_NATIONKEY', 'retyped', 'int', 'string', count(*) filter (where c_nationkey is null) from customer
        union all select 'C_EMAIL', 'added', null, 'string', null""",
    "src_db_table": """select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment
                       from customer""",
    "data_dictionary": "with "
    + _profile_sql(_facts_sql("customer", _CUSTOMER_COLUMNS), _facts_sql("supplier", _SUPPLIER_COLUMNS))
    + f" {_dictionary_sql('customer')} union all {_dictionary_sql('supplier')}",
}
