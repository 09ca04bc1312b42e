"""One source into Bronze: read, infer, coerce, split, check, publish."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.operators.flatten import CHILD_COLUMNS, PARENT_COLUMNS, flatten_children, flatten_parents
from goldseam.operators.infer import apply_type_policy, decided_by_name, inspect_columns, retype
from goldseam.operators.split import REASON, flag_null_key, flag_rows
from goldseam.session import scratch_path
from goldseam.sources.database import declared_types, read_jdbc, read_sqlite
from goldseam.sources.files import read_csv_text, read_match_documents
from goldseam.sources.lake import Lake, now, with_audit
from goldseam.spec import NULLABLE_THRESHOLD, Slo, SourceSpec, slo_for


SURPLUS, SURPLUS_REASON = "_surplus", "more_values_than_columns"


@dataclass(frozen=True)
class LoadResult:
    source_name: str
    run_id: str
    rows_loaded: int
    rows_dead: int
    status: str
    breach: str | None = None
    tables: dict[str, int] = field(default_factory=dict)


def _read_csv(lake: Lake, spec: SourceSpec) -> tuple[DataFrame, set[str]]:
    text = read_csv_text(lake.spark, spec.location, multi_line=spec.options.get("multi_line"), surplus=SURPLUS)
    sample = spec.options.get("sample_rows")
    named = text.drop(SURPLUS)
    # Types and null rates come from one scan; one row per column comes back.
    facts = inspect_columns(named, sample, decided_by_name(named.columns)).collect()
    types = {r["column_name"]: r["inferred_type"] for r in facts}
    sparse = {r["column_name"] for r in facts if r["null_rate"] > NULLABLE_THRESHOLD}
    return retype(text, apply_type_policy({c: types[c] for c in named.columns}), (SURPLUS,)), sparse


def _read_database(lake: Lake, spec: SourceSpec) -> DataFrame:
    if spec.source_type == "sqlite":
        types = apply_type_policy(declared_types(spec.location, spec.db_table))
        return read_sqlite(lake.spark, spec.location, spec.db_table, types, spec.options.get("partitions", 8))
    return read_jdbc(lake.spark, spec.location, spec.db_table, **spec.options)


def _required(df: DataFrame, nullable: set[str] = frozenset()) -> list[str]:
    return [c for c in df.columns if c not in nullable and not c.startswith("_")]


def frames(lake: Lake, spec: SourceSpec) -> dict[str, tuple[DataFrame, list[str]]]:
    """Flagged rows and required columns per Bronze table; the first table is the one service levels judge."""
    if spec.source_type == "csv":
        rows, nullable = _read_csv(lake, spec)
        # A value beyond the header belongs to no column, so its row is not known to be right.
        reason = F.when(F.col(SURPLUS).isNotNull(), F.lit(SURPLUS_REASON)).otherwise(F.col(REASON))
        flagged = flag_rows(rows, nullable).withColumn(REASON, reason).drop(SURPLUS)
        return {spec.target: (flagged, _required(rows, nullable))}
    if spec.source_type in ("sqlite", "jdbc"):
        rows = _read_database(lake, spec)
        return {spec.target: (flag_rows(rows), _required(rows))}
    # Parsed once into columns, from which each table then reads its own fields.
    parsed = scratch_path(lake.spark, "documents")
    read_match_documents(lake.spark, spec.location, spec.options.get("multi_line", True)).write.parquet(parsed)
    documents = lake.spark.read.parquet(parsed)
    return {
        spec.target: (
            flag_null_key(flatten_parents(documents).select(*PARENT_COLUMNS), "match_num", "null_match_num_pk"),
            ["match_num"],
        ),
        spec.secondary_target: (
            flag_null_key(flatten_children(documents).select(*CHILD_COLUMNS), "match_num", "null_match_num_fk"),
            ["match_num"],
        ),
    }


def breach_of(slo: Slo, rows_loaded: int, rows_dead: int, rows_total: int) -> str | None:
    """The service level a load misses, if any."""
    if rows_loaded < slo.min_rows:
        return f"{rows_loaded} rows loaded, at least {slo.min_rows} expected"
    if rows_total and 100.0 * rows_dead / rows_total > slo.max_dead_pct:
        return f"{100.0 * rows_dead / rows_total:.1f}% of rows rejected, at most {slo.max_dead_pct}% allowed"
    return None


def ingest(
    lake: Lake,
    spec: SourceSpec,
    slo: Slo | None = None,
    at: Column | None = None,
    drift_policy: str = "add",
    run_id: str | None = None,
    publish_on_breach: bool = False,
) -> LoadResult:
    """Full reload of one source.

    Rows are written once, then judged; only an accepted load becomes the table
    and moves the watermark. Rejected rows are kept in either case.
    ``publish_on_breach`` publishes first and reports afterwards.
    """
    run_id = run_id or str(uuid.uuid4())
    slo = slo_for(spec.source_name) if slo is None else slo
    at = now() if at is None else at
    loads = []
    for table, (flagged, required) in frames(lake, spec).items():
        schema = flagged.drop(REASON).schema
        lake.ensure(table, schema)
        lake.apply_drift(table, schema, drift_policy)
        name = spec.source_name if not loads else f"{spec.source_name}_goals"
        valid, dead, folder, dead_rows = lake.reload_split(with_audit(flagged, name, run_id, at), table)
        if dead:
            lake.append_dead_letters(dead_rows, name, run_id, at, required)
        loads.append((table, valid, dead, folder))
    rows_dead = sum(dead for _, _, dead, _ in loads)
    rows_loaded = sum(valid for _, valid, _, _ in loads)
    breach = breach_of(slo, loads[0][1], rows_dead, rows_loaded + rows_dead)
    if breach is None or publish_on_breach:
        for table, _, _, folder in loads:
            lake.point(table, folder)
        lake.move_watermark(spec.source_name, at, rows_loaded, run_id, updated_at=at)
    return LoadResult(
        spec.source_name,
        run_id,
        rows_loaded,
        rows_dead,
        "done" if breach is None else "failed",
        breach,
        {table: valid for table, valid, _, _ in loads},
    )


def ingest_all(lake: Lake, specs: list[SourceSpec], slos: dict[str, Slo] | None = None) -> list[LoadResult]:
    """Load every source; one that cannot be read is reported as failed and the others go on."""
    results = []
    for spec in specs:
        try:
            results.append(ingest(lake, spec, (slos or {}).get(spec.source_name)))
        except Exception as error:  # noqa: BLE001 - the failure is the result of this source
            results.append(LoadResult(spec.source_name, "", 0, 0, "failed", f"{type(error).__name__}: {error}"))
    return results


def run_log(lake: Lake, results: list[LoadResult]) -> DataFrame:
    """The outcomes of a run, one row per source of the registry."""
    rows = [(r.source_name, i, r.status, r.rows_loaded, r.rows_dead) for i, r in enumerate(results)]
    return lake.spark.createDataFrame(
        rows, "source_name string, run_no int, status string, rows_ingested bigint, dead_letter_count bigint"
    )
