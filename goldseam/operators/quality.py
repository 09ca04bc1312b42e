"""Tests on tables: expectations, their summary, and service levels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.spec import Slo


@dataclass(frozen=True)
class Expectation:
    """One test. ``kind`` is not_null, unique, at_least or holds.

    ``unique`` takes several columns; ``at_least`` a minimum that nulls pass;
    ``holds`` a condition that no row may break.
    """

    kind: str
    columns: tuple[str, ...] = ()
    minimum: float | None = None
    condition: str | None = None

    @property
    def name(self) -> str:
        parts = [self.kind, *self.columns]
        if self.kind == "holds":
            parts.append(self.condition)
        return "_".join(parts)

    def violation(self) -> Column:
        """True for a row that breaks a row-level test."""
        if self.kind == "not_null":
            return F.col(self.columns[0]).isNull()
        if self.kind == "at_least":
            return F.col(self.columns[0]) < self.minimum
        if self.kind == "holds":
            return ~F.coalesce(F.expr(self.condition), F.lit(True))
        raise ValueError(f"{self.kind} is not a row-level test")


def not_null(column: str) -> Expectation:
    return Expectation("not_null", (column,))


def unique(*columns: str) -> Expectation:
    return Expectation("unique", columns)


def at_least(column: str, minimum: float = 0) -> Expectation:
    return Expectation("at_least", (column,), minimum=minimum)


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values (or combinations) that occur more than once, nulls left out."""
    return df.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def violations(df: DataFrame, expectation: Expectation) -> DataFrame:
    """The rows that break a test; for ``unique`` the repeated values."""
    if expectation.kind == "unique":
        return duplicates(df, list(expectation.columns))
    return df.filter(expectation.violation())


def null_counts(df: DataFrame) -> DataFrame:
    """``(column_name, n_null)`` for every column from one scan."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], [f"`{c}`" for c in df.columns], "column_name", "n_null")


def run_expectations(df: DataFrame, model: str, expectations: list[Expectation]) -> DataFrame:
    """``(model, test_name, status, failures)``, one row per test.

    All row-level tests share one scan; each ``unique`` test is a grouping of its own.
    """
    row_level = [e for e in expectations if e.kind != "unique"]
    outcomes = []
    if row_level:
        counts = df.agg(*[F.count_if(e.violation()).alias(f"t{i}") for i, e in enumerate(row_level)])
        pairs = F.array(
            *[
                F.struct(F.lit(e.name).alias("test_name"), F.col(f"t{i}").alias("failures"))
                for i, e in enumerate(row_level)
            ]
        )
        outcomes.append(counts.select(F.inline(pairs)))
    for e in expectations:
        if e.kind == "unique":
            repeated = duplicates(df, list(e.columns)).agg(F.count("*").alias("failures"))
            outcomes.append(repeated.select(F.lit(e.name).alias("test_name"), "failures"))
    if not outcomes:
        return df.sparkSession.createDataFrame([], "model string, test_name string, status string, failures bigint")
    return reduce(DataFrame.unionByName, outcomes).select(
        F.lit(model).alias("model"),
        "test_name",
        F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"),
        "failures",
    )


def summarize_tests(results: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Per model: how many tests passed, which failed, and the gate.

    The model name is compared exactly. With ``models`` (a ``model`` column),
    a model without tests appears too and passes with a warning.
    """
    failed = F.col("status") != "pass"
    summary = results.groupBy("model").agg(
        F.count("*").alias("total"),
        F.count_if(~failed).alias("passed"),
        F.count_if(failed).alias("failed"),
        # One entry per failed test of a model: bounded by the tests written for it.
        F.array_sort(F.collect_list(F.when(failed, F.col("test_name")))).alias("failures"),
    )
    if models is not None:
        summary = models.select("model").distinct().join(summary, "model", "left")
    count = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "passed", "failed")}
    total, bad = F.coalesce("total", F.lit(0)), F.coalesce("failed", F.lit(0))
    return summary.select(
        "model",
        *count.values(),
        F.coalesce("failures", F.array().cast("array<string>")).alias("failures"),
        ((bad == 0) & (total > 0)).alias("all_passed"),
        F.when(total == 0, "passed_with_warning").when(bad == 0, "passed").otherwise("failed").alias("gate"),
    )


def reconcile(layers: dict[str, DataFrame]) -> DataFrame:
    """Row counts per layer in one row, and whether they agree."""
    counts = reduce(
        DataFrame.unionByName,
        [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n") for name, df in layers.items()],
    )
    rows = [F.max(F.when(F.col("layer") == name, F.col("n"))).alias(f"{name}_rows") for name in layers]
    return counts.agg(*rows, (F.min("n") == F.max("n")).alias("rows_match"))


def unexpected_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside the allowed list with their number of rows; nulls pass."""
    return df.filter(~F.col(column).isin(*allowed)).groupBy(column).agg(F.count("*").alias("n_rows"))


def dead_pct(dead: Column, total: Column) -> Column:
    return F.when(total > 0, F.lit(100.0) * dead / total)


def check_slos(loads: DataFrame, slos: dict[str, Slo]) -> DataFrame:
    """Judge ``(source_name, rows_loaded, rows_dead)`` by the levels of each source.

    Too few rows is reported first. The rate may be exactly at its limit, and an
    empty load has none. ``slos`` is configuration and travels as a literal map.
    """

    def level(attribute: str, default: float) -> Column:
        entries = [x for name, slo in slos.items() for x in (F.lit(name), F.lit(getattr(slo, attribute)))]
        if not entries:
            return F.lit(default)
        return F.coalesce(F.try_element_at(F.create_map(*entries), F.col("source_name")), F.lit(default))

    default = Slo()
    rate = dead_pct(F.col("rows_dead"), F.col("rows_loaded") + F.col("rows_dead"))
    too_few = F.col("rows_loaded") < level("min_rows", default.min_rows)
    too_many = rate > level("max_dead_pct", default.max_dead_pct)
    return loads.select(
        "source_name",
        "rows_loaded",
        "rows_dead",
        F.round(F.coalesce(rate, F.lit(0.0)), 1).alias("dead_pct"),
        F.when(too_few, "min_rows").when(too_many, "dead_letter_rate").alias("breach"),
        (~(too_few | F.coalesce(too_many, F.lit(False)))).alias("slo_passed"),
    )
