"""Valid and rejected rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.functions.text import payload_json

COERCION_REASON = "null_or_coercion_failure"
REASON = "_rejection_reason"
DETAIL = "_rejection_detail"
# What is kept of detail and id under ``parity``.
DETAIL_LENGTH = 2000
ID_LENGTH = 16


def missing_any(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in columns], F.lit(False))


def flag_rows(df: DataFrame, nullable: set[str] = frozenset(), reason: str = COERCION_REASON) -> DataFrame:
    """Add the reason a row is rejected for: a required column is null.

    An empty ``nullable`` is the strict rule for database rows.
    """
    required = [c for c in df.columns if c not in nullable and not c.startswith("_")]
    return df.withColumn(REASON, F.when(missing_any(required), F.lit(reason)))


def missing_names(columns: list[str]) -> Column:
    """Names of the columns that are null, joined with commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in columns])), ",")


def flag_null_key(df: DataFrame, key: str, reason: str) -> DataFrame:
    """Rows without ``key`` are rejected, e.g. as ``null_match_num_pk``."""
    return df.withColumn(REASON, F.when(F.col(key).isNull(), F.lit(reason)))


def valid_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col(REASON).isNull()).drop(REASON)


def dead_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col(REASON).isNotNull())


def dead_letters(
    dead: DataFrame, source: str, batch_id: str, ingested_at: Column, parity: bool = False,
    required: list[str] | None = None,
) -> DataFrame:
    """Rejected rows in dead-letter shape; columns that start with ``_`` stay out of the payload.

    The detail names the ``required`` columns that are null, unless the rows bring one of
    their own. Id and detail are whole; ``parity`` cuts them to 16 and 2,000 characters, as the reference does.
    """
    if DETAIL in dead.columns:
        detail = F.coalesce(F.col(DETAIL), F.lit(""))
    else:
        detail = missing_names(required) if required else F.lit("")
    return dead.select(
        (F.left(F.uuid(), F.lit(ID_LENGTH)) if parity else F.uuid()).alias("_dl_id"),
        ingested_at.alias("_ingested_at"),
        F.lit(batch_id).alias("_batch_id"),
        F.lit(source).alias("_source"),
        F.coalesce(F.col(REASON), F.lit("unknown")).alias("_error_type"),
        (F.left(detail, F.lit(DETAIL_LENGTH)) if parity else detail).alias("_error_detail"),
        F.parse_json(payload_json(dead.columns)).alias("_raw_payload"),
    )
