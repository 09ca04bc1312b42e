"""Incremental Bronze loads: new files only, safe to repeat, each row once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from goldseam.operators.split import REASON
from goldseam.plans.ingest import breach_of
from goldseam.sources.lake import Lake, now, write_both
from goldseam.spec import Slo

BATCH_ID = "_batch_id"
LATE, NO_TIME = "late_row", "no_event_time"
ACCEPTED_SCHEMA = "accepted_batch bigint, n_valid bigint, n_rejected bigint"


class BatchRejected(Exception):
    """A micro-batch misses its service level: it is not published, and the stream stops before it."""


def write_batch(flagged: DataFrame, batch_id: int, target: str) -> tuple[int, int]:
    """Write one micro-batch, valid and rejected rows apart, into folders named by the batch.

    A batch that is run again after a failure overwrites its own folder, so its
    rows are never there twice. Returns the numbers of valid and of rejected rows.
    """
    seen = Observation()
    valid = F.col(REASON).isNull().alias("row_valid")
    rows = flagged.select(*flagged.columns, valid).observe(
        seen, F.count_if("row_valid").alias("valid"), F.count_if(~F.col("row_valid")).alias("dead")
    )
    write_both(rows, "row_valid", f"{target}/{BATCH_ID}={batch_id}", "overwrite")
    return seen.get["valid"], seen.get["dead"]


def load_new_files(
    stream: DataFrame,
    flag: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    lake: Lake | None = None,
    source: str | None = None,
    required: list[str] | None = None,
    slo: Slo | None = None,
) -> StreamingQuery:
    """Process what has arrived since the last run, then stop.

    The stream's checkpoint takes the place of a watermark value. With ``lake``
    and ``source`` the watermark table is still kept, as a record of the loads, and
    rejected rows go to the dead letters, where a repeated batch replaces its own;
    ``required`` names the columns whose absence the detail tells.

    With an ``slo``, each batch has to meet it before it is accepted, which one row below
    ``<target>-accepted`` says; ``read_loaded(..., gated=True)`` reads accepted batches. At
    one that misses it the query fails with :class:`BatchRejected`, neither watermark nor
    checkpoint moves, and the next run tries the batch again and overwrites its rows.
    Batches without rows, which only move event time on, are not judged.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        flagged = flag(batch)
        valid, rejected = write_batch(flagged, batch_id, target)
        if slo:
            breach = breach_of(slo, valid, rejected, valid + rejected) if valid + rejected else None
            if breach:
                raise BatchRejected(f"batch {batch_id}: {breach}")
            accepted = batch.sparkSession.createDataFrame([(batch_id, valid, rejected)], ACCEPTED_SCHEMA)
            accepted.write.mode("overwrite").parquet(f"{target}-accepted/batch={batch_id}")
        if lake is None:
            return
        run = f"batch-{batch_id}"
        if rejected:
            written = f"{target}/{BATCH_ID}={batch_id}/row_valid=false"
            dead = batch.sparkSession.read.schema(flagged.schema).parquet(written)
            lake.append_dead_letters(dead, source, run, now(), required)
        lake.move_watermark(source, now(), valid, run)

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def once_each(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The rows of a stream, each key once however often and in whatever batch it comes.

    The state store holds a key until the stream's event time has passed its own by
    ``delay``; a row that is further behind is late and left out, as it could no longer be
    told from a repeated one (:func:`late_rows` finds it again). Rows without a time must
    have been taken out.
    """
    # Event time has to be a timestamp with a zone; which one makes no difference to distances.
    marked = stream.withColumn("_event_time", F.col(time).cast("timestamp")).withWatermark("_event_time", delay)
    return marked.dropDuplicatesWithinWatermark(keys).drop("_event_time")


def load_events(
    stream: DataFrame,
    flag: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    keys: list[str],
    time: str,
    delay: str,
    lake: Lake | None = None,
    source: str | None = None,
    slo: Slo | None = None,
) -> list[StreamingQuery]:
    """Load what has arrived, every key once, rows without an event time as dead letters. Two queries, each with its checkpoint.

    ``stream`` is read by both. Without a lake, rows without a time lie in ``<target>-no-time``.
    """
    timed = once_each(stream.filter(F.col(time).isNotNull()), keys, time, delay)
    untimed = stream.filter(F.col(time).isNull())

    def reject(batch: DataFrame) -> DataFrame:
        return batch.withColumn(REASON, F.lit(NO_TIME))

    return [
        load_new_files(timed, flag, target, f"{checkpoint}/timed", lake, source, slo=slo),
        load_new_files(untimed, reject, f"{target}-no-time", f"{checkpoint}/untimed", lake, f"{source}-no-time" if source else None, [time]),
    ]


def late_rows(arrived: DataFrame, loaded: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The rows of all files whose key was never loaded, one per key, with the reason: they came behind the event time.

    ``loaded`` are the valid and the rejected rows of the target. Keys alone are compared;
    rows without a time have been rejected elsewhere.
    """
    missing = arrived.filter(F.col(time).isNotNull()).join(loaded.select(*keys).distinct(), keys, "left_anti")
    row = F.struct(*(F.col(f"`{c}`") for c in arrived.columns))
    one = missing.groupBy(*keys).agg(F.max_by(row, F.col(time)).alias("_row")).select("_row.*")
    return one.withColumn(REASON, F.lit(LATE))


def read_loaded(spark: SparkSession, target: str, valid: bool = True, gated: bool = False) -> DataFrame:
    """Rows of all batches, with the batch they came in; ``gated``: of the accepted ones only."""
    rows = spark.read.option("basePath", target).parquet(target)
    if gated:
        accepted = spark.read.schema(ACCEPTED_SCHEMA).parquet(f"{target}-accepted").select(F.col("accepted_batch").cast("int").alias(BATCH_ID))
        rows = rows.join(accepted, BATCH_ID, "left_semi")
    return rows.filter(F.col("row_valid") == valid).drop("row_valid", *([REASON] if valid else []))
