"""Snapshots from Structured Streaming: the files of a prepared table as micro-batches."""

from __future__ import annotations

import queue
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ProgressiveError
from ..operators.snapshots import STEP, one_snapshot
from ..plans.compiler import Plan
from ..sources.prepare import PARTITION
from .state import checkpoint, new_folder
from .stepper import Snapshot, slots

_END = object()
_FITS, _ROWS = "_fits", "_rows"


def stream_snapshots(plan: Plan, path: str) -> Iterator[Snapshot]:
    """Snapshots of ``plan`` over the one prepared table at ``path``, a file of a partition a micro-batch.

    The aggregation's state lives in the stream, by partition, with the number of rows read of each.
    A snapshot covers the partitions of which all rows that the catalog counts have arrived, and one is
    given whenever these have become more; empty partitions, which have no file, count from the
    beginning.  Files arrive in the order of their times, so the partitions come in any order; the last
    snapshot is the exact answer.
    """
    if len(plan.tables) != 1:
        raise ProgressiveError("a stream reads one table")
    spark = plan.base.sparkSession
    entries = {p.id: p.entries for p in plan.catalog.partitions(plan.tables[0])}
    names = list(plan.states.values())
    schema = spark.read.parquet(path).schema if any(entries.values()) else None

    def answer(done: int, state: DataFrame) -> Snapshot:
        reduced = plan.reduced(state, None, (), with_step=False)
        shown = one_snapshot(reduced, plan.group_columns(), names, done - 1)
        return Snapshot(done, done / plan.steps, plan.finish(plan.read_out(shown)))

    if schema is None:
        yield answer(plan.steps, plan.partial().drop(STEP))
        return
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = rows.withColumnRenamed(PARTITION, STEP).alias(plan.tables[0])
    # rows that the query does not want are counted, too: they tell when a partition is complete
    fits = F.expr(f"coalesce(({plan.select.where}), false)") if plan.select.where else F.lit(True)
    aggregated = plan.partial(rows, fits.alias(_FITS), F.count(F.lit(1)).alias(_ROWS))
    results: queue.Queue = queue.Queue()

    def take(batch: DataFrame, number: int) -> None:
        results.put(checkpoint(batch))

    query = (
        aggregated.writeStream.outputMode("complete")
        .option("checkpointLocation", new_folder(spark, "stream"))
        .foreachBatch(take)
        .trigger(availableNow=True)
        .start()
    )

    def wait() -> None:
        try:
            with slots:
                query.awaitTermination()
            results.put(_END)
        except Exception as error:  # for the reader
            results.put(error)

    threading.Thread(target=wait, daemon=True).start()
    shown = 0
    try:
        while (got := results.get()) is not _END:
            if isinstance(got, Exception):
                raise got
            read = {r[0]: r[1] for r in got.groupBy(STEP).agg(F.sum(_ROWS)).collect()}  # a row for each partition
            complete = [k for k, n in entries.items() if read.get(k, 0) >= n]
            if len(complete) > shown:
                shown = len(complete)
                yield answer(shown, got.where(F.col(_FITS) & F.col(STEP).isin(complete)).drop(STEP, _FITS, _ROWS))
    finally:
        query.stop()
