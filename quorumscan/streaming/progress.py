"""Progress of tasks as a stream of snapshots that ends when nothing is left to wait for."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quorumscan.operators.catalog import progress_percent

#: States of a task that never change again; fixed values of the service.
TERMINAL = ("done", "failed", "cancelled")


def latest_progress(updates: DataFrame) -> DataFrame:
    """(task_id, item_id, status, stage, percent): the last update of each item by seq."""
    w = Window.partitionBy("task_id", "item_id").orderBy(F.col("seq").desc())
    last = updates.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return progress_percent(last).select("task_id", "item_id", "status", "stage", "percent")


def progress_stream(updates: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, expected: int, interval: str = "500 milliseconds") -> StreamingQuery:
    """Start a query over a stream of updates (task_id, item_id, seq, status, stage, fraction).

    Every batch gives ``sink`` the last state of each item that the batch has.  The query stops by itself once ``expected`` items have reached a
    terminal status; their identifiers are what the driver keeps.  A query that goes on from its checkpoint counts anew, so it
    is told how many items are still open.
    """
    ended: set[tuple] = set()
    done = threading.Event()

    def each(batch: DataFrame, number: int) -> None:
        state = latest_progress(batch).persist()
        sink(state, number)
        ended.update((r.task_id, r.item_id) for r in state.filter(F.col("status").isin(*TERMINAL)).select("task_id", "item_id").collect())
        state.unpersist()
        if len(ended) >= expected:
            done.set()

    query = updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()

    def stop() -> None:
        done.wait()
        query.processAllAvailable()
        query.stop()

    threading.Thread(target=stop, daemon=True).start()
    return query
