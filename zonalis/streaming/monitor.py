"""Watching runs: newest snapshot, staleness, and the same as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: After how long a silent run is stale, and how often a monitor looks.
STALE_SECONDS, POLL_SECONDS = 180, 3


def shown_state(state: Column, age_seconds: Column, stale: int = STALE_SECONDS) -> Column:
    """stale for a run that says it trains but wrote too long ago; waiting where nothing was written yet."""
    return F.when(state.isNull(), "waiting").when((state == "training") & (age_seconds > stale), "stale").otherwise(state)


def with_warnings(status: DataFrame) -> DataFrame:
    """status with the monitor's notes: trained on one font, and documents not located, which come before the score."""
    return status.withColumns({"one_font": F.size("fonts") == 1, "not_located_first": F.coalesce(F.col("real.not_located") > 0, F.lit(False))})


def newest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of every key, batch or streaming (complete or update mode)."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")).select(key, "_row.*")


def keep_snapshot(newest_rows: DataFrame, folder: str) -> str:
    """Runs a complete-mode stream until its source is read up, writing each state of the result as a table of its own; the path of the last one. Executors write the rows, so the driver holds none."""
    last = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/snapshot{batch}")
        last[:] = [f"{folder}/snapshot{batch}"]

    newest_rows.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/progress").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return last[0]


def polled(rows: DataFrame, write: Callable[[DataFrame, int], None], folder: str, seconds: float = POLL_SECONDS) -> StreamingQuery:
    """Starts a query that hands the rows' new state to `write` every so many seconds; progress is kept under folder."""
    return rows.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").foreachBatch(write).trigger(processingTime=f"{seconds} seconds").start()


def watch(events: DataFrame, key: str, state: str, at: str, stale_ms: int = STALE_SECONDS * 1000) -> DataFrame:
    """(key, state): a row whenever a run's state changes, and `stale` when a training run has been silent for stale_ms of processing time. Streaming only; one state is kept per run."""

    def follow(name: tuple[str], batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            (last, seen) = kept.get
            kept.remove()
            if last == "training":
                yield pd.DataFrame({"key": [name[0]], "state": ["stale"]})
            return
        last, seen = kept.get if kept.exists else (None, -1)
        before = last
        for x in batches:
            x = x.sort_values("at")
            if len(x) and int(x["at"].iloc[-1]) >= seen:
                last, seen = str(x["state"].iloc[-1]), int(x["at"].iloc[-1])
        kept.update((last, seen))
        kept.setTimeoutDuration(stale_ms)
        if last != before:
            yield pd.DataFrame({"key": [name[0]], "state": [last]})

    named = events.select(F.col(key).cast("string").alias("key"), F.col(state).alias("state"), F.col(at).cast("long").alias("at"))
    return named.groupBy("key").applyInPandasWithState(follow, "key string, state string", "state string, at long", "append", GroupStateTimeout.ProcessingTimeTimeout)
