"""Cycles as Structured Streaming: new opportunities once, matched against the profiles, into the history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(stream: DataFrame, key: str = "id", time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Each key once; with a time column, state is kept for the delay alone."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else stream.dropDuplicates([key])


def daily(stream: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    """(day, kind, n) by event time; days are final when the watermark has passed them."""
    per = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), kind).agg(F.count("*").alias("n"))
    return per.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), kind, "n")


def cycle(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Runs work on each batch of new rows: all there is now, or for ever at an interval. Work gets the batch's number, so it can be idempotent."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


HEALTH = "source string, consecutive_zeros long, total_found long, alert boolean"


def health(stream: DataFrame) -> DataFrame:
    """State of each source from (source, run, found): zeros since the last success, total, and the alert at three.

    Runs of a batch count in their order, in whatever order they come; errors, found below 0, change nothing. Of a batch only the runs
    without success since its last one are in memory at a time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        zeros, total = state.get if state.exists else (0, 0)
        won, since = None, []
        for f in frames:
            total += int(f["found"].clip(lower=0).sum())
            wins = f["run"][f["found"] > 0]
            if len(wins) and (won is None or wins.max() > won):
                won = wins.max()
                since = [r for r in since if r > won]
            since += [r for r in f["run"][f["found"] == 0] if won is None or r > won]
        zeros = len(since) + (zeros if won is None else 0)
        state.update((zeros, total))
        yield pd.DataFrame({"source": [key[0]], "consecutive_zeros": [zeros], "total_found": [total], "alert": [zeros >= 3]})

    return stream.groupBy("source").applyInPandasWithState(step, HEALTH, "zeros long, total long", "update", GroupStateTimeout.NoTimeout)
