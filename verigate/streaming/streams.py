"""Streaming forms: exact dedup, windowed rates, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as an instant (the session's zone), which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def distinct_events(df: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    return timed(df, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_rate(df: DataFrame, ts: str, flag: str, every: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """n and cleared in each window of event time."""
    rows = timed(df, ts)
    rows = rows.withWatermark(ts, late) if df.isStreaming else rows
    return rows.groupBy(F.window(ts, every, slide) if slide else F.window(ts, every)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("cleared")).select(F.col("window.start").alias("start"), "n", "cleared")


def sessions(df: DataFrame, ts: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    rows = timed(df, ts)
    rows = rows.withWatermark(ts, late) if df.isStreaming else rows
    return rows.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def best_so_far(df: DataFrame, key: str, attempt: str, score: str, ts: str | None = None, late: str = "1 day", idle_ms: int | None = None) -> DataFrame:
    """A stream's best attempt of each key, emitted whenever it changes: key, attempt, score.

    Ties go to the lowest attempt. The state is one attempt for each key. With ``ts`` and ``idle_ms`` a key is forgotten
    when the watermark has passed its last event by so much (a later attempt begins anew), and late events are left out.
    """
    keys, kinds = [key, attempt, score], {f.name: f.dataType.simpleString() for f in df.schema.fields}
    expires = ts is not None and idle_ms is not None

    def update(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        best = start = held[:2] if held else None
        last = held[2] if held else 0
        for part in parts:
            for a, s in zip(part[attempt].tolist(), part[score].tolist(), strict=True):
                if best is None or (-s, a) < (-best[1], best[0]):
                    best = (int(a), float(s))
            if expires:
                last = max(last, int(part["_ms"].max()))
        if best is not None:
            state.update((*best, last))
            if expires:
                state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        if best != start:
            yield pd.DataFrame([(of[0], *best)], columns=keys)

    if expires:
        rows = timed(df, ts).withWatermark(ts, late)
        rows = rows.select(key, F.col(attempt).cast("long").alias(attempt), F.col(score).cast("double").alias(score), F.unix_millis(ts).alias("_ms"), ts)
    else:
        rows = df.select(key, F.col(attempt).cast("long").alias(attempt), F.col(score).cast("double").alias(score))
    schema = f"{key} {kinds[key]}, {attempt} long, {score} double"
    return rows.groupBy(key).applyInPandasWithState(update, schema, "attempt long, score double, last long", "append", GroupStateTimeout.EventTimeTimeout if expires else GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, folder: str) -> DataFrame:
    """Runs a streaming query over all that its source has now, with rows and checkpoint below ``folder``, and reads the
    rows so far. A second call with the same folder goes on where the last one, or one that was lost, has ended."""
    run = df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def written_in_batches(rows: DataFrame, batch: str, numbers: list[int], folder: str) -> None:
    """A file for each batch number, one after the other, without the number's column: what a stream's source finds."""
    for k in numbers:
        rows.where(F.col(batch) == k).drop(batch).coalesce(1).write.mode("append").parquet(folder)


def from_batches(rows: DataFrame, batch: str, folder: str) -> DataFrame:
    """The stream that takes a file of ``folder`` at a time; ``rows`` has its columns and the batch's number."""
    schema = rows.drop(batch).schema
    return rows.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
