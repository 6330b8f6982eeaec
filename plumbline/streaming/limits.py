"""Structured Streaming versions of the ledger's limits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.ledger import allowed
from plumbline.shipping import ship


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name if not name.endswith("/") else "*").parquet(folder)


def _kept_by_batch(out: str):
    """A sink that keeps each micro-batch's rows in a folder of its own, so that a batch that runs again replaces its rows."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    return keep


def hourly_counts(spark: SparkSession, path: str, out: str) -> DataFrame:
    """user_id, hour, n: tumbling windows; a batch puts out the windows that it changed, and windows older than the watermark leave the state."""
    timed = events_stream(spark, path).withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "1 hour")
    counted = timed.groupBy("user_id", F.window("t", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")
    counted.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(_kept_by_batch(out)).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("user_id", "hour").agg(F.max_by("n", "batch").alias("n"))


#: Bits of a user_id that users whose events are decided together may differ in: 16 neighbours. A call of Python costs milliseconds, however few events it has.
TOGETHER = 4


def limited(stream: DataFrame, most: int, window: float, delay: str = "1 hour") -> DataFrame:
    """user_id, event_id, allowed, retry of a stream (user_id, event_id, t as seconds), decided in the order of time and event_id whatever order they come in.

    Events wait in the state until the watermark, delay behind the latest event of all, has passed them: so batches and frames may be out of order by that much, later ones are dropped. The times still in the window stay
    with them; a user whose window has emptied leaves the state. Neighbouring users share a state, null ones have their own. Rows without an event_id only move the watermark.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: dict[int, list[float]] = {}
        waiting: list[tuple[int, float, int]] = []
        if state.exists:
            owners, times, *rest = state.get
            for u, t in zip(owners, times, strict=True):
                kept.setdefault(u, []).append(t)
            waiting = list(zip(*rest, strict=True))
        for frame in frames:
            frame = frame[frame.event_id.notna()]
            users = frame.user_id.tolist() if key[0] is not None else [0] * len(frame)
            waiting += zip(users, frame.t.tolist(), map(int, frame.event_id.tolist()), strict=True)
        until = state.getCurrentWatermarkMs() / 1000
        ready, waiting = sorted(x for x in waiting if x[1] <= until), [x for x in waiting if x[1] > until]
        found: list[tuple[bool, int]] = []
        for u, own in groupby(ready, lambda x: x[0]):
            times, past = [x[1] for x in own], kept.get(u, [])
            new = allowed([*past, *times], most, window)[len(past) :]
            found += new
            kept[u] = [*past, *(t for t, (ok, _) in zip(times, new, strict=True) if ok)]
        held = [(u, t) for u, times in kept.items() for t in times if t > until - window]
        if ready:
            users = [x[0] for x in ready] if key[0] is not None else [None] * len(ready)
            yield pd.DataFrame({"user_id": users, "event_id": [x[2] for x in ready], "allowed": [x[0] for x in found], "retry": [x[1] for x in found]})
        if held or waiting:
            state.update(([u for u, _ in held], [t for _, t in held], [x[0] for x in waiting], [x[1] for x in waiting], [x[2] for x in waiting]))
            first = min(x[1] for x in waiting) if waiting else min(t for _, t in held) + window
            state.setTimeoutTimestamp(int(1000 * max(first, until)) + 1)
        elif state.exists:
            state.remove()

    ship(stream.sparkSession)
    timed = stream.withColumn("at", F.col("t").cast("timestamp")).withWatermark("at", delay).withColumn("together", F.shiftright("user_id", TOGETHER))
    kinds = "owners array<long>, kept array<double>, users array<long>, times array<double>, ids array<long>"
    return timed.groupBy("together").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean, retry long", kinds, "append", GroupStateTimeout.EventTimeTimeout)


def limited_in_parts(events: DataFrame, most: int, window: float, out: str, parts: int = 4) -> DataFrame:
    """The events as a stream that comes in so many parts, each one a run that goes on from the last one's checkpoint; at the end a row without an event moves the watermark past all."""
    spark = events.sparkSession
    ends = events.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if ends.a is None:
        return spark.createDataFrame([], "user_id long, event_id long, allowed boolean, retry long")
    width = (ends.b - ends.a) / parts or 1.0
    part = F.least(F.floor((F.col("t") - ends.a) / width), F.lit(parts - 1))
    for k in range(parts + 1):
        rows = events.where(part == k) if k < parts else spark.createDataFrame([(-1, None, ends.b + 10 * window)], "user_id long, event_id long, t double")
        rows.select("user_id", "event_id", "t").write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema("user_id long, event_id long, t double").parquet(f"{out}/in")
        limited(stream, most, window).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(_kept_by_batch(out)).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")
