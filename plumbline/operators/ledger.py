"""Operational analytics over a job ledger: quotas, spend caps, queue places, retention, limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.shipping import ship


def spend_status(daily: DataFrame, day_cap: float, week_cap: float, killed: Column | None = None) -> DataFrame:
    """day, day_cost, week_cost, reason from rows (day, cost): the kill switch counts first, then the day's cap, then the week's.

    The week's spend is a window over days, not over jobs, so its size is the calendar's.
    """
    days = daily.groupBy("day").agg(F.sum("cost").alias("day_cost"))
    week = F.sum("day_cost").over(Window.orderBy(F.unix_date("day")).rangeBetween(-7, 0))
    d = days.select("day", F.round("day_cost", 2).alias("day_cost"), F.round(week, 2).alias("week_cost"))
    killed = F.lit(False) if killed is None else killed
    reason = F.when(killed, "kill_switch").when(F.lit(day_cap > 0) & (F.col("day_cost") >= day_cap), "daily_cap_exceeded").when(F.lit(week_cap > 0) & (F.col("week_cost") >= week_cap), "weekly_cap_exceeded").otherwise("ok")
    return d.select("*", reason.alias("reason"))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """id, position of the queued jobs in order of creation over all users.

    Places within a day are counted in the day's own partition and moved on by what earlier days hold.
    """
    queued = jobs.where("status = 'queued'").select("id", "created_at")
    days = queued.groupBy("created_at").count()
    days = days.select("created_at", F.coalesce(F.sum("count").over(Window.orderBy("created_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("created_at").orderBy("id"))
    return queued.withColumn("nth", nth).join(days, "created_at").select("id", (F.col("ahead") + F.col("nth")).alias("position"))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*(c.desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def allowed(times: list[float], most: int, window: float) -> list[tuple[bool, int]]:
    """For each time in order: whether the limiter lets it through, and else the seconds to wait; denied ones aren't recorded."""
    kept: list[float] = []
    out = []
    for t in times:
        kept = [x for x in kept if x > t - window]
        if len(kept) >= most:
            out.append((False, max(int(kept[0] - (t - window)) + 1, 1)))
        else:
            kept.append(t)
            out.append((True, 0))
    return out


def rate_limit(events: DataFrame, most: int, window: float) -> DataFrame:
    """user_id, event_id, allowed, retry of events (user_id, event_id, t); a user's events are folded in order of time.

    Rows come sorted within partitions by user and time, and only the times still inside the window are held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, kept = None, []
        for batch in batches:
            ok, retry = [], []
            for u, t in zip(batch.user_id, batch.t, strict=True):
                if u != user:
                    user, kept = u, []
                kept = [x for x in kept if x > t - window]
                full = len(kept) >= most
                ok.append(not full)
                retry.append(max(int(kept[0] - (t - window)) + 1, 1) if full else 0)
                if not full:
                    kept.append(t)
            yield pd.DataFrame({"user_id": batch.user_id, "event_id": batch.event_id, "allowed": ok, "retry": retry})

    ship(events.sparkSession)
    dealt = events.select("user_id", "event_id", "t").repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
    return dealt.mapInPandas(fold, "user_id long, event_id long, allowed boolean, retry long")


def deduct(requests: DataFrame) -> DataFrame:
    """user_id, seq, granted, balance of requests (user_id, seq, pages, start): each is granted if the running balance allows it."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, left = None, 0
        for batch in batches:
            granted, balance = [], []
            for u, pages, start in zip(batch.user_id, batch.pages, batch.start, strict=True):
                if u != user:
                    user, left = u, start
                ok = pages <= left
                left -= pages if ok else 0
                granted.append(bool(ok))
                balance.append(left)
            yield pd.DataFrame({"user_id": batch.user_id, "seq": batch.seq, "granted": granted, "balance": balance})

    ship(requests.sparkSession)
    dealt = requests.select("user_id", "seq", "pages", "start").repartition("user_id").sortWithinPartitions("user_id", "seq")
    return dealt.mapInPandas(fold, "user_id long, seq long, granted boolean, balance long")


def inserted(jobs: DataFrame, asked: DataFrame, order: str, written) -> DataFrame:
    """jobs (id, user_id, status, pages) with a queued row for each of asked (user_id, pages, ...), numbered on from the largest id in the order of that column.

    Numbers come from a range sort and a running count of its parts' sizes, so no task holds all that is asked.
    """
    last = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    dealt = written(asked.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = parts.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"))
    new = dealt.join(parts, "_part").select((F.lit(last) + F.col("_at") + F.col("_shift") + 1).alias("id"), "user_id", F.lit("queued").alias("status"), "pages")
    return jobs.unionByName(new)
