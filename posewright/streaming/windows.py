"""Streaming twins of the bucket, window and fold operators.

Input: a stream with session, ts (timestamp), side, v. State is keyed by session, and watermarks bound what each
window keeps; rows later than `lateness` are left out, as Structured Streaming does. A timestamp without time zone
is cast first, since watermarks need one with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from posewright.functions.columns import share


def timed(stream: DataFrame, lateness: str, at: str = "ts") -> DataFrame:
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)


def bucket_share(stream: DataFrame, width: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """Two-sided share of v per session and tumbling bucket: session, start, my_share, op_share."""
    total = lambda s: F.round(F.sum(F.when(F.col("side") == s, F.col("v")).otherwise(0.0)), 6)
    sums = timed(stream, lateness).groupBy("session", F.window("ts", width).alias("w")).agg(total("my").alias("_a"), total("op").alias("_b"))
    return sums.select("session", F.col("w.start").alias("start"), share(F.col("_a"), F.col("_b")).alias("my_share")).withColumn("op_share", 100 - F.col("my_share"))


def sliding_sum(stream: DataFrame, width: str = "5 seconds", step: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """Sum and number of values per session and sliding window."""
    sums = timed(stream, lateness).groupBy("session", F.window("ts", width, step).alias("w")).agg(F.round(F.sum("v"), 6).alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.select("session", F.col("w.start").alias("start"), "total", "n")


def gap_events(stream: DataFrame, flag: str, gap: str = "5 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Runs of flagged rows that are less than `gap` apart: session, start, end of the last row's gap, n."""
    runs = timed(stream, lateness).where(flag).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return runs.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def swap_votes(stream: DataFrame, vote: str, commit: int = 3, lateness: str = "10 seconds", silence_ms: int = 3_600_000) -> DataFrame:
    """Commits so far of each session's votes: one adds, a missing one takes back (not below 0), `commit` votes commit
    and reset. Two numbers of state a session, which go `silence_ms` after its last row; rows of a micro-batch are taken
    in the order of ts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, swaps = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")  # one session's rows of one micro-batch
        for yes in rows["vote"]:
            n = n + 1 if yes else max(n - 1, 0)
            if n >= commit:
                n, swaps = 0, swaps + 1
        state.update((n, swaps))
        # no earlier than the watermark, which other sessions may have moved on
        last = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + silence_ms)
        yield pd.DataFrame({"session": [key[0]], "swaps": [swaps]})

    rows = timed(stream, lateness).select("session", "ts", F.expr(vote).alias("vote"))
    return rows.groupBy("session").applyInPandasWithState(step, "session long, swaps int", "n int, swaps int", "update", GroupStateTimeout.EventTimeTimeout)


def half_split(ticks: DataFrame, values: DataFrame, reach: str = "750 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """Mean of the first and of the second half of each tick's surroundings: session, at, first_half, second_half, n.

    ticks: (session, at); values: (session, ts, v), both streams. An interval join closed at both ends under watermarks
    keeps rows of either side no longer than the other can still reach them; the halves are told once the watermark has
    passed the tick's interval, from the ordered values of one tick, whose number the interval bounds."""
    left = timed(ticks, lateness, "at").select("session", "at").alias("t")
    right = timed(values, lateness).select(F.col("session").alias("_session"), "ts", F.unix_micros("ts").alias("us"), "v").alias("v")
    near = left.join(right, F.expr(f"session = _session AND ts >= at - interval {reach} AND ts <= at + interval {reach}")).select("session", "at", "us", "v")
    groups = near.groupBy("session", "at").agg(F.array_sort(F.collect_list(F.struct("us", "v"))).alias("rows"))
    n = F.size("rows")
    half = F.floor(n / 2).cast("int")
    mean = lambda part: F.round(F.aggregate(part, F.lit(0.0), lambda s, r: s + r["v"]) / F.size(part), 6)
    return groups.where(n >= 3).select("session", "at", mean(F.slice("rows", F.lit(1), half)).alias("first_half"), mean(F.slice("rows", half + 1, n - half)).alias("second_half"), n.alias("n"))
