"""Joins, set operations and top-k picks on whole relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(baseline: DataFrame, current: DataFrame, key: str, metrics: list[str], least: float = 0.01) -> DataFrame:
    """Cell by cell differences of two snapshots. Keys of one side only are new or removed; cells that are no numbers
    are left out, differences under `least` too."""
    long = lambda df, name: df.select(key, F.lit(True).alias(f"_{name}"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(f"try_cast(`{m}` as double)").alias(name)) for m in metrics))).alias("_c")).select(key, f"_{name}", "_c.*")
    both = long(baseline, "baseline").join(long(current, "current"), [key, "metric"], "full_outer")
    status = F.when(F.col("_baseline").isNull(), "new").when(F.col("_current").isNull(), "removed").otherwise("changed")
    delta = F.col("current") - F.col("baseline")
    rows = both.withColumns({"status": status, "delta": F.round(delta, 6)}).where(F.coalesce("baseline", "current").isNotNull() & ((F.col("status") != "changed") | (F.abs(delta) >= least)))
    return rows.select(key, "metric", "status", "baseline", "current", "delta")


def splice(old: DataFrame, new: DataFrame, order: str, cut: int, known: list[str]) -> DataFrame:
    """Old rows before the cut and new rows from it on of which any of `known` is not null."""
    return old.where(F.col(order) < cut).unionByName(new.where((F.col(order) >= cut) & F.coalesce(*known).isNotNull()))


def zone_highlights(df: DataFrame, key: str, order: str, score: str, peak: int, k: int) -> DataFrame:
    """The k best buckets of the first 40 % and of the last 40 %, without the best contiguous `peak` buckets."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, peak - 1)
    full = df.withColumn("_s", F.sum(score).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == peak)
    best = full.groupBy(key).agg(F.min_by(order, F.struct(-F.col("_s"), F.col(order))).alias("_start"))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    rest = df.withColumn("_n", n).join(best, key, "left").where(F.col("_start").isNull() | (F.col(order) < F.col("_start")) | (F.col(order) >= F.col("_start") + peak))
    zone = F.when(F.col(order) < 0.4 * F.col("_n"), "first").when(F.col(order) >= 0.6 * F.col("_n"), "last")
    ranked = rest.withColumn("zone", zone).where("zone is not null").withColumn("_r", F.row_number().over(Window.partitionBy(key, "zone").orderBy(F.desc(score), order)))
    return ranked.where(F.col("_r") <= k).select(key, order, score, "zone")


def top_then_sideways(df: DataFrame, key: str, score: str, x: str, k: int) -> DataFrame:
    """The k best rows of each key, numbered from left to right."""
    best = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), x))).where(F.col("_r") <= k)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(x))).drop("_r")


def seed_frame(df: DataFrame, key: str, order: str, count: str) -> DataFrame:
    """First frame with exactly two detections, else the first with more."""
    return df.groupBy(key).agg(F.coalesce(F.min(F.when(F.col(count) == 2, F.col(order))), F.min(F.when(F.col(count) > 2, F.col(order)))).alias("seed_fi"))
