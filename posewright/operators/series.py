"""Operators over ordered series: shares, spines, windows, peaks, islands, quantiles. All are native plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posewright.functions.columns import share


def ordered(keys: list[str], order: str = "fi"):
    return Window.partitionBy(*keys).orderBy(order)


def bucket_share(df: DataFrame, keys: list[str], my: Column, op: Column) -> DataFrame:
    """Two-sided share of a sum per group."""
    sums = df.groupBy(*keys).agg(F.round(F.sum(my), 6).alias("_a"), F.round(F.sum(op), 6).alias("_b"))
    return sums.withColumn("my_share", share(F.col("_a"), F.col("_b"))).withColumn("op_share", 100 - F.col("my_share")).drop("_a", "_b")


def dense_spine(df: DataFrame, key: str, bucket: str, last: Column | None = None) -> DataFrame:
    """Every bucket from 0 to the last one of each key."""
    ends = df.groupBy(key).agg((last if last is not None else F.max(bucket)).alias("_end"))
    return ends.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_end").cast("long"))).alias(bucket))


def fill_spine(spine: DataFrame, values: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    return spine.join(values, on, "left").fillna(defaults)


def first_seen_mode(df: DataFrame, keys: list[str], value: str, order: str = "fi") -> DataFrame:
    """Most frequent value of each group; of equally frequent ones the first seen."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value))


def nearest_rank(df: DataFrame, keys: list[str], value: Column, q: float, name: str) -> DataFrame:
    """sorted[int(n * q)] of each group, as a window rank: a group's values are never collected into one row."""
    w = Window.partitionBy(*keys).orderBy("_v")
    ranked = df.select(*keys, value.alias("_v")).where("_v is not null").withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return ranked.where(F.col("_i") == F.floor(F.col("_n") * F.lit(q))).select(*keys, F.col("_v").alias(name))


def exact_median(df: DataFrame, keys: list[str], value: str, name: str, bins: int = 4096) -> DataFrame:
    """Median of each group, the mean of the middle two, without a group's values in one task.

    Values fall into bins between the group's least and greatest; counts tell which bin, or two, hold the middle ranks,
    and only the distinct values of these are ranked. Both passes count on the map side first."""
    known = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    ends = known.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"))
    placed = known.join(ends, keys).withColumn("_bin", F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins)).otherwise(0))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = lambda first, count: (first < F.floor(F.col("_n") / 2) + 1) & (first + count > F.floor((F.col("_n") - 1) / 2))
    held = placed.groupBy(*keys, "_bin", "_n").agg(F.count(F.lit(1)).alias("_c")).withColumn("_first", before).where(middle(F.col("_first"), F.col("_c"))).select(*keys, "_bin", "_first")
    counts = placed.join(held, [*keys, "_bin"]).groupBy(*keys, "_bin", "_first", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("_at", F.col("_first") + inside).where(middle(F.col("_at"), F.col("_c")))
    return ranked.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias(name))


#: Rows of a session that one task takes at a time where windows are bounded.
BLOCK = 4096


def in_blocks(df: DataFrame, keys: list[str], order: str, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """df with `_block` and `_own`: rows cut into blocks of the order, each with copies of the `before` rows ahead of it
    and the `after` rows behind it. A window of that reach over the block gives own rows what the whole session gives.

    The order is whole numbers without gaps; a row is copied before + after times in `block` on average, and a session
    of any length is many tasks."""
    at = F.col(order)
    low, high = F.greatest(F.floor((at - after) / block), F.lit(0)), F.floor((at + before) / block)
    return df.withColumn("_block", F.explode(F.sequence(low, high))).withColumn("_own", F.col("_block") == F.floor(at / block))


def over_blocks(keys: list[str], order: str):
    return Window.partitionBy(*keys, "_block").orderBy(order)


def local_peaks(df: DataFrame, keys: list[str], score: str, least: float, half: int, order: str = "fi") -> DataFrame:
    """Rows of local maxima of at least `least`; of equal ones less than half + 1 apart the first stays.

    Strict maxima come from one window. Only runs of equal maxima need the fold over what the window leaves.
    """
    w = ordered(keys, order)
    found = df.withColumn("_top", F.max(score).over(w.rowsBetween(-half, half))).where((F.col(score) >= least) & (F.col(score) == F.col("_top"))).drop("_top")
    near = found.withColumn("_gap", F.col(order) - F.lag(order).over(w)).withColumn("_run", F.sum(F.when(F.col("_gap") <= half, 0).otherwise(1)).over(w))
    kept = near.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(order)).alias("_all")).select(
        *keys,
        F.explode(
            F.aggregate("_all", F.array().cast("array<int>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) > half), F.concat(acc, F.array(x))).otherwise(acc))
        ).alias(order),
    )
    return found.join(kept, [*keys, order], "left_semi")


def with_peaks(df: DataFrame, keys: list[str], score: str, least: float, half: int, name: str, order: str = "fi") -> DataFrame:
    """Adds a flag for what local_peaks keeps, with windows alone: rows keep their partitioning by key."""
    w = ordered(keys, order)
    top = (F.col(score) >= least) & (F.col(score) == F.max(score).over(w.rowsBetween(-half, half)))
    df = df.withColumn("_top", F.when(top, F.col(order)))
    before = F.last("_top", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_run", F.sum(F.when(F.col("_top").isNotNull() & (before.isNull() | (F.col("_top") - before > half)), 1).otherwise(0)).over(w))
    near = F.array_sort(F.collect_list("_top").over(Window.partitionBy(*keys, "_run")))  # equal maxima close to each other
    kept = F.aggregate(near, F.array().cast("array<int>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) > half), F.concat(acc, F.array(x))).otherwise(acc))
    return df.withColumn(name, F.col("_top").isNotNull() & F.array_contains(kept, F.col(order))).drop("_top", "_run")


def fill_gaps(df: DataFrame, key: str, bucket: str, end: Column, defaults: dict[str, object]) -> DataFrame:
    """Rows for every bucket from 0 to `end`, the missing ones with default values; without a join."""
    w = ordered([key], bucket)
    first = F.row_number().over(w) == 1
    df = df.withColumn("_from", F.when(first, F.lit(0).cast("long")).otherwise(F.col(bucket).cast("long"))).withColumn("_to", F.coalesce(F.lead(bucket).over(w).cast("long") - 1, F.greatest(end.cast("long"), F.col(bucket).cast("long"))))
    rows = df.withColumn("_at", F.explode(F.sequence("_from", "_to")))
    own = F.col("_at") == F.col(bucket)
    filled = rows.withColumns({n: F.when(own, F.coalesce(F.col(n), F.lit(v))).otherwise(F.lit(v)) for n, v in defaults.items()})
    return filled.withColumn(bucket, F.col("_at")).drop("_from", "_to", "_at")


def gap_events(df: DataFrame, keys: list[str], flag: Column, gap: int, order: str = "fi") -> DataFrame:
    """Number of runs of flagged rows that are more than `gap` apart; 0 where none is flagged."""
    marked = df.withColumn("_flag", flag)
    rows = marked.where("_flag").withColumn("_before", F.lag(order).over(ordered(keys, order)))
    events = rows.groupBy(*keys).agg(F.count_if(F.col("_before").isNull() | (F.col(order) - F.col("_before") > gap)).alias("n_events"))
    return df.select(*keys).distinct().join(events, keys, "left").fillna({"n_events": 0})


def first_run(df: DataFrame, keys: list[str], vote: Column, length: int, order: str = "fi") -> DataFrame:
    """First row of the first run of `length` consecutive votes, null without one."""
    w = ordered(keys, order)
    runs = df.withColumn("_vote", vote).withColumn("_run", F.sum(F.when(F.col("_vote"), 0).otherwise(1)).over(w)).where("_vote")
    starts = runs.groupBy(*keys, "_run").agg(F.min(order).alias("_start"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= length)
    return df.select(*keys).distinct().join(starts.groupBy(*keys).agg(F.min("_start").alias("first_fi")), keys, "left")


def mark_around(df: DataFrame, keys: list[str], event: Column, before: int, after: int, order: str = "fi") -> Column:
    """True from `before` rows ahead of an event to `after` rows behind it."""
    return F.max(F.when(event, 1).otherwise(0)).over(ordered(keys, order).rowsBetween(-after, before)) == 1


def carried(value: Column, initial: float, keys: list[str], order: str) -> Column:
    """Last known value, `initial` before the first."""
    return F.coalesce(F.last(value, ignorenulls=True).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(initial))


def decayed(percent: Column, normal: Column, held: Column, keys: list[str], order: str, tau: float) -> Column:
    """Share of a bucket: its own where normal; where held, the last normal one drawn to 50 by the time since; else 50."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(normal, percent), ignorenulls=True).over(w)
    since = F.col(order) - F.last(F.when(normal, F.col(order)), ignorenulls=True).over(w)
    faded = F.bround(F.round(50 + (last - 50) * F.exp(-since / tau), 9))
    return F.when(normal, percent).when(held & last.isNotNull(), faded).otherwise(50).cast("int")
