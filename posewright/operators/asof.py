"""As-of joins and interval joins. Each is one sort of the union, with no pair of rows made but the result's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(left: DataFrame, right: DataFrame, key: str, at: str, payload: str) -> DataFrame:
    """Each left row with the last right row at or before it and the first at or after it: _prev, _prev_at, _next,
    _next_at (payload may be null in an existing row)."""
    rows = left.withColumns({"_is_left": F.lit(1), "_row": F.lit(None).cast(right.select(F.struct(at, payload)).schema[0].dataType)})
    other = right.select(key, at, F.lit(0).alias("_is_left"), F.struct(at, payload).alias("_row"))
    both = rows.unionByName(other, allowMissingColumns=True)
    up = Window.partitionBy(key).orderBy(at, "_is_left").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc(at), "_is_left").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns({"_p": F.last("_row", ignorenulls=True).over(up), "_n": F.last("_row", ignorenulls=True).over(down)}).where("_is_left = 1")
    return filled.withColumns({"_prev": F.col("_p")[payload], "_prev_at": F.col("_p")[at], "_next": F.col("_n")[payload], "_next_at": F.col("_n")[at]}).drop("_p", "_n", "_row", "_is_left")


def interpolated(at: Column) -> Column:
    """Value between the bracketing rows; the known side where one is null, the end where there is one side only."""
    span = (F.col("_next_at") - F.col("_prev_at")).cast("double")
    between = F.col("_prev") + (F.col("_next") - F.col("_prev")) * F.try_divide((at - F.col("_prev_at")).cast("double"), span)
    return F.when(F.col("_prev_at").isNull(), F.col("_next")).when(F.col("_next_at").isNull(), F.col("_prev")).when(F.col("_prev_at") == F.col("_next_at"), F.col("_prev")).otherwise(F.coalesce(between, F.col("_prev"), F.col("_next")))


def nearest(at: Column) -> Column:
    """Payload of the nearer bracketing row; the later one of equally near."""
    later = F.col("_prev_at").isNull() | (F.col("_next_at") - at <= at - F.col("_prev_at"))
    return F.when(F.coalesce(later, F.lit(False)), F.col("_next")).otherwise(F.col("_prev"))


def within(left: DataFrame, right: DataFrame, key: str, at: str, before: int, after: int, bins: int) -> DataFrame:
    """Pairs with right.at in [left.at - before, left.at + after], joined by bins of the axis so that no key's rows
    all meet. right's axis column is named _at in the result."""
    low, high = F.floor((F.col(at) - before) / bins), F.floor((F.col(at) + after) / bins)
    spread = left.withColumn("_bin", F.explode(F.sequence(low, high)))
    binned = right.withColumnRenamed(at, "_at").withColumn("_bin", F.floor(F.col("_at") / bins))
    return spread.join(binned, [key, "_bin"]).where((F.col("_at") >= F.col(at) - before) & (F.col("_at") <= F.col(at) + after)).drop("_bin")
