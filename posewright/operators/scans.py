"""Running products of a session's rows under an associative operation, without a fold over the session.

`block_scan` works for any operation: blocks of rows are scanned on their own, their totals are scanned in the same way,
and each block takes what came before it. No array is longer than a block but the last level's, of n / block ** levels.
`two_states` is the case of maps on two states, which windows alone express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, LEVELS = 128, 2


def block_scan(df: DataFrame, keys: list[str], order: str, value: str, combine: Callable[[Column, Column], Column], block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """df with `value` replaced by the product of the values of its key's rows up to its own, in the order of `order`,
    whole numbers from 0 on. combine(earlier, later) is associative; it need not commute."""
    rest = [c for c in df.columns if c not in (*keys, order, value)]
    at = F.floor(F.col(order) / block) if levels else F.lit(0).cast("long")
    rows = df.groupBy(*keys, at.alias("_block")).agg(F.array_sort(F.collect_list(F.struct(order, value, *rest))).alias("_rows"))
    values = F.transform("_rows", lambda r: r[value])
    products = F.aggregate(F.slice(values, 2, F.size("_rows")), F.slice(values, 1, 1), lambda done, x: F.concat(done, F.array(combine(F.element_at(done, -1), x))))
    rows = rows.select(*keys, "_block", F.zip_with("_rows", products, lambda r, p: F.struct(r[order].alias(order), p.alias(value), *(r[c].alias(c) for c in rest))).alias("_rows"))
    if levels:
        totals = rows.select(*keys, "_block", F.element_at("_rows", -1)[value].alias("_before"))
        # a block takes the product up to the last block before it, which need not be its neighbour
        up_to = block_scan(totals, keys, "_block", "_before", combine, block, levels - 1)
        carried = up_to.select(*keys, F.lead("_block").over(Window.partitionBy(*keys).orderBy("_block")).alias("_block"), "_before").where("_block is not null")
        rows = rows.join(carried, [*keys, "_block"], "left")
        whole = lambda p: F.when(F.col("_before").isNull(), p).otherwise(combine(F.col("_before"), p))
        rows = rows.withColumn("_rows", F.transform("_rows", lambda r: F.struct(r[order].alias(order), whole(r[value]).alias(value), *(r[c].alias(c) for c in rest))))
    return rows.select(*keys, F.inline("_rows")).select(*df.columns)


def two_states(df: DataFrame, keys: list[str], order: str, from_no: Column, from_yes: Column, name: str) -> DataFrame:
    """Adds the state, first false, behind each row's map: what false and what true become.

    A map is constant, or turns the state over, or keeps it. So the state is the last constant turned over once for each
    turn behind it: two running windows over the same order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_no": from_no, "_yes": from_yes})
    turns = F.sum((F.col("_no") & ~F.col("_yes")).cast("int")).over(w)
    df = df.withColumn("_turns", turns)
    # the state that a constant sets, as it would have been before all turns so far
    fixed = F.last(F.when(F.col("_no") == F.col("_yes"), F.col("_no").cast("int") + F.col("_turns")), ignorenulls=True).over(w)
    return df.withColumn(name, F.pmod(F.coalesce(fixed, F.lit(0)) + F.col("_turns"), F.lit(2)) == 1).drop("_no", "_yes", "_turns")
