"""Affine maps, rigid fits, grids and assignments as plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posewright.functions.columns import iou

AFFINE = ("a", "b", "tx", "c", "d", "ty")


def compose(m: Column, n: Column) -> Column:
    """m after n, both structs of AFFINE."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"), (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"), (m["a"] * n["tx"] + m["b"] * n["ty"] + m["tx"]).alias("tx"),
        (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"), (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"), (m["c"] * n["tx"] + m["d"] * n["ty"] + m["ty"]).alias("ty"),
    )


def invert(m: Column) -> Column:
    """Null where the map has no inverse."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    a, b, c, d = F.try_divide(m["d"], det), F.try_divide(-m["b"], det), F.try_divide(-m["c"], det), F.try_divide(m["a"], det)
    return F.struct(a.alias("a"), b.alias("b"), (-(a * m["tx"] + b * m["ty"])).alias("tx"), c.alias("c"), d.alias("d"), (-(c * m["tx"] + d * m["ty"])).alias("ty"))


def applied(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["b"] * y + m["tx"], m["c"] * x + m["d"] * y + m["ty"]


def decomposed(m: Column) -> Column:
    return F.struct(m["tx"].alias("tx"), m["ty"].alias("ty"), F.hypot(m["a"], m["c"]).alias("scale"), F.degrees(F.atan2(m["c"], m["a"])).alias("degrees"))


def rigid_prefix(df: DataFrame, key: str, order: str, angle: str, dx: str, dy: str) -> DataFrame:
    """Running product of rigid steps as running sums: the angle adds up, and each step's shift is turned by the sum
    of the angles before it. Adds theta, x, y."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(angle).over(w) - F.col(angle)
    return df.withColumn("_before", before).withColumns({
        "theta": F.col("_before") + F.col(angle),
        "x": F.sum(F.cos("_before") * F.col(dx) - F.sin("_before") * F.col(dy)).over(w),
        "y": F.sum(F.sin("_before") * F.col(dx) + F.cos("_before") * F.col(dy)).over(w),
    }).drop("_before")


def kabsch(df: DataFrame, keys: list[str], x: str, y: str, u: str, v: str) -> DataFrame:
    """Least-squares rotation and shift of (x, y) onto (u, v) per group, in closed form from sums: one aggregation."""
    n, s = F.count(F.lit(1)), lambda c: F.sum(c)
    X, Y, U, V = (F.col(c) for c in (x, y, u, v))
    sums = df.groupBy(*keys).agg(n.alias("n"), s(X).alias("x"), s(Y).alias("y"), s(U).alias("u"), s(V).alias("v"), s(X * V - Y * U).alias("cross"), s(X * U + Y * V).alias("dot"))
    mean = {c: F.col(c) / F.col("n") for c in "xyuv"}
    cross = F.col("cross") - F.col("n") * (mean["x"] * mean["v"] - mean["y"] * mean["u"])
    dot = F.col("dot") - F.col("n") * (mean["x"] * mean["u"] + mean["y"] * mean["v"])
    theta = F.atan2(cross, dot)
    return sums.select(*keys, "n", theta.alias("theta"), (mean["u"] - (F.cos(theta) * mean["x"] - F.sin(theta) * mean["y"])).alias("tx"), (mean["v"] - (F.sin(theta) * mean["x"] + F.cos(theta) * mean["y"])).alias("ty"))


#: Seed of the drawn pairs, pairs drawn, pixels within which a point agrees, and the least points to agree.
RANSAC_SEED, RANSAC_PAIRS, RANSAC_WITHIN, RANSAC_LEAST = 0xB0D1, 200, 3.0, 8


def ransac_rigid(rows: pd.DataFrame, pairs: int = RANSAC_PAIRS, within: float = RANSAC_WITHIN, least: int = RANSAC_LEAST, seed: int = RANSAC_SEED) -> pd.DataFrame:
    """Rigid map of (x, y) onto (u, v) that most points agree with, closer than `within`, refitted to those; null where
    fewer than `least` points are given or agree. Pairs of equal points tell no angle and are passed over. A group is
    the matched points of one pair of frames, some hundreds, and is tried with all drawn pairs at once."""
    z, w = (rows[a].to_numpy(float) + 1j * rows[b].to_numpy(float) for a, b in (("x", "y"), ("u", "v")))
    out = {"session": [rows["session"].iloc[0]], "inliers": [0], "theta": [np.nan], "tx": [np.nan], "ty": [np.nan]}
    if len(z) < least:
        return pd.DataFrame(out)
    rng = np.random.default_rng(seed)
    first, second = np.array([rng.choice(len(z), 2, replace=False) for _ in range(pairs)]).T
    turn = np.conj(z[second] - z[first]) * (w[second] - w[first])
    usable = (np.abs(z[second] - z[first]) > 1e-6) & (np.abs(w[second] - w[first]) > 1e-6)
    turn = np.where(usable, turn / np.where(usable, np.abs(turn), 1), np.nan)
    shift = (w[first] + w[second]) / 2 - turn * (z[first] + z[second]) / 2
    agree = np.abs(turn[:, None] * z + shift[:, None] - w) < within
    best = agree[int(agree.sum(1).argmax())]
    out["inliers"] = [int(best.sum())]
    if best.sum() >= least:
        a, b = z[best], w[best]
        theta = np.angle((np.conj(a - a.mean()) * (b - b.mean())).sum())
        move = b.mean() - np.exp(1j * theta) * a.mean()
        out |= {"theta": [theta], "tx": [move.real], "ty": [move.imag]}
    return pd.DataFrame(out)


def principal_axis(df: DataFrame, keys: list[str], x: str, y: str, more: dict[str, Column] | None = None) -> DataFrame:
    """Centroid, larger and smaller standard deviation along the principal axes, and the larger one's angle. more:
    further aggregates of the same groups by name."""
    more = more or {}
    moments = df.groupBy(*keys).agg(*(v.alias(k) for k, v in more.items()), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("_xx"), F.var_samp(y).alias("_yy"), F.covar_samp(x, y).alias("_xy"))
    mid, half = (F.col("_xx") + F.col("_yy")) / 2, F.sqrt(((F.col("_xx") - F.col("_yy")) / 2) ** 2 + F.col("_xy") ** 2)
    return moments.select(*keys, "cx", "cy", F.sqrt(mid + half).alias("axis_len"), F.sqrt(F.greatest(mid - half, F.lit(0.0))).alias("minor_len"), (F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy")) / 2).alias("angle"), *more)


def density_grid(df: DataFrame, keys: list[str], gx: Column, gy: Column, kernel: list[float]) -> DataFrame:
    """Counts on a grid, blurred by a separable kernel: one spread of the cells for each axis and a sum."""
    r = len(kernel) // 2
    steps = F.array(*(F.struct(F.lit(k - r).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(kernel)))
    cells = df.groupBy(*keys, gx.alias("gx"), gy.alias("gy")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    for axis in ("gx", "gy"):
        spread = cells.withColumn("_s", F.explode(steps)).withColumn(axis, F.col(axis) + F.col("_s.d")).withColumn("n", F.col("n") * F.col("_s.w"))
        cells = spread.groupBy(*keys, "gx", "gy").agg(F.sum("n").alias("n"))
    return cells


def greedy_pair(df: DataFrame, keys: list[str], detections: str, my: Column, op: Column, least: float, strict: bool = True, floor: float = 0.0) -> DataFrame:
    """Best detection for `my` by IoU, then for `op` among the others; the first of equal ones. Detections are an
    array of boxes of the row, so nothing is joined. Adds my_pick and op_pick (0-based, null without one)."""

    def best(box: Column, other: Column) -> Column:
        scored = F.transform(F.col(detections), lambda d, j: F.struct(F.when(j == other, F.lit(-1.0)).otherwise(iou(box, d, floor)).alias("iou"), (-j).alias("j")))
        top = F.array_max(scored)
        return F.when((top["iou"] > least) if strict else (top["iou"] >= least), -top["j"])

    return df.withColumn("my_pick", best(my, F.lit(-1))).withColumn("op_pick", best(op, F.coalesce(F.col("my_pick"), F.lit(-1))))


def nearest_box(boxes: Column, x: Column, y: Column) -> Column:
    """0-based place of the box whose centre is nearest; the first of equally near."""
    scored = F.transform(boxes, lambda b, j: F.struct(((b[0] + b[2]) / 2 - x) ** 2 + ((b[1] + b[3]) / 2 - y) ** 2, j.alias("j")))
    return F.array_min(scored)["j"]


def bhattacharyya(p: Column, q: Column) -> Column:
    """1 - Bhattacharyya distance of two histograms."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    overlap = F.aggregate(F.zip_with(p, q, lambda a, b: F.sqrt(a * b)), F.lit(0.0), lambda a, x: a + x)
    return 1 - F.sqrt(F.greatest(1 - F.try_divide(overlap, F.sqrt(total(p) * total(q))), F.lit(0.0)))


def correlation(p: Column, q: Column) -> Column:
    """Pearson correlation of two arrays."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    n, sp, sq = F.size(p), total(p), total(q)
    cov = total(F.zip_with(p, q, lambda a, b: a * b)) - sp * sq / n
    var = lambda h, s: total(F.transform(h, lambda x: x * x)) - s * s / n
    return F.try_divide(cov, F.sqrt(var(p, sp) * var(q, sq)))
