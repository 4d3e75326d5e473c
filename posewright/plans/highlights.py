"""Which seconds of a session make its highlights, and where the two stood, as a blurred map of cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posewright.fixtures import SIGNALS_SQL, signals
from posewright.functions import columns as c
from posewright.plans import perception_queries

# fixed values: seconds of a reel, of its longest scene, the shares of a session that open and close it
REEL, PEAK, OPENING, CLOSING = 20, 12, 0.40, 0.60
QUICK = (REEL - PEAK) // 2
# fixed values: cells of the map and of its blur, whose width follows the number of cells by the usual rule
CELLS, BLUR = 400, 31
SIGMA = 0.3 * ((BLUR - 1) * 0.5 - 1) + 0.8


def moved_per_second(frames: DataFrame, fps: float) -> DataFrame:
    """(session, sec, n_secs, moved): how far both centres went within each whole second. frames: (session, fi, p_bbox,
    p_coast); where a box is only predicted, the next seen one is held against the last seen one of the same second."""
    fps_int = max(1, round(fps))
    f = frames.withColumn("n_secs", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy("session")) / fps_int)).cast("int")).withColumn("sec", F.floor(F.col("fi") / fps_int).cast("int"))
    held = Window.partitionBy("session", "sec").orderBy("fi").rowsBetween(Window.unboundedPreceding, -1)
    steps = {}
    for p in ("my", "op"):
        seen = F.col(f"{p}_coast") == 0
        at = F.when(seen, F.struct(c.box_centre(F.col(f"{p}_bbox"), 0).alias("x"), c.box_centre(F.col(f"{p}_bbox"), 1).alias("y")))
        last = F.last(at, ignorenulls=True).over(held)
        steps[f"_{p}"] = F.when(seen, F.coalesce(c.distance(at["x"], at["y"], last["x"], last["y"]), F.lit(0.0))).otherwise(0.0)
    f = f.withColumns(steps).where("sec < n_secs")
    return f.groupBy("session", "sec", "n_secs").agg(F.round(F.sum(F.col("_my") + F.col("_op")), 6).alias("moved"))


def reel(seconds: DataFrame) -> DataFrame:
    """(session, place, sec, part): the seconds of a reel in order: the best of the opening, the best scene of PEAK
    seconds, the best of the closing; a session of up to REEL seconds stays whole."""
    own = Window.partitionBy("session")
    ahead = own.orderBy("sec").rowsBetween(0, PEAK - 1)
    scene = seconds.withColumns({"_s": F.sum("moved").over(ahead), "_n": F.count(F.lit(1)).over(ahead)}).where((F.col("_n") == PEAK) & (F.col("n_secs") > REEL))
    best = scene.groupBy("session").agg(F.min_by("sec", F.struct(-F.round("_s", 6), F.col("sec"))).alias("_begin"))
    f = seconds.join(best, "session", "left")
    inside = F.col("sec").between(F.col("_begin"), F.col("_begin") + PEAK - 1)
    opens = F.col("sec") < F.greatest(F.lit(1), F.floor(F.col("n_secs") * OPENING))
    closes = F.col("sec") >= F.floor(F.col("n_secs") * CLOSING)
    part = F.when(F.col("n_secs") <= REEL, "whole").when(inside, "peak").when(opens, "opening").when(closes, "closing")
    ranked = f.withColumn("part", part).where("part is not null").withColumn("_r", F.row_number().over(Window.partitionBy("session", "part").orderBy(F.desc("moved"), "sec")))
    kept = ranked.where(F.col("part").isin("whole", "peak") | (F.col("_r") <= QUICK))
    order = F.when(F.col("part") == "opening", 0).when(F.col("part") == "closing", 2).otherwise(1)
    return kept.withColumn("place", F.row_number().over(own.orderBy(order, "sec")) - 1).select("session", "place", "sec", "part")


def kernel() -> list[float]:
    raw = [math.exp(-((k - BLUR // 2) ** 2) / (2 * SIGMA**2)) for k in range(BLUR)]
    return [x / sum(raw) for x in raw]


def blurred(cells: DataFrame, keys: list[str], size: int = CELLS) -> DataFrame:
    """Counts (keys, gx, gy, n) on a square map, blurred along both axes with the map mirrored at its borders, as shares
    of each map's greatest cell. A count goes to BLUR cells of a row and then of a column, and meets others there."""
    half = BLUR // 2
    weights = F.array(*(F.struct(F.lit(k - half).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(kernel())))
    for axis in ("gx", "gy"):
        at = F.col(axis)
        images = F.filter(F.array(at, F.when(at.between(1, half), -at), F.when(at.between(size - 1 - half, size - 2), 2 * (size - 1) - at)), lambda x: x.isNotNull())
        spread = cells.withColumn("_at", F.explode(images)).withColumn("_w", F.explode(weights)).withColumn(axis, (F.col("_at") + F.col("_w.d")).cast("int"))
        cells = spread.where(F.col(axis).between(0, size - 1)).groupBy(*keys, "gx", "gy").agg(F.sum(F.col("n") * F.col("_w.w")).alias("n"))
    return cells.withColumn("heat", F.col("n") / F.max("n").over(Window.partitionBy(*keys))).drop("n")


def coasting(spark, d) -> DataFrame:
    """The signals view as boxes, some only predicted."""
    v = F.col("v")
    box = lambda x, y: F.array(x, y, x + 100, y + 200)
    return signals(spark, d).select("session", "fi", box(5 * v, 3 * v).alias("my_bbox"), box(700 - 2 * v, 4 * v).alias("op_bbox"), (F.col("kind") == "error").cast("int").alias("my_coast"), (F.col("kind") == "view").cast("int").alias("op_coast"))


def highlight_reel(spark, d) -> DataFrame:
    return reel(moved_per_second(coasting(spark, d), 3.0))


def heatmap(spark, d) -> DataFrame:
    """The hot area of both: cells of at least half the greatest heat."""
    return blurred(perception_queries.heat_cells(spark, d), ["session", "side"]).where(F.round("heat", 9) >= 0.5).select("session", "side", "gx", "gy", F.round("heat", 6).alias("heat"))


QUERIES = {f.__name__: f for f in (highlight_reel, heatmap)}

_STEPS = lambda x, y, hidden: f"SELECT session, sec, sqrt(({x} - lag({x}) OVER w) ** 2 + ({y} - lag({y}) OVER w) ** 2) AS step FROM aa WHERE kind <> '{hidden}' WINDOW w AS (PARTITION BY session, sec ORDER BY fi)"
_MOVED = f"""aa AS (SELECT *, CAST(fi // 3 AS INTEGER) AS sec FROM sig), ns AS (SELECT session, CAST(greatest(1, count(*) // 3) AS INTEGER) AS n_secs FROM sig GROUP BY session),
  mv AS (SELECT s.session, s.sec, n_secs, round(coalesce(sum(step), 0), 6) AS moved FROM (SELECT DISTINCT session, sec FROM aa) s JOIN ns ON ns.session = s.session AND s.sec < n_secs LEFT JOIN ({_STEPS("5 * v", "3 * v", "error")} UNION ALL {_STEPS("-2 * v", "4 * v", "view")}) m ON m.session = s.session AND m.sec = s.sec GROUP BY ALL)"""
_REEL = f"""sc AS (SELECT session, sec, round(sum(moved) OVER w, 6) AS s, count(*) OVER w AS n, n_secs FROM mv WINDOW w AS (PARTITION BY session ORDER BY sec ROWS BETWEEN CURRENT ROW AND {PEAK - 1} FOLLOWING)),
  be AS (SELECT session, arg_min(sec, [-s, sec]) AS b FROM sc WHERE n = {PEAK} AND n_secs > {REEL} GROUP BY session),
  pt AS (SELECT n.*, CASE WHEN n_secs <= {REEL} THEN 'whole' WHEN sec BETWEEN b AND b + {PEAK - 1} THEN 'peak' WHEN sec < greatest(1, floor(n_secs * {OPENING}::DOUBLE)) THEN 'opening' WHEN sec >= floor(n_secs * {CLOSING}::DOUBLE) THEN 'closing' END AS part FROM mv n LEFT JOIN be USING (session)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY session, part ORDER BY moved DESC, sec) AS r FROM pt WHERE part IS NOT NULL)
  SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY CASE part WHEN 'opening' THEN 0 WHEN 'closing' THEN 2 ELSE 1 END, sec) - 1 AS INTEGER) AS place, sec, part FROM rk WHERE part IN ('whole', 'peak') OR r <= {QUICK}"""
_HEAT_CELLS = perception_queries.ORACLES["heat_cells"]
_HALF = BLUR // 2
_BLURRED = lambda axis, other, rows: f"""SELECT session, side, {other}, i AS {axis}, sum(n * w) AS n FROM (
    SELECT session, side, {other}, unnest([{axis}] || CASE WHEN {axis} BETWEEN 1 AND {_HALF} THEN [-{axis}] ELSE [] END || CASE WHEN {axis} BETWEEN {CELLS - 1 - _HALF} AND {CELLS - 2} THEN [{2 * (CELLS - 1)} - {axis}] ELSE [] END) AS a, n FROM {rows}) c
    JOIN ker ON true JOIN range({CELLS}) r(i) ON i = a + d GROUP BY ALL"""  # noqa: E731
ORACLES = {
    "highlight_reel": "WITH " + ", ".join([SIGNALS_SQL, _MOVED, _REEL]),
    "heatmap": f"""WITH ker AS (SELECT d, w / sum(w) OVER () AS w FROM (SELECT d, exp(-(d * d) / {2 * SIGMA**2}::DOUBLE) AS w FROM range(-{_HALF}, {_HALF + 1}) t(d))),
      one AS ({_BLURRED("gx", "gy", f"({_HEAT_CELLS})")}), two AS ({_BLURRED("gy", "gx", "one")})
      SELECT session, side, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, round(heat, 6) AS heat FROM (SELECT *, n / max(n) OVER (PARTITION BY session, side) AS heat FROM two) WHERE round(heat, 9) >= 0.5""",
}
