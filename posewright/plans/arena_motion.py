"""The arena of a session whose camera moves: maps between frames chained to one reference frame, and feet on the floor.

A step maps a frame's points to the next frame's; null where the motion could not be told, which counts as none. The
chain is a scan by blocks (operators/scans.py), so a session is no single array; its reference frame is near the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewright.config import DEFAULT, Config
from posewright.fixtures import POSES_SQL, SIGNALS_SQL, poses, signals
from posewright.functions import columns as c
from posewright.operators import geometry, scans
from posewright.operators.geometry import AFFINE
from posewright.plans.arena_metrics import with_feet

#: Fixed value: the reference frame's place in the session.
ANCHOR = 0.95
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def affine(*numbers: Column) -> Column:
    return F.struct(*(x.cast("double").alias(n) for n, x in zip(AFFINE, numbers)))


def to_first(steps: DataFrame, **sizes: int) -> DataFrame:
    """(session, fi, warp, failed): each frame's map to the first frame. steps: (session, fi, step)."""
    none = affine(*map(F.lit, IDENTITY))
    back = F.when((F.col("fi") == 0) | F.col("step").isNull(), none).otherwise(geometry.invert(F.col("step")))
    rows = steps.select("session", "fi", F.coalesce(back, none).alias("warp"), ((F.col("fi") > 0) & F.col("step").isNull()).alias("failed"))
    return scans.block_scan(rows, ["session"], "fi", "warp", geometry.compose, **sizes)


def anchored(warps: DataFrame, anchor: float = ANCHOR) -> DataFrame:
    """The maps with another reference frame: all composed with the inverse of that frame's own. Adds ref_index."""
    n = F.count(F.lit(1))
    places = warps.groupBy("session").agg(F.least(n - 1, F.floor(n * anchor)).cast("int").alias("fi"))
    refs = warps.select("session", "fi", "warp").join(places, ["session", "fi"]).select("session", F.col("fi").alias("ref_index"), geometry.invert(F.col("warp")).alias("_back"))
    return warps.join(refs, "session").withColumn("warp", geometry.compose(F.col("_back"), F.col("warp"))).drop("_back")


def arena_on_floor(frames: DataFrame, warps: DataFrame, edge: float | None = None, config: Config = DEFAULT) -> DataFrame:
    """One row a session: centre and axes of all foot points in the reference frame (null and 0 below three), their
    number, the median scales, and the shares of frames in which feet are seen. One aggregation of the mapped points."""
    f = with_feet(frames.join(warps, ["session", "fi"]), edge, config)
    none = F.lit(None).cast("double")
    mapped = lambda q: F.struct(*(v.alias(n) for n, v in zip("xy", geometry.applied(F.col("warp"), q["x"], q["y"]))))
    row = lambda **given: F.struct(*(given.get(n, none).alias(n) for n in ("x", "y", "my_size", "op_size", "my", "op", "failed")))
    size = lambda p: F.nullif(c.frame_scale(F.col(f"{p}_kps"), F.col(f"{p}_bbox"), config), F.lit(0.0))
    seen = lambda p: (F.size(f"{p}_feet") > 0).cast("double")
    points = F.transform(F.transform(F.concat("my_feet", "op_feet"), mapped), lambda q: row(x=q["x"], y=q["y"]))
    frame = row(my_size=size("my"), op_size=size("op"), my=seen("my"), op=seen("op"), failed=F.col("failed").cast("double"))
    both = F.flatten(F.array(points, F.array(frame)))
    rows = f.select("session", "ref_index", F.inline(both))
    sizes = rows.where("my is not null").select("session", F.explode(F.array("my_size", "op_size")).alias("size")).groupBy("session").agg(F.coalesce(F.median("size"), F.lit(0.0)).alias("scale"))
    more = {"n_foot_points": F.count("x"), "my_scale": F.coalesce(F.median("my_size"), F.lit(0.0)), "op_scale": F.coalesce(F.median("op_size"), F.lit(0.0)), "my_seen": F.avg("my"), "op_seen": F.avg("op"), "seen": F.avg(F.greatest("my", "op")), "motion_failures": F.sum("failed").cast("long")}
    axis = geometry.principal_axis(rows, ["session", "ref_index"], "x", "y", more).join(sizes, "session")
    known = lambda n, other: F.when(F.col("n_foot_points") >= 3, F.col(n)).otherwise(other).alias(n)
    axis = axis.select("session", "ref_index", "motion_failures", "n_foot_points", known("cx", None), known("cy", None), known("axis_len", 0.0), known("minor_len", 0.0), "scale", "my_scale", "op_scale", "seen", "my_seen", "op_seen")
    return axis.withColumn("span", F.coalesce(F.try_divide(2 * F.col("axis_len"), F.col("scale")), F.lit(0.0))).withColumn("tier", c.tier(F.col("seen")))


def detect_arena(frames: DataFrame, steps: DataFrame, edge: float | None = None, config: Config = DEFAULT) -> DataFrame:
    return arena_on_floor(frames, anchored(to_first(steps)), edge, config)


def refresh_arena(frames: DataFrame, warps: DataFrame, edge: float | None = None, config: Config = DEFAULT) -> DataFrame:
    """The arena anew from maps to any reference frame that an earlier run has stored; no step is told again."""
    return arena_on_floor(frames, anchored(warps.drop("ref_index")), edge, config)


def signal_steps(spark, d) -> DataFrame:
    """Steps with shear and scale from the signals view; none where an event is an error."""
    v = F.col("v")
    m = affine(1 + (v - 50) / 2000, (v - 40) / 3000, v / 100, (60 - v) / 2500, 1 + (45 - v) / 2600, F.when(F.col("side") == "my", 0.5).otherwise(-0.5))
    return signals(spark, d).select("session", "fi", F.when(F.col("kind") != "error", m).alias("step"))


def pose_steps(frames: DataFrame) -> DataFrame:
    """Steps from my box in the poses view; none where little of the pose is seen."""
    x1, y1, x2, y2 = (F.get("my_bbox", k) for k in range(4))
    m = affine(1 + 0.05 * (x1 - 0.3), 0.04 * (y1 - 0.2), 0.1 * (x2 - 0.7), -0.03 * (y2 - 0.9), 1 + 0.02 * (x2 - 0.6), 0.05 * (y1 - 0.1))
    return frames.select("session", "fi", F.when(c.visibility(F.col("my_kps")) >= 0.5, m).alias("step"))


def rounded(df: DataFrame, *kept: str) -> DataFrame:
    return df.select(*(F.round(n, 6).alias(n) if t == "double" and n not in kept else n for n, t in df.dtypes))


def warp_prefix_affine(spark, d) -> DataFrame:
    out = anchored(to_first(signal_steps(spark, d)))
    return out.select("session", "fi", "ref_index", "failed", *(F.round(F.col("warp")[n], 6).alias(n) for n in AFFINE))


def arena_detect(spark, d) -> DataFrame:
    frames = poses(spark, d)
    return rounded(detect_arena(frames, pose_steps(frames)))


def arena_refresh(spark, d) -> DataFrame:
    """From maps to the first frame, as a store may hold them."""
    frames = poses(spark, d)
    return rounded(refresh_arena(frames, to_first(pose_steps(frames))).select("session", "ref_index", "n_foot_points", "cx", "cy", "axis_len", "minor_len", "span"))


QUERIES = {f.__name__: f for f in (warp_prefix_affine, arena_detect, arena_refresh)}


def _compose(m: str, n: str) -> str:
    m, n = ({k: f"{p}{k}" for k in AFFINE} for p in (m, n))
    return ", ".join(f"{m[x]} * {n[y]} + {m[z]} * {n[w]}" + (f" + {m[t]}" if t else "") + f" AS {k}" for k, (x, y, z, w, t) in {
        "a": ("a", "a", "b", "c", ""), "b": ("a", "b", "b", "d", ""), "tx": ("a", "tx", "b", "ty", "tx"), "c": ("c", "a", "d", "c", ""), "d": ("c", "b", "d", "d", ""), "ty": ("c", "tx", "d", "ty", "ty")}.items())


def _invert(p: str, out: str = "") -> str:
    det = f"({p}a * {p}d - {p}b * {p}c)"
    return f"{p}d / {det} AS {out}a, -{p}b / {det} AS {out}b, ({p}b * {p}ty - {p}d * {p}tx) / {det} AS {out}tx, -{p}c / {det} AS {out}c, {p}a / {det} AS {out}d, ({p}c * {p}tx - {p}a * {p}ty) / {det} AS {out}ty"


def _warps(steps: str) -> str:
    """walk: maps to the first frame; warp: to the reference frame. steps: a select of session, fi, ok and the numbers."""
    none = ", ".join(f"{x}::DOUBLE AS {k}" for k, x in zip(AFFINE, IDENTITY))
    return f"""steps AS ({steps}), back AS (SELECT session, fi, NOT ok AS failed, {_invert('s.')} FROM steps s WHERE ok AND fi > 0 UNION ALL SELECT session, fi, NOT ok AND fi > 0 AS failed, {none} FROM steps WHERE NOT ok OR fi = 0),
  walk AS (SELECT session, fi, failed, {', '.join(AFFINE)} FROM back WHERE fi = 0 UNION ALL SELECT s.session, s.fi, s.failed, {_compose('w.', 's.')} FROM walk w JOIN back s ON s.session = w.session AND s.fi = w.fi + 1),
  ref AS (SELECT session, ref_index, {_invert('w.')} FROM walk w JOIN (SELECT session AS s, CAST(least(count(*) - 1, floor(count(*) * {ANCHOR}::DOUBLE)) AS INTEGER) AS ref_index FROM walk GROUP BY session) ON s = session AND ref_index = fi),
  warp AS (SELECT w.session, w.fi, w.failed, r.ref_index, {_compose('r.', 'w.')} FROM walk w JOIN ref r ON r.session = w.session)"""


_POSE_WARPS = _warps("""SELECT session, fi, vis >= 0.5 AS ok, 1 + 0.05::DOUBLE * (x1 - 0.3::DOUBLE) AS a, 0.04::DOUBLE * (y1 - 0.2::DOUBLE) AS b, 0.1::DOUBLE * (x2 - 0.7::DOUBLE) AS tx, -0.03::DOUBLE * (y2 - 0.9::DOUBLE) AS c, 1 + 0.02::DOUBLE * (x2 - 0.6::DOUBLE) AS d, 0.05::DOUBLE * (y1 - 0.1::DOUBLE) AS ty FROM torso WHERE side = 'my'""")
_FLOOR = """pts AS (SELECT session, fi, side, x, y FROM kp WHERE i IN (15, 16) AND c > 0.3::DOUBLE UNION ALL SELECT session, fi, side, (x1 + x2) * 0.5::DOUBLE, y2 FROM pose WHERE (y2 - y1) / (x2 - x1) >= 0.7::DOUBLE),
  flat AS (SELECT w.session, a * x + b * y + tx AS px, c * x + d * y + ty AS py FROM pts JOIN warp w USING (session, fi)),
  ax AS (SELECT session, count(*) AS n, avg(px) AS cx, avg(py) AS cy, (var_samp(px) + var_samp(py)) / 2 AS mid, sqrt(((var_samp(px) - var_samp(py)) / 2) ** 2 + covar_samp(px, py) ** 2) AS half FROM flat GROUP BY session),
  axis AS (SELECT session, n, CASE WHEN n >= 3 THEN cx END AS cx, CASE WHEN n >= 3 THEN cy END AS cy, CASE WHEN n >= 3 THEN sqrt(mid + half) ELSE 0 END AS axis_len, CASE WHEN n >= 3 THEN sqrt(greatest(mid - half, 0)) ELSE 0 END AS minor_len FROM ax),
  sz AS (SELECT session, side, nullif(coalesce(greatest(2.2::DOUBLE * th, CASE WHEN hcx IS NULL THEN 2.6::DOUBLE * sqrt((kx5 - kx6) ** 2 + (ky5 - ky6) ** 2) END, CASE WHEN (y2 - y1) / (x2 - x1) >= 0.7::DOUBLE THEN y2 - y1 END), 0), 0) AS s FROM torso),
  med AS (SELECT session, coalesce(median(s), 0) AS scale, coalesce(median(s) FILTER (WHERE side = 'my'), 0) AS my_scale, coalesce(median(s) FILTER (WHERE side = 'op'), 0) AS op_scale FROM sz GROUP BY session),
  vis AS (SELECT session, max(ref_index) AS ref_index, count(*) FILTER (WHERE failed) AS motion_failures, avg(CASE WHEN m > 0 OR o > 0 THEN 1.0::DOUBLE ELSE 0 END) AS seen, avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0 END) AS my_seen, avg(CASE WHEN o > 0 THEN 1.0::DOUBLE ELSE 0 END) AS op_seen FROM (
    SELECT w.session, w.fi, any_value(ref_index) AS ref_index, any_value(failed) AS failed, count(*) FILTER (WHERE side = 'my') AS m, count(*) FILTER (WHERE side = 'op') AS o FROM warp w LEFT JOIN pts USING (session, fi) GROUP BY ALL) GROUP BY session)"""
_POSES = "WITH RECURSIVE " + ", ".join([POSES_SQL, _POSE_WARPS, _FLOOR])
_AXIS = "coalesce(n, 0) AS n_foot_points, round(cx, 6) AS cx, round(cy, 6) AS cy, round(coalesce(axis_len, 0), 6) AS axis_len, round(coalesce(minor_len, 0), 6) AS minor_len, round(CASE WHEN scale > 0 THEN 2 * coalesce(axis_len, 0) / scale ELSE 0 END, 6) AS span"
ORACLES = {
    "warp_prefix_affine": f"WITH RECURSIVE {SIGNALS_SQL}, " + _warps("""SELECT session, fi, kind <> 'error' AS ok, 1 + (v - 50) / 2000 AS a, (v - 40) / 3000 AS b, v / 100 AS tx, (60 - v) / 2500 AS c, 1 + (45 - v) / 2600 AS d, CASE WHEN side = 'my' THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS ty FROM sig""")
    + " SELECT session, fi, ref_index, failed, " + ", ".join(f"round({n}, 6) AS {n}" for n in AFFINE) + " FROM warp",
    "arena_detect": _POSES + " SELECT session, ref_index, motion_failures, " + _AXIS + ", " + ", ".join(f"round({n}, 6) AS {n}" for n in ("scale", "my_scale", "op_scale", "seen", "my_seen", "op_seen"))
    + ", CASE WHEN seen >= 0.75::DOUBLE THEN 'high' WHEN seen >= 0.4::DOUBLE THEN 'medium' WHEN seen >= 0.15::DOUBLE THEN 'low' ELSE 'none' END AS tier FROM vis LEFT JOIN axis USING (session) JOIN med USING (session)",
    "arena_refresh": _POSES + f" SELECT session, ref_index, {_AXIS} FROM vis LEFT JOIN axis USING (session) JOIN med USING (session)",
}
