"""Queries over the poses view, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posewright.fixtures import POSES_SQL, poses, read
from posewright.functions import columns as c
from posewright.operators import folds, geometry
from posewright.operators.relations import seed_frame, top_then_sideways
from posewright.plans import arena_metrics, pose_frames

r6 = lambda x, n: F.round(x, 6).alias(n)


def long(frames: DataFrame, **parts) -> DataFrame:
    """Both sides' columns as rows: parts maps a name to a function of the side."""
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("side"), *(f(p).alias(n) for n, f in parts.items())) for p in ("my", "op"))))
    return frames.select("session", "fi", rows.alias("r")).select("session", "fi", "r.*")


def moving(spark, d) -> DataFrame:
    return pose_frames.motions(pose_frames.bodies(poses(spark, d)))


def present(df: DataFrame) -> DataFrame:
    return df.where("present").drop("present")


def has(p):
    return F.col(f"{p}_kps").isNotNull()


def kp_visibility(spark, d) -> DataFrame:
    return present(long(poses(spark, d), vis=lambda p: F.round(c.visibility(F.col(f"{p}_kps")), 6), present=has))


def visibility_tier(spark, d) -> DataFrame:
    seen = present(long(poses(spark, d), s=lambda p: c.shoulder_centre(F.col(f"{p}_kps"), 0).isNotNull(), present=has))
    share = seen.groupBy("session", "side").agg(F.round(F.count_if("s") / F.count(F.lit(1)), 6).alias("visibility"))
    return share.withColumn("tier", c.tier(F.col("visibility")))


def state_classify(spark, d) -> DataFrame:
    f = arena_metrics.tracks_of(pose_frames.bodies(poses(spark, d)))
    f = pose_frames.states(f, c.distance(F.col("my_x"), F.col("my_y"), F.col("op_x"), F.col("op_y")))
    return f.groupBy("session", "state").agg(F.count(F.lit(1)).alias("n_frames"))


def punch_score(spark, d) -> DataFrame:
    return present(long(moving(spark, d), score=lambda p: F.round(f"{p}_score", 6), punching=lambda p: F.col(f"{p}_punching"), present=has))


def wrist_activity(spark, d) -> DataFrame:
    return present(long(moving(spark, d), wrist=lambda p: F.round(f"{p}_wrist", 6), head_move=lambda p: F.round(f"{p}_head_move", 6), push=lambda p: F.round(f"{p}_push", 6), present=has))


def guard_frame(spark, d) -> DataFrame:
    return present(long(moving(spark, d), guard=lambda p: F.round(f"{p}_guard", 6), present=has))


def _zone(spark, d, zone) -> DataFrame:
    z = present(long(poses(spark, d), z=zone, present=has))
    return z.select("session", "fi", "side", *(r6(F.get("z", k), n) for k, n in enumerate(("zx1", "zy1", "zx2", "zy2"))))


def head_zone(spark, d) -> DataFrame:
    return _zone(spark, d, lambda p: c.head_zone(F.col(f"{p}_kps"), F.col(f"{p}_bbox"), 16 / 9))


def stomach_zone(spark, d) -> DataFrame:
    return _zone(spark, d, lambda p: c.stomach_zone(F.col(f"{p}_kps"), 16 / 9))


def frame_scale(spark, d) -> DataFrame:
    return present(long(poses(spark, d), scale=lambda p: F.round(c.frame_scale(F.col(f"{p}_kps"), F.col(f"{p}_bbox")), 6), present=has))


def foot_points(spark, d) -> DataFrame:
    """Number and mean of each side's foot points."""
    points = present(long(poses(spark, d), q=lambda p: c.foot_points(F.col(f"{p}_kps"), F.col(f"{p}_bbox")), present=has))
    return points.select("session", "fi", "side", F.size("q").cast("long").alias("n"), r6(c.mean_of(F.col("q"), "x"), "mx"), r6(c.mean_of(F.col("q"), "y"), "my"))


def verdict_tally(spark, d) -> DataFrame:
    """Every frame of both sides judged as if it were a punch."""
    f = pose_frames.with_verdicts(moving(spark, d))
    judged = present(long(f, verdict=lambda p: F.col(f"{p}_verdict"), present=lambda p: F.col("my_kps").isNotNull() & F.col("op_kps").isNotNull()))
    return arena_metrics.tally(judged)


def closing_speed_split(spark, d) -> DataFrame:
    arena = poses(spark, d).select("session").distinct().selectExpr("session", "0.5D as centre_x", "0.9D as centre_y", "0.8D as scale", "'high' as tier")
    f = arena_metrics.signals(poses(spark, d), arena)
    return f.select("session", "fi", r6(F.col("my_closing"), "my_closing"), r6(F.col("op_closing"), "op_closing"), r6(F.col("my_path"), "my_path"), r6(F.col("op_path"), "op_path"))


def centroid_principal_axis(spark, d) -> DataFrame:
    points = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    axis = geometry.principal_axis(points, ["session"], "x", "y")
    return axis.select("session", *(F.round(n, 5).alias(n) for n in ("cx", "cy", "axis_len", "minor_len", "angle")))


def density_grid(spark, d) -> DataFrame:
    """Foot points on a 20-cell grid, blurred by a binomial kernel."""
    feet = present(long(poses(spark, d), x=lambda p: c.box_centre(F.col(f"{p}_bbox"), 0), y=lambda p: F.get(f"{p}_bbox", 3), present=has))
    return geometry.density_grid(feet, ["session"], F.floor(F.col("x") * 20), F.floor(F.col("y") * 20), [0.0625, 0.25, 0.375, 0.25, 0.0625]).withColumn("n", F.round("n", 6))


def depth_cell_grid(spark, d) -> DataFrame:
    """Cells by place and by the box's height as a stand-in for depth."""
    cells = present(long(poses(spark, d), gx=lambda p: F.floor(F.least(F.greatest(c.box_centre(F.col(f"{p}_bbox"), 0), F.lit(0.0)), F.lit(0.999)) * 24), gy=lambda p: F.floor(F.least(F.greatest(F.expr(f"get({p}_bbox, 3) - get({p}_bbox, 1)"), F.lit(0.0)), F.lit(0.999)) * 16), present=has))
    return cells.groupBy("session", "side", "gx", "gy").agg(F.count(F.lit(1)).alias("n"))


def _detections(spark, d) -> DataFrame:
    """Frames with an array of detections: both boxes moved a little, and one between them."""
    f = poses(spark, d).where("op_bbox is not null and my_bbox is not null")
    moved = lambda b, by: F.transform(b, lambda x: x + by)
    return f.withColumn("dets", F.array(moved("op_bbox", 0.03), F.zip_with("my_bbox", "op_bbox", lambda a, b: (a + b) / 2), moved("my_bbox", -0.02)))


def greedy_iou_assign(spark, d) -> DataFrame:
    return geometry.greedy_pair(_detections(spark, d), ["session", "fi"], "dets", F.col("my_bbox"), F.col("op_bbox"), 0.15).select("session", "fi", "my_pick", "op_pick")


def nearest_box(spark, d) -> DataFrame:
    return _detections(spark, d).select("session", "fi", geometry.nearest_box(F.col("dets"), F.lit(0.5), F.lit(0.5)).alias("pick"))


def topk_sideways(spark, d) -> DataFrame:
    """The four largest boxes of a session, from left to right."""
    boxes = present(long(poses(spark, d), area=lambda p: F.round(F.expr(f"(get({p}_bbox, 2) - get({p}_bbox, 0)) * (get({p}_bbox, 3) - get({p}_bbox, 1))"), 9), cx=lambda p: F.round(c.box_centre(F.col(f"{p}_bbox"), 0), 9), present=has))
    return top_then_sideways(boxes, "session", "area", "cx", 4).select("session", "fi", "side", "place", r6(F.col("area"), "area"))


def seed_frame_two_pass(spark, d) -> DataFrame:
    n = present(long(poses(spark, d), ok=lambda p: c.shoulder_centre(F.col(f"{p}_kps"), 0).isNotNull(), present=has)).groupBy("session", "fi").agg(F.count_if("ok").alias("n"))
    return seed_frame(n, "session", "fi", "n")


def _histograms(spark, d) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    h = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return read(spark, d, "embeddings").select("vec_id", h.alias("p"), F.lag(h).over(w).alias("q")).where("q is not null")


def hist_bhattacharyya(spark, d) -> DataFrame:
    return _histograms(spark, d).select("vec_id", r6(geometry.bhattacharyya(F.col("p"), F.col("q")), "similarity"))


def hist_correlation(spark, d) -> DataFrame:
    return _histograms(spark, d).select("vec_id", r6(geometry.correlation(F.col("p"), F.col("q")), "r"))


def affine_roundtrip(spark, d) -> DataFrame:
    """Maps made of vectors: composed with their inverse, decomposed, and applied to a point."""
    e = lambda k: F.get("embedding", k).cast("double")
    m = F.struct((1 + e(0)).alias("a"), e(1).alias("b"), e(2).alias("tx"), e(3).alias("c"), (1 + e(4)).alias("d"), e(5).alias("ty"))
    rows = read(spark, d, "embeddings").select("vec_id", m.alias("m")).withColumn("i", geometry.compose(F.col("m"), geometry.invert(F.col("m")))).withColumn("s", geometry.decomposed(F.col("m")))
    x, y = geometry.applied(F.col("m"), F.lit(2.0), F.lit(3.0))
    return rows.select("vec_id", r6(F.col("i.a") + F.col("i.d"), "trace"), r6(F.abs("i.b") + F.abs("i.c") + F.abs("i.tx") + F.abs("i.ty"), "rest"), r6(F.col("s.scale"), "scale"), r6(F.col("s.degrees"), "degrees"), r6(x, "x"), r6(y, "y"))


def flagship_arena_metrics(spark, d) -> DataFrame:
    return arena_metrics.summary(poses(spark, d))


def arena_series(spark, d) -> DataFrame:
    f = poses(spark, d)
    return arena_metrics.per_second(arena_metrics.signals(f, arena_metrics.arena_of(f)))


def landed_events(spark, d) -> DataFrame:
    f = poses(spark, d)
    events = arena_metrics.landed(arena_metrics.signals(f, arena_metrics.arena_of(f)))
    return events.select("session", "side", "fi", "verdict", r6(F.col("glove_x"), "glove_x"), r6(F.col("glove_y"), "glove_y"))


def smoothed_keypoints(spark, d) -> DataFrame:
    """Each axis of each keypoint of each side smoothed on its own; where it is not confident the last value is held."""
    p = poses(spark, d)

    def points(side: str):
        return F.transform(f"{side}_kps", lambda k, i: F.struct(F.lit(side).alias("side"), i.alias("i"), k[0].alias("x"), k[1].alias("y"), (k[2] >= 0.35).cast("double").alias("known")))

    both = F.flatten(F.filter(F.array(points("my"), points("op")), lambda x: x.isNotNull()))
    rows = p.select("session", "fi", (F.col("fi") / 15.0).alias("t"), F.inline(both)).select("session", "fi", "t", "side", "i", "known", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("v")))).alias("a"))
    rows = rows.select("session", "side", "i", F.col("a.axis").alias("axis"), "fi", "t", F.col("a.v").alias("x"), "known")
    out = folds.one_euro(rows, ["session", "side", "i", "axis"], "fi")
    return out.select("session", "side", "i", "axis", "fi", F.round("y", 6).alias("v"))


def arena_geometry(spark, d) -> DataFrame:
    a = arena_metrics.arena_of(poses(spark, d))
    return a.select("session", "tier", *(r6(F.col(n), n) for n in ("centre_x", "centre_y", "axis_len", "scale", "my_seen", "op_seen")))


QUERIES = {f.__name__: f for f in (
    kp_visibility, visibility_tier, state_classify, punch_score, wrist_activity, guard_frame, head_zone, stomach_zone, frame_scale, foot_points, verdict_tally, closing_speed_split,
    centroid_principal_axis, density_grid, depth_cell_grid, greedy_iou_assign, nearest_box, topk_sideways, seed_frame_two_pass, hist_bhattacharyya, hist_correlation, affine_roundtrip,
    flagship_arena_metrics, arena_series, landed_events, arena_geometry, smoothed_keypoints,
)}


def _q(body: str, *parts: str) -> str:
    return "WITH " + ", ".join([POSES_SQL, *parts]) + " " + body


_FEET = """ft AS (SELECT p.session, p.fi, p.side, x1, x2, y2, count(k.x) AS n, coalesce(sum(k.x), 0) AS sx, coalesce(sum(k.y), 0) AS sy, CASE WHEN (y2 - y1) / (x2 - x1) >= 0.7::DOUBLE THEN 1 ELSE 0 END AS up
    FROM pose p LEFT JOIN ok k ON k.session = p.session AND k.fi = p.fi AND k.side = p.side AND k.i IN (15, 16) AND k.c > 0.3 GROUP BY ALL),
  foot AS (SELECT session, fi, side, n + up AS n, (sx + up * (x1 + x2) * 0.5::DOUBLE) / nullif(n + up, 0) AS fx, (sy + up * y2) / nullif(n + up, 0) AS fy FROM ft)"""
_SCALE = "coalesce(greatest(2.2::DOUBLE * th, CASE WHEN hcx IS NULL THEN 2.6::DOUBLE * sqrt((kx5 - kx6) ** 2 + (ky5 - ky6) ** 2) END, CASE WHEN (y2 - y1) / (x2 - x1) >= 0.7::DOUBLE THEN y2 - y1 END), 0)"
_IOU = "CASE WHEN iw > 0 AND ih > 0 AND aa + ab - iw * ih > 1e-9 THEN iw * ih / (aa + ab - iw * ih) ELSE 0 END"
_PAIR = _FEET + """, pair AS (SELECT m.session, m.fi, m.vis AS mvis, o.vis AS ovis, greatest(least(m.x2, o.x2) - greatest(m.x1, o.x1), 0) AS iw, greatest(least(m.y2, o.y2) - greatest(m.y1, o.y1), 0) AS ih,
    (m.x2 - m.x1) * (m.y2 - m.y1) AS aa, (o.x2 - o.x1) * (o.y2 - o.y1) AS ab, sqrt((mf.fx - og.fx) ** 2 + (mf.fy - og.fy) ** 2) AS apart, o.session AS os FROM torso m LEFT JOIN torso o ON o.session = m.session AND o.fi = m.fi AND o.side = 'op'
    LEFT JOIN foot mf ON mf.session = m.session AND mf.fi = m.fi AND mf.side = 'my' LEFT JOIN foot og ON og.session = m.session AND og.fi = m.fi AND og.side = 'op' WHERE m.side = 'my')"""
_MOVE = """rel AS (SELECT *, kx9 - scx AS lx, ky9 - scy AS ly, kx10 - scx AS rx, ky10 - scy AS ry, hx - scx AS qx, hy - scy AS qy FROM torso),
  mv AS (SELECT *, sqrt((lx - lag(lx) OVER w) ** 2 + (ly - lag(ly) OVER w) ** 2) AS lv, sqrt((rx - lag(rx) OVER w) ** 2 + (ry - lag(ry) OVER w) ** 2) AS rv, lx - lag(lx) OVER w AS lvx, ly - lag(ly) OVER w AS lvy, rx - lag(rx) OVER w AS rvx, ry - lag(ry) OVER w AS rvy,
    sqrt((qx - lag(qx) OVER w) ** 2 + (qy - lag(qy) OVER w) ** 2) AS hm, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) AS bp,
    CASE WHEN th > 1e-6 THEN sqrt(lx * lx + ly * ly) / th END AS lext, CASE WHEN th > 1e-6 THEN sqrt(rx * rx + ry * ry) / th END AS rext,
    CASE WHEN greatest(y2 - y1, 0.1::DOUBLE) < 0.7::DOUBLE THEN least(2.5::DOUBLE, 0.7::DOUBLE / greatest(y2 - y1, 0.1::DOUBLE)) ELSE 1.0::DOUBLE END AS zoom FROM rel WINDOW w AS (PARTITION BY session, side ORDER BY fi)),
  dir AS (SELECT a.*, b.cx - a.cx AS tx, b.cy - a.cy AS ty, coalesce(sqrt((b.cx - a.cx) ** 2 + (b.cy - a.cy) ** 2), 0) AS tm FROM mv a LEFT JOIN mv b ON b.session = a.session AND b.fi = a.fi AND b.side <> a.side)"""
_SIDE = lambda h: f"CASE WHEN {h}v * zoom >= 1e-6 THEN {h}ext * {h}v * zoom * CASE WHEN tm < 1e-6 THEN 0.5::DOUBLE ELSE greatest(0.7::DOUBLE, least(1.0::DOUBLE, (({h}vx * tx + {h}vy * ty) / ({h}v * zoom * tm) + 1) / 2)) END END"
_HEADZ = """hz AS (SELECT session, fi, side, y1 AS top, sh - greatest(0.01::DOUBLE * (y2 - y1), 0.10::DOUBLE * (sh - y1)) AS bot, x1, x2, y2 - y1 AS bh, sh,
    coalesce(kx0, (kx1 + kx2) * 0.5::DOUBLE, (kx3 + kx4) * 0.5::DOUBLE, ((x1 + x2) * 0.5::DOUBLE + coalesce(kx3, kx4, kx1, kx2)) * 0.5::DOUBLE, (x1 + x2) * 0.5::DOUBLE) AS hcx FROM (SELECT *, coalesce((ky5 + ky6) * 0.5::DOUBLE, ky5, ky6) AS sh FROM torso)),
  hb AS (SELECT session, fi, side, top, bot, greatest(x1 + half, least(x2 - half, hcx)) - half AS zx1, greatest(x1 + half, least(x2 - half, hcx)) + half AS zx2 FROM (SELECT *, (bot - top) / {aspect}::DOUBLE / 2 AS half FROM hz) WHERE bh >= 0.04 AND sh IS NOT NULL AND bot - top >= 0.02)"""
_STOMZ = """sz AS (SELECT session, fi, side, top, hcy AS bot, (scx + hcx) * 0.5::DOUBLE - (hcy - top) / {aspect}::DOUBLE / 2 AS zx1, (scx + hcx) * 0.5::DOUBLE + (hcy - top) / {aspect}::DOUBLE / 2 AS zx2 FROM (SELECT *, scy + 0.25::DOUBLE * (hcy - scy) AS top FROM torso) WHERE hcy > scy AND hcy - top >= 0.02)"""
_VERDICT = f"""vd AS (SELECT g.session, g.fi, g.side, gx, gy, CASE WHEN ({_IOU}) >= 0.55::DOUBLE OR (h.top IS NULL AND z.top IS NULL) OR most < 0.5::DOUBLE THEN 'unknown' WHEN coalesce(gx BETWEEN h.zx1 - 0.015::DOUBLE AND h.zx2 + 0.015::DOUBLE AND gy BETWEEN h.top - 0.015::DOUBLE AND h.bot + 0.015::DOUBLE, false) THEN 'landed_head'
        WHEN coalesce(gx BETWEEN z.zx1 - 0.015::DOUBLE AND z.zx2 + 0.015::DOUBLE AND gy BETWEEN z.top - 0.015::DOUBLE AND z.bot + 0.015::DOUBLE, false) THEN 'landed_body' ELSE 'missed' END AS v
      FROM (SELECT *, greatest(coalesce(lext, -1), coalesce(rext, -1)) AS most, CASE WHEN coalesce(lext, -1) >= coalesce(rext, -1) THEN coalesce(kx9 + 0.35::DOUBLE * (kx9 - kx7), kx9) ELSE coalesce(kx10 + 0.35::DOUBLE * (kx10 - kx8), kx10) END AS gx,
        CASE WHEN coalesce(lext, -1) >= coalesce(rext, -1) THEN coalesce(ky9 + 0.35::DOUBLE * (ky9 - ky7), ky9) ELSE coalesce(ky10 + 0.35::DOUBLE * (ky10 - ky8), ky10) END AS gy FROM mv) g
      JOIN pair USING (session, fi) LEFT JOIN hb h ON h.session = g.session AND h.fi = g.fi AND h.side <> g.side LEFT JOIN sz z ON z.session = g.session AND z.fi = g.fi AND z.side <> g.side WHERE os IS NOT NULL)"""
_ARENA = f"""arena AS (SELECT session, CASE WHEN fs >= 0.75 THEN 'high' WHEN fs >= 0.40 THEN 'medium' WHEN fs >= 0.15 THEN 'low' ELSE 'none' END AS tier, CASE WHEN np >= 3 THEN cx END AS centre_x, CASE WHEN np >= 3 THEN cy END AS centre_y,
      CASE WHEN np >= 3 THEN sqrt((xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy ** 2)) ELSE 0 END AS axis_len, coalesce(sc, 0) AS scale, ms AS my_seen, os AS op_seen FROM (
      SELECT session, count(DISTINCT fi) FILTER (WHERE n > 0) / count(DISTINCT fi)::DOUBLE AS fs, count(*) FILTER (WHERE side = 'my' AND n > 0) / count(DISTINCT fi)::DOUBLE AS ms, count(*) FILTER (WHERE side = 'op' AND n > 0) / count(DISTINCT fi)::DOUBLE AS os FROM foot GROUP BY session)
      LEFT JOIN (SELECT session, count(*) AS np, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM (SELECT session, x, y FROM ok WHERE i IN (15, 16) AND c > 0.3 UNION ALL SELECT session, (x1 + x2) * 0.5::DOUBLE, y2 FROM ft WHERE up = 1) GROUP BY session) USING (session)
      LEFT JOIN (SELECT session, median(s) AS sc FROM (SELECT session, {_SCALE} AS s FROM torso) WHERE s > 0 GROUP BY session) USING (session))"""
#: Every signal of a side's frame; both sides have a row in every frame.
_FRAMES = (
    _MOVE, _PAIR, _HEADZ.replace("{aspect}", "1.0"), _STOMZ.replace("{aspect}", "1.0"), _VERDICT, _ARENA,
    f"""sg AS (SELECT session, fi, side, coalesce(greatest({_SIDE('l')}, {_SIDE('r')}), 0) AS score, coalesce(greatest(lv, rv), 0) AS wrist, coalesce(hm, 0) AS hm, coalesce(bp, 0) AS bp, coalesce(greatest(lext, rext) >= 0.55 AND greatest(lv, rv) >= 0.075, false) AS punching,
      (coalesce(ga, 0) + coalesce(gb, 0)) / nullif((ga IS NOT NULL)::INT + (gb IS NOT NULL)::INT, 0) AS guard
      FROM (SELECT *, CASE WHEN th > 0 AND ly IS NOT NULL THEN least(greatest(1.0 - (ly / th + 0.1), 0), 1) END AS ga, CASE WHEN th > 0 AND ry IS NOT NULL THEN least(greatest(1.0 - (ry / th + 0.1), 0), 1) END AS gb FROM dir))""",
    f"""f0 AS (SELECT p.session, p.fi, sides.side, floor(p.fi / 15.0::DOUBLE)::BIGINT AS sec, coalesce(score, 0) AS score, coalesce(wrist, 0) AS wrist, coalesce(hm, 0) AS hm, coalesce(bp, 0) AS bp, coalesce(punching, false) AS punching, guard,
      CASE tier WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE WHEN 'low' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS weight, fx, fy, s, sqrt((fx - centre_x) ** 2 + (fy - centre_y) ** 2) / s AS away, p.apart / s AS apart, coalesce(v, 'unknown') AS v, gx, gy,
      CASE WHEN mvis < 0.4::DOUBLE OR coalesce(ovis, 0) < 0.4::DOUBLE THEN 'occlusion' WHEN {_IOU} >= 0.4::DOUBLE THEN 'clinch' WHEN p.apart / s < 0.5::DOUBLE THEN 'close' ELSE 'open' END AS state
      FROM pair p CROSS JOIN (VALUES ('my'), ('op')) sides(side) JOIN (SELECT *, CASE WHEN scale = 0 THEN 100 ELSE scale END AS s FROM arena) a ON a.session = p.session LEFT JOIN sg g ON g.session = p.session AND g.fi = p.fi AND g.side = sides.side
      LEFT JOIN foot t ON t.session = p.session AND t.fi = p.fi AND t.side = sides.side LEFT JOIN vd d ON d.session = p.session AND d.fi = p.fi AND d.side = sides.side)""",
    """f1 AS (SELECT *, coalesce(sqrt((fx - lag(fx) OVER w) ** 2 + (fy - lag(fy) OVER w) ** 2) / s, 0) AS path, lag(apart) OVER w - apart AS nearer, score >= 0.07::DOUBLE AND score = max(score) OVER (PARTITION BY session, side ORDER BY fi ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS peak FROM f0 WINDOW w AS (PARTITION BY session, side ORDER BY fi))""",
    """f2 AS (SELECT *, coalesce(nearer * path / greatest(sum(path) OVER (PARTITION BY session, fi), 1e-6), 0) AS closing FROM f1)""",
    """fr AS (SELECT f.*, b.away AS other_away, max(b.peak::INT) OVER (PARTITION BY f.session, f.side ORDER BY f.fi ROWS BETWEEN 6 PRECEDING AND 2 FOLLOWING) = 1 AND f.state <> 'occlusion' AS attacked,
      CASE f.state WHEN 'open' THEN 0.60::DOUBLE * least(f.score / 0.20::DOUBLE, 1) + 0.30::DOUBLE * (f.closing > 0.005::DOUBLE)::INT + 0.10::DOUBLE * (b.closing < -0.005::DOUBLE)::INT WHEN 'close' THEN 0.50::DOUBLE * least(f.wrist / 0.05::DOUBLE, 1) + 0.30::DOUBLE * least(f.score / 0.20::DOUBLE, 1) + 0.20::DOUBLE * least(f.bp / 0.02::DOUBLE, 1)
        WHEN 'clinch' THEN 0.60::DOUBLE * least(f.wrist / 0.05::DOUBLE, 1) + 0.20::DOUBLE * least(f.hm / 0.015::DOUBLE, 1) + 0.20::DOUBLE * least(f.bp / 0.02::DOUBLE, 1) END AS aggression,
      coalesce(CASE WHEN f.apart IS NOT NULL THEN least(greatest((f.apart - 1.3::DOUBLE) / (2.2::DOUBLE - 1.3::DOUBLE), 0), 1) END, 0) AS dist, least(f.hm / 0.02::DOUBLE, 1) AS head, coalesce(f.guard, 0) AS guarded, least(f.wrist / 0.04::DOUBLE, 1) AS counter
      FROM f2 f JOIN f2 b ON b.session = f.session AND b.fi = f.fi AND b.side <> f.side)""",
)
_SHARE = lambda a, b, floor: f"CASE WHEN {a} + {b} > {floor} THEN round_even(100 * {a} / ({a} + {b}), 0)::INTEGER ELSE 50 END"
_PCT = lambda x: f"round_even(round({x}, 9), 0)::INTEGER"
#: Shares of each second with frames.
_SECONDS = (
    "s0 AS (SELECT session, sec, count(DISTINCT fi) AS n, max(fi) / 15.0::DOUBLE AS last, count(*) FILTER (WHERE state = 'occlusion' AND side = 'my') AS hidden, "
    + ", ".join(
        f"count(*) FILTER (WHERE side = '{p}' AND away {'<' if p == 'my' else '<='} other_away) AS {p}_near, round(coalesce(sum(aggression) FILTER (WHERE side = '{p}'), 0), 9) AS {p}_agg, round(sum(path * weight) FILTER (WHERE side = '{p}'), 9) AS {p}_path, count(*) FILTER (WHERE side = '{p}' AND punching) AS {p}_vol, round(sum(hm) FILTER (WHERE side = '{p}'), 9) AS {p}_hm, "
        f"avg(guard) FILTER (WHERE side = '{p}') AS {p}_g, coalesce(round(avg(0.40::DOUBLE * dist + 0.25::DOUBLE * head + 0.25::DOUBLE * guarded + 0.10::DOUBLE * counter) FILTER (WHERE side = '{p}' AND attacked), 9), 0.5) AS {p}_def, "
        + ", ".join(f"{_PCT(f'100 * avg({k}) FILTER (WHERE side = {chr(39)}{p}{chr(39)} AND attacked)')} AS {p}_{k}_pct" for k in ("dist", "head", "guarded"))
        + ", " + ", ".join(f"count(*) FILTER (WHERE side = '{p}' AND peak AND v = '{v}') AS {p}_{v}" for v in arena_metrics.VERDICTS)
        for p in ("my", "op")
    )
    + " FROM fr GROUP BY session, sec), md AS (SELECT session, sec, state FROM (SELECT session, sec, state, row_number() OVER (PARTITION BY session, sec ORDER BY count(*) DESC, min(fi)) AS r FROM fr GROUP BY session, sec, state) WHERE r = 1), "
    + "s1 AS (SELECT s0.*, state, hidden / n >= 0.5 AS held, CASE WHEN my_agg + op_agg > 1e-6 AND NOT hidden / n >= 0.5 THEN round_even(100 * my_agg / (my_agg + op_agg), 0) END AS own FROM s0 JOIN md USING (session, sec)), "
    + "s2 AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS known, sec - last_value(CASE WHEN own IS NOT NULL THEN sec END IGNORE NULLS) OVER w AS since FROM s1 WINDOW w AS (PARTITION BY session ORDER BY sec ROWS UNBOUNDED PRECEDING)), "
    + "s3 AS (SELECT *, " + ", ".join([
        _SHARE("my_near", "op_near", 0) + " AS my_ring", _SHARE("my_path", "op_path", "1e-6") + " AS my_movement", _SHARE("my_vol", "op_vol", 0) + " AS my_volume", _SHARE("my_def", "op_def", "1e-6") + " AS my_defence", _SHARE("my_hm", "op_hm", "1e-6") + " AS my_head_movement",
        "CASE WHEN own IS NOT NULL THEN own WHEN held AND known IS NOT NULL THEN round_even(round(50 + (known - 50) * exp(-since / 2.5::DOUBLE), 9), 0) ELSE 50 END::INTEGER AS my_aggression", *(f"coalesce({_PCT(f'100 * {p}_g')}, 50) AS {p}_guard" for p in ("my", "op")),
    ]) + " FROM s2), sc AS (SELECT *, " + ", ".join(f"100 - my_{k} AS op_{k}" for k in arena_metrics.SCORES[:-1]) + " FROM s3)"
)
_COLUMNS = [f"{p}_{k}" for p in ("my", "op") for k in (*arena_metrics.SCORES, *(f"{x}_pct" for x in arena_metrics.PILLARS))]
_SERIES = f"""SELECT e.session, e.sec, {", ".join(f"coalesce(sc.{k}, 50) AS {k}" for k in _COLUMNS)}, coalesce(sc.state, 'open') AS state
  FROM (SELECT session, unnest(range(0, ends)) AS sec FROM (SELECT session, greatest(ceil(max(last)), max(sec))::BIGINT + 1 AS ends FROM sc GROUP BY session)) e LEFT JOIN sc ON sc.session = e.session AND sc.sec = e.sec"""
_PULLED = lambda p, k: f"CASE WHEN {p}_seen >= 0.75::DOUBLE THEN {p}_{k} ELSE round_even(50 + ({p}_{k} - 50) * least(greatest({p}_seen / 0.75::DOUBLE, 0), 1), 0) END::INTEGER AS {p}_{k}"
_SUMMARY = f"""SELECT session, tier, duration_s, open_share, close_share, clinch_share, occlusion_share, {", ".join(_PULLED(p, k) if k in ("ring", "aggression", "movement", "defence") else f"{p}_{k}" for p in ("my", "op") for k in arena_metrics.SCORES)},
  {", ".join(f"{p}_{v}" for p in ("my", "op") for v in arena_metrics.VERDICTS)}, {", ".join(f"{p}_landed_head + {p}_landed_body + {p}_missed + {p}_unknown AS {p}_punches, CASE WHEN {p}_landed_head + {p}_landed_body + {p}_missed > 0 THEN round_even(100 * ({p}_landed_head + {p}_landed_body) / ({p}_landed_head + {p}_landed_body + {p}_missed), 0)::INTEGER END AS {p}_accuracy" for p in ("my", "op"))}
  FROM (SELECT session, spine::INTEGER AS duration_s, {", ".join(f"{_PCT(f'(sum({p}_{k}) + 50 * (spine - count(*))) / spine')} AS {p}_{k}" for p in ("my", "op") for k in arena_metrics.SCORES)},
    {", ".join(f"round_even(100 * (count(*) FILTER (WHERE state = '{s}') + {'spine - count(*)' if s == 'open' else '0'}) / spine, 0)::INTEGER AS {s}_share" for s in arena_metrics.STATES)}, {", ".join(f"sum({p}_{v})::BIGINT AS {p}_{v}" for p in ("my", "op") for v in arena_metrics.VERDICTS)}
    FROM sc JOIN (SELECT session, greatest(1, ceil(max(last)) + 1) AS spine FROM sc GROUP BY session HAVING sum(n) >= 4) USING (session) GROUP BY session, spine) JOIN arena USING (session)"""
_DET = """det AS (SELECT m.session, m.fi, [m.x1, m.y1, m.x2, m.y2] AS mb, [o.x1, o.y1, o.x2, o.y2] AS ob FROM pose m JOIN pose o ON o.session = m.session AND o.fi = m.fi AND o.side = 'op' WHERE m.side = 'my'),
  ds AS (SELECT session, fi, mb, ob, j, CASE j WHEN 0 THEN [x + 0.03::DOUBLE FOR x IN ob] WHEN 1 THEN [(mb[1] + ob[1]) / 2, (mb[2] + ob[2]) / 2, (mb[3] + ob[3]) / 2, (mb[4] + ob[4]) / 2] ELSE [x + -0.02::DOUBLE FOR x IN mb] END AS b FROM det, range(3) r(j))"""


def _iou(a: str, b: str) -> str:
    i = f"greatest(least({a}[3], {b}[3]) - greatest({a}[1], {b}[1]), 0) * greatest(least({a}[4], {b}[4]) - greatest({a}[2], {b}[2]), 0)"
    return f"({i}) / (({a}[3] - {a}[1]) * ({a}[4] - {a}[2]) + ({b}[3] - {b}[1]) * ({b}[4] - {b}[2]) - ({i}))"


_HIST = "WITH h AS (SELECT vec_id, [abs(CAST(x AS DOUBLE)) FOR x IN embedding] AS p, label FROM embeddings), pq AS (SELECT vec_id, p, q FROM (SELECT vec_id, p, lag(p) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM h) WHERE q IS NOT NULL) "
ORACLES = {
    "kp_visibility": _q("SELECT session, fi, side, round(vis, 6) AS vis FROM pose"),
    "visibility_tier": _q("SELECT session, side, v AS visibility, CASE WHEN v >= 0.75 THEN 'high' WHEN v >= 0.40 THEN 'medium' WHEN v >= 0.15 THEN 'low' ELSE 'none' END AS tier FROM (SELECT session, side, round(count(scx) / count(*)::DOUBLE, 6) AS v FROM torso GROUP BY ALL)"),
    "state_classify": _q(f"SELECT session, CASE WHEN mvis < 0.4::DOUBLE OR coalesce(ovis, 0) < 0.4::DOUBLE THEN 'occlusion' WHEN {_IOU} >= 0.4::DOUBLE THEN 'clinch' WHEN apart < 0.5::DOUBLE THEN 'close' ELSE 'open' END AS state, count(*) AS n_frames FROM pair GROUP BY ALL", _PAIR),
    "punch_score": _q(f"SELECT session, fi, side, round(coalesce(greatest({_SIDE('l')}, {_SIDE('r')}), 0), 6) AS score, coalesce(greatest(lext, rext) >= 0.55 AND greatest(lv, rv) >= 0.075, false) AS punching FROM dir", _MOVE),
    "wrist_activity": _q("SELECT session, fi, side, round(coalesce(greatest(lv, rv), 0), 6) AS wrist, round(coalesce(hm, 0), 6) AS head_move, round(coalesce(bp, 0), 6) AS push FROM mv", _MOVE),
    "guard_frame": _q("SELECT session, fi, side, round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 6) AS guard FROM (SELECT session, fi, side, CASE WHEN th > 0 AND ly IS NOT NULL THEN least(greatest(1.0 - (ly / th + 0.1), 0), 1) END AS a, CASE WHEN th > 0 AND ry IS NOT NULL THEN least(greatest(1.0 - (ry / th + 0.1), 0), 1) END AS b FROM rel)", _MOVE),
    "head_zone": _q("SELECT session, fi, side, round(zx1, 6) AS zx1, round(top, 6) AS zy1, round(zx2, 6) AS zx2, round(bot, 6) AS zy2 FROM pose LEFT JOIN hb USING (session, fi, side)", _HEADZ.replace("{aspect}", "(16.0::DOUBLE / 9)")),
    "stomach_zone": _q("SELECT session, fi, side, round(zx1, 6) AS zx1, round(top, 6) AS zy1, round(zx2, 6) AS zx2, round(bot, 6) AS zy2 FROM pose LEFT JOIN sz USING (session, fi, side)", _STOMZ.replace("{aspect}", "(16.0::DOUBLE / 9)")),
    "frame_scale": _q(f"SELECT session, fi, side, round({_SCALE}, 6) AS scale FROM torso"),
    "foot_points": _q("SELECT session, fi, side, n, round(fx, 6) AS mx, round(fy, 6) AS my FROM foot", _FEET),
    "verdict_tally": _q("""SELECT session, side, count(*) AS punches, count(*) FILTER (WHERE v = 'landed_head') AS landed_head, count(*) FILTER (WHERE v = 'landed_body') AS landed_body, count(*) FILTER (WHERE v = 'missed') AS missed, count(*) FILTER (WHERE v = 'unknown') AS unknown,
      CASE WHEN count(*) FILTER (WHERE v <> 'unknown') > 0 THEN CAST(round_even(100.0 * count(*) FILTER (WHERE v LIKE 'landed%') / count(*) FILTER (WHERE v <> 'unknown'), 0) AS INTEGER) END AS accuracy FROM vd GROUP BY ALL""", _MOVE, _PAIR, _HEADZ.replace("{aspect}", "1.0"), _STOMZ.replace("{aspect}", "1.0"), _VERDICT),
    "closing_speed_split": _q("""SELECT session, fi, round(coalesce(cl * mp / greatest(mp + op, 1e-6), 0), 6) AS my_closing, round(coalesce(cl * op / greatest(mp + op, 1e-6), 0), 6) AS op_closing, round(mp, 6) AS my_path, round(op, 6) AS op_path FROM (
      SELECT session, fi, lag(ap) OVER w - ap AS cl, coalesce(sqrt((mx - lag(mx) OVER w) ** 2 + (my - lag(my) OVER w) ** 2) / 0.8::DOUBLE, 0) AS mp, coalesce(sqrt((ox - lag(ox) OVER w) ** 2 + (oy - lag(oy) OVER w) ** 2) / 0.8::DOUBLE, 0) AS op FROM (
        SELECT m.session, m.fi, m.fx AS mx, m.fy AS my, o.fx AS ox, o.fy AS oy, sqrt((m.fx - o.fx) ** 2 + (m.fy - o.fy) ** 2) / 0.8::DOUBLE AS ap FROM foot m LEFT JOIN foot o ON o.session = m.session AND o.fi = m.fi AND o.side = 'op' WHERE m.side = 'my') WINDOW w AS (PARTITION BY session ORDER BY fi))""", _FEET),
    "centroid_principal_axis": """SELECT session, round(cx, 5) AS cx, round(cy, 5) AS cy, round(sqrt(mid + half), 5) AS axis_len, round(sqrt(greatest(mid - half, 0)), 5) AS minor_len, round(atan2(2 * xy, xx - yy) / 2, 5) AS angle FROM (SELECT *, (xx + yy) / 2 AS mid, sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS half FROM (
      SELECT l_suppkey AS session, avg(l_quantity) AS cx, avg(l_extendedprice / 1000) AS cy, var_samp(l_quantity) AS xx, var_samp(l_extendedprice / 1000) AS yy, covar_samp(l_quantity, l_extendedprice / 1000) AS xy FROM lineitem GROUP BY l_suppkey))""",
    "density_grid": _q("""SELECT session, CAST(gx + k1.d AS BIGINT) AS gx, CAST(gy + k2.d AS BIGINT) AS gy, round(sum(n * k1.w * k2.w), 6) AS n FROM (SELECT session, floor(cx * 20) AS gx, floor(y2 * 20) AS gy, count(*)::DOUBLE AS n FROM torso GROUP BY ALL),
      (VALUES (-2, 0.0625::DOUBLE), (-1, 0.25::DOUBLE), (0, 0.375::DOUBLE), (1, 0.25::DOUBLE), (2, 0.0625::DOUBLE)) k1(d, w), (VALUES (-2, 0.0625::DOUBLE), (-1, 0.25::DOUBLE), (0, 0.375::DOUBLE), (1, 0.25::DOUBLE), (2, 0.0625::DOUBLE)) k2(d, w) GROUP BY ALL"""),
    "depth_cell_grid": _q("SELECT session, side, CAST(floor(least(greatest(cx, 0), 0.999::DOUBLE) * 24) AS BIGINT) AS gx, CAST(floor(least(greatest(y2 - y1, 0), 0.999::DOUBLE) * 16) AS BIGINT) AS gy, count(*) AS n FROM torso GROUP BY ALL"),
    "greedy_iou_assign": _q("""SELECT session, fi, my_pick, op_pick FROM det LEFT JOIN m USING (session, fi) LEFT JOIN o USING (session, fi)""", _DET,
        f"m AS (SELECT session, fi, CAST(j AS INTEGER) AS my_pick FROM (SELECT *, row_number() OVER (PARTITION BY session, fi ORDER BY {_iou('mb', 'b')} DESC, j) AS r, {_iou('mb', 'b')} AS s FROM ds) WHERE r = 1 AND s > 0.15)",
        f"o AS (SELECT session, fi, CAST(j AS INTEGER) AS op_pick FROM (SELECT *, row_number() OVER (PARTITION BY session, fi ORDER BY {_iou('ob', 'b')} DESC, j) AS r, {_iou('ob', 'b')} AS s FROM ds LEFT JOIN m USING (session, fi) WHERE my_pick IS NULL OR j <> my_pick) WHERE r = 1 AND s > 0.15)"),
    "nearest_box": _q("SELECT session, fi, CAST(j AS INTEGER) AS pick FROM (SELECT session, fi, j, row_number() OVER (PARTITION BY session, fi ORDER BY ((b[1] + b[3]) / 2 - 0.5) ** 2 + ((b[2] + b[4]) / 2 - 0.5) ** 2, j) AS r FROM ds) WHERE r = 1", _DET),
    "topk_sideways": _q("SELECT session, fi, side, CAST(row_number() OVER (PARTITION BY session ORDER BY c) AS INTEGER) AS place, round(area, 6) AS area FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY area DESC, c) AS r FROM (SELECT session, fi, side, round((x2 - x1) * (y2 - y1), 9) AS area, round(cx, 9) AS c FROM torso)) WHERE r <= 4"),
    "seed_frame_two_pass": _q("SELECT session, coalesce(min(fi) FILTER (WHERE n = 2), min(fi) FILTER (WHERE n > 2)) AS seed_fi FROM (SELECT session, fi, count(scx) AS n FROM torso GROUP BY ALL) GROUP BY session"),
    "hist_bhattacharyya": _HIST + "SELECT vec_id, round(1 - sqrt(greatest(1 - b / sqrt(sp * sq), 0)), 6) AS similarity FROM (SELECT vec_id, list_sum([sqrt(p[i] * q[i]) FOR i IN range(1, 65)]) AS b, list_sum(p) AS sp, list_sum(q) AS sq FROM pq)",
    "hist_correlation": _HIST + "SELECT vec_id, round((spq - sp * sq / 64) / sqrt((spp - sp * sp / 64) * (sqq - sq * sq / 64)), 6) AS r FROM (SELECT vec_id, list_sum([p[i] * q[i] FOR i IN range(1, 65)]) AS spq, list_sum([x * x FOR x IN p]) AS spp, list_sum([x * x FOR x IN q]) AS sqq, list_sum(p) AS sp, list_sum(q) AS sq FROM pq)",
    "affine_roundtrip": "SELECT vec_id, 2.0::DOUBLE AS trace, 0.0::DOUBLE AS rest, round(sqrt(a * a + c * c), 6) AS scale, round(degrees(atan2(c, a)), 6) AS degrees, round(a * 2 + b * 3 + tx, 6) AS x, round(c * 2 + d * 3 + ty, 6) AS y FROM (SELECT vec_id, 1 + CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS tx, CAST(embedding[4] AS DOUBLE) AS c, 1 + CAST(embedding[5] AS DOUBLE) AS d, CAST(embedding[6] AS DOUBLE) AS ty FROM embeddings)",
    "smoothed_keypoints": "WITH RECURSIVE " + POSES_SQL + """, raw AS (SELECT session, side, i, axis, fi, fi / 15.0::DOUBLE AS t, CASE axis WHEN 'x' THEN x ELSE y END AS v, c >= 0.35::DOUBLE AS known, row_number() OVER (PARTITION BY session, side, i, axis ORDER BY fi) AS r FROM kp, (VALUES ('x'), ('y')) a(axis)),
      walk AS (SELECT session, side, i, axis, fi, r, v AS o, CASE WHEN known THEN v END AS y, 0.0::DOUBLE AS s, CASE WHEN known THEN t END AS tl FROM raw WHERE r = 1 UNION ALL
        SELECT session, side, i, axis, fi, r, CASE WHEN y IS NULL THEN v WHEN known THEN a * v + (1 - a) * y ELSE y END, CASE WHEN NOT known THEN y WHEN y IS NULL THEN v ELSE a * v + (1 - a) * y END, CASE WHEN NOT known OR y IS NULL THEN s ELSE ds END, CASE WHEN known THEN t ELSE tl END FROM (
          SELECT *, 1 / (1 + 1 / (2 * pi() * (1.0::DOUBLE + 0.4::DOUBLE * abs(ds))) / dt) AS a FROM (SELECT *, ad * (v - y) / dt + (1 - ad) * s AS ds FROM (SELECT *, 1 / (1 + 1 / (2 * pi()) / dt) AS ad FROM (
            SELECT n.*, w.y, w.s, w.tl, greatest(n.t - w.tl, 1e-6::DOUBLE) AS dt FROM walk w JOIN raw n ON n.session = w.session AND n.side = w.side AND n.i = w.i AND n.axis = w.axis AND n.r = w.r + 1)))))
      SELECT session, side, i, axis, fi, round(o, 6) AS v FROM walk""",
    "arena_geometry": _q("SELECT session, tier, round(centre_x, 6) AS centre_x, round(centre_y, 6) AS centre_y, round(axis_len, 6) AS axis_len, round(scale, 6) AS scale, round(my_seen, 6) AS my_seen, round(op_seen, 6) AS op_seen FROM arena", _FEET, _ARENA),
    "landed_events": _q("SELECT session, side, fi, v AS verdict, CASE WHEN v <> 'unknown' THEN round(gx, 6) END AS glove_x, CASE WHEN v <> 'unknown' THEN round(gy, 6) END AS glove_y FROM fr WHERE peak", *_FRAMES),
    "arena_series": _q(_SERIES, *_FRAMES, _SECONDS),
    "flagship_arena_metrics": _q(_SUMMARY, *_FRAMES, _SECONDS),
}
