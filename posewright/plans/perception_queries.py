"""Queries over detections, pickers, seeds, overlays and session lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posewright.fixtures import POSES_SQL, SIGNALS_SQL, poses, read, signals
from posewright.functions import columns as c
from posewright.functions import perception as p
from posewright.operators import series
from posewright.plans.pose_queries import _q, long

#: Size of a frame in pixels.
W, H = 1280.0, 720.0

r6 = lambda x, n: F.round(x, 6).alias(n)


def sides(spark, d) -> DataFrame:
    """(session, fi, side, kps, box) of every pose; boxes are normalised."""
    return long(poses(spark, d), kps=lambda s: F.col(f"{s}_kps"), box=lambda s: F.col(f"{s}_bbox")).where("box is not null")


def in_pixels(spark, d) -> DataFrame:
    return sides(spark, d).withColumn("px", p.scaled_box(F.col("box"), W, H))


def box_scores(spark, d) -> DataFrame:
    """Ring and size scores, ropes and height of every box."""
    b = in_pixels(spark, d)
    return b.select("session", "fi", "side", r6(p.ring_score(F.col("px"), W, H), "ring"), r6(p.ring_score(F.col("px"), H, W), "portrait_ring"), r6(p.size_score(F.col("px"), F.lit(0.4 * H)), "size"), p.on_ropes(F.col("px"), W, H).alias("on_ropes"), r6(p.height(F.col("box")), "height"))


def box_height_default(spark, d) -> DataFrame:
    """Height of either side's box in every frame, the default where it is missing."""
    return long(poses(spark, d), h=lambda s: F.round(p.height(F.col(f"{s}_bbox")), 6))


def fallback_boxes(spark, d) -> DataFrame:
    """Box and prompt points that stand for a person known by a point."""
    b = in_pixels(spark, d).select("session", "fi", "side", c.box_centre(F.col("px"), 0).alias("x"), c.box_centre(F.col("px"), 1).alias("y"))
    b = b.withColumn("b", p.fallback_box(F.col("x"), F.col("y"), W, H)).withColumn("q", p.prompt_points(F.col("x"), F.col("y"), H))
    return b.select("session", "fi", "side", *(F.get("b", k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))), r6(F.get(F.get("q", 0), 1), "head_y"), r6(F.get(F.get("q", 2), 1), "belly_y"))


def track_confidence(spark, d) -> DataFrame:
    """Confidence and reliability of a track that coasts as many frames as keypoints are hidden."""
    b = sides(spark, d).withColumn("coast", 17 - F.size(F.filter("kps", lambda k: k[2] >= 0.35)))
    first = F.get(F.get("kps", 0), 2) >= 0.35
    return b.select("session", "fi", "side", r6(p.confidence(F.col("coast"), first), "confidence"), p.reliable(F.col("coast"), F.when(first, 0).otherwise(15)).alias("reliable"))


def _detections(spark, d) -> DataFrame:
    """(session, fi, mine, theirs, dets): both boxes and the one between them, in pixels, with a confidence each."""
    f = poses(spark, d).where("my_bbox is not null and op_bbox is not null")
    a, b = p.scaled_box(F.col("my_bbox"), W, H), p.scaled_box(F.col("op_bbox"), W, H)
    va, vb = c.visibility(F.col("my_kps")), c.visibility(F.col("op_kps"))
    f = f.select("session", "fi", a.alias("mine"), b.alias("theirs"), va.alias("va"), vb.alias("vb"))
    det = lambda box, conf: F.struct(box.alias("box"), conf.alias("conf"))
    between = F.zip_with("mine", "theirs", lambda x, y: (x + y) / 2)
    return f.withColumn("dets", F.array(det(F.transform("theirs", lambda x: x + 4.0), F.col("vb")), det(between, (F.col("va") + F.col("vb")) / 2), det(F.transform("mine", lambda x: x - 4.0), F.col("va"))))


def picker_scores(spark, d) -> DataFrame:
    """Use of a frame for picking: its two best boxes far apart, large and without overlap."""
    ranked = F.array_sort(F.transform("dets", lambda x, j: F.struct((-p.ring_score(x["box"], W, H)).alias("s"), j.alias("j"), x["box"].alias("box"))))
    f = _detections(spark, d).withColumn("r", ranked)
    a, b = F.get("r", 0), F.get("r", 1)
    apart = c.distance(c.box_centre(a["box"], 0), c.box_centre(a["box"], 1), c.box_centre(b["box"], 0), c.box_centre(b["box"], 1)) / max(W, H)
    score = apart * (1 - c.iou(a["box"], b["box"])) * (-(a["s"] + b["s"]) / (W * H * 2))
    return f.select("session", "fi", r6(score, "score"))


def picker_order(spark, d) -> DataFrame:
    """Frames of a session by score, the earlier of equal ones first; the best, and the one shown after each."""
    w = Window.partitionBy("session").orderBy(F.desc("score"), "fi")
    s = picker_scores(spark, d).withColumn("place", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("session")))
    return s.select("session", "fi", "place", ((F.col("place") + 1) % F.col("n")).cast("int").alias("next_place"), (F.col("place") == 0).alias("best"))


def detection_filters(spark, d) -> DataFrame:
    """How many detections of a frame pass each filter: confidence, area, and a centre off the edges."""
    count = lambda keep: F.size(F.filter("dets", keep))
    big = lambda x, share: p.area(x["box"]) >= share * W * H
    centred = lambda x: (c.box_centre(x["box"], 0) > 0.08 * W) & (c.box_centre(x["box"], 0) < 0.92 * W)
    return _detections(spark, d).select("session", "fi", count(lambda x: (x["conf"] >= 0.30) & big(x, 0.01)).alias("picker"), count(lambda x: (x["conf"] >= 0.45) & big(x, 0.02)).alias("tracked"), count(lambda x: (x["conf"] >= 0.50) & centred(x)).alias("seeds"))


def matched_pair(spark, d) -> DataFrame:
    """Both sides' detections by overlap of .20 or more, of equal ones the later; null unless both are found among two
    confident detections or more."""
    f = _detections(spark, d).withColumn("sure", F.transform(F.filter("dets", lambda x: x["conf"] >= 0.45), lambda x: x["box"]))
    best = lambda box, other: F.array_max(F.transform("sure", lambda x, j: F.struct(F.when(j == other, -1.0).otherwise(c.iou(x, box)).alias("iou"), j.alias("j"))))
    f = f.withColumn("a", best(F.col("mine"), F.lit(-1))).withColumn("b", best(F.col("theirs"), F.col("a.j")))
    ok = F.coalesce((F.size("sure") >= 2) & (F.col("a.iou") >= 0.20) & (F.col("b.iou") >= 0.20), F.lit(False))
    return f.select("session", "fi", F.when(ok, F.col("a.j")).alias("my_pick"), F.when(ok, F.col("b.j")).alias("op_pick"))


def near_candidates(spark, d) -> DataFrame:
    """Candidates within 3.5 heights of the nearer side, at least the two nearest; all where there are no more than two."""
    apart = lambda x, who: c.distance(c.box_centre(x["box"], 0), c.box_centre(x["box"], 1), c.box_centre(F.col(who), 0), c.box_centre(F.col(who), 1))
    f = _detections(spark, d).withColumn("ranked", F.array_sort(F.transform("dets", lambda x, j: F.struct(F.least(apart(x, "mine"), apart(x, "theirs")).alias("far"), j.alias("j")))))
    kept = F.filter("ranked", lambda r: r["far"] <= 0.05 * H * 3.5)
    kept = F.when(F.size(kept) < 2, F.slice("ranked", 1, 2)).otherwise(kept)
    return f.select("session", "fi", F.array_join(F.array_sort(F.transform(kept, lambda r: r["j"])), ",").alias("kept"))


def match_scores(spark, d) -> DataFrame:
    """Score of each detection as the next place of the own track, looks being its confidence."""
    f = _detections(spark, d).select("session", "fi", "mine", F.posexplode("dets").alias("j", "x"))
    return f.select("session", "fi", "j", r6(p.match_score(F.col("mine"), F.col("x.box"), F.when(F.col("j") != 1, F.col("x.conf")), F.lit(0.4 * H), 300.0), "score"))


def clinch_flags(spark, d) -> DataFrame:
    f = poses(spark, d)
    tall = F.lit(0.3)
    return f.select("session", "fi", p.clinch_by_width(F.col("my_bbox"), F.col("op_bbox")).alias("by_width"), p.clinch_by_height(F.col("my_bbox"), F.col("op_bbox"), tall).alias("by_height"), r6(c.iou(F.col("my_bbox"), F.col("op_bbox"), 0.25), "floored_iou"))


def blended_boxes(spark, d) -> DataFrame:
    """A third of the way from the own box to the other's, which stands in where one is missing; and whole pixels of it."""
    b = poses(spark, d).select("session", "fi", p.blended_box(F.col("my_bbox"), F.col("op_bbox"), F.lit(1 / 3)).alias("b")).withColumn("px", p.pixels(F.col("b"), W, H))
    return b.select("session", "fi", *(r6(F.get("b", k), n) for k, n in enumerate(("x1", "y1", "x2", "y2"))), *(F.get("px", k).alias(f"p{n}") for k, n in enumerate(("x1", "y1", "x2", "y2"))))


def pixel_zones(spark, d) -> DataFrame:
    """Head and belly zones in pixels, and whether a wrist of the other side reaches them, blocked or not."""
    f = poses(spark, d).where("my_bbox is not null and op_bbox is not null")
    f = f.select("session", "fi", *(p.pixel_points(F.col(f"{s}_kps"), W, H).alias(f"{s}_pts") for s in ("my", "op")), *(p.pixels(F.col(f"{s}_bbox"), W, H).alias(f"{s}_px") for s in ("my", "op")))
    rows = []
    for s, o in (("my", "op"), ("op", "my")):
        f = f.withColumns({f"{s}_head": p.pixel_head(F.col(f"{s}_pts"), F.col(f"{s}_px")), f"{s}_body": p.pixel_stomach(F.col(f"{s}_pts"), F.col(f"{s}_px"))})
        f = f.withColumns({f"{s}_h": p.wrist_contact(F.col(f"{s}_head"), F.col(f"{o}_pts"), F.col(f"{s}_pts"), 0.30), f"{s}_b": p.wrist_contact(F.col(f"{s}_body"), F.col(f"{o}_pts"), F.col(f"{s}_pts"), 0.25)})
        zone = lambda z, s=s: F.array_join(F.col(f"{s}_{z}"), ",")
        rows.append(F.struct(F.lit(s).alias("side"), zone("head").alias("head"), zone("body").alias("body"), F.col(f"{s}_h.hit").alias("head_hit"), F.col(f"{s}_h.blocked").alias("head_blocked"), F.col(f"{s}_b.hit").alias("body_hit"), F.col(f"{s}_b.blocked").alias("body_blocked")))
    return f.select("session", "fi", F.inline(F.array(*rows)))


def label_swaps(spark, d) -> DataFrame:
    """First of 5 frames running in which the sides' boxes would move far less if their labels were swapped; frames in
    which the two stand too close, or one is missing now or before, are no vote."""
    w = series.ordered(["session"])
    f = poses(spark, d).select("session", "fi", *(c.box_centre(F.col(f"{s}_bbox"), k).alias(f"{s}{a}") for s in ("my", "op") for k, a in ((0, "x"), (1, "y"))), *((F.get(f"{s}_bbox", 2) - F.get(f"{s}_bbox", 0)).alias(f"{s}w") for s in ("my", "op")))
    f = f.withColumns({f"p{n}": F.lag(n).over(w) for n in ("myx", "myy", "opx", "opy")})
    gap = lambda a, b: c.distance(F.col(f"{a}x"), F.col(f"{a}y"), F.col(f"{b}x"), F.col(f"{b}y"))
    keep, swap = gap("pmy", "my") + gap("pop", "op"), gap("pmy", "op") + gap("pop", "my")
    apart = gap("my", "op") >= (F.greatest(F.col("myw"), F.lit(0.001)) + F.greatest(F.col("opw"), F.lit(0.001))) / 4
    voted = f.withColumn("vote", F.coalesce(apart & (keep > 0) & (swap < keep * 0.65), F.lit(False)))
    runs = [series.first_run(voted, ["session"], F.col("vote"), n).withColumnRenamed("first_fi", f"run{n}") for n in (1, 2, 5)]
    return voted.groupBy("session").agg(F.count_if("vote").alias("votes")).join(runs[0], "session").join(runs[1], "session").join(runs[2], "session")


def heat_cells(spark, d) -> DataFrame:
    """Cells of a 400-cell map: the place along the width, and a depth from the box's height against the median one."""
    b = in_pixels(spark, d).select("session", "side", c.box_centre(F.col("px"), 0).alias("x"), (F.get("px", 3) - F.get("px", 1)).alias("h"))
    ref = b.groupBy("session").agg(F.expr("percentile(h, 0.5)").alias("ref"))
    whole = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(399.0)).cast("int")
    depth = c.clamp((F.col("h") / F.greatest(F.col("ref"), F.lit(1.0)) - 0.65) / 0.70)
    return b.join(ref, "session").groupBy("session", "side", whole(F.col("x") / W * 400).alias("gx"), whole(F.round((1 - depth) * 399, 9)).alias("gy")).agg(F.count(F.lit(1)).alias("n"))


def centre_markers(spark, d) -> DataFrame:
    b = sides(spark, d).withColumn("m", p.marker(c.box_centre(F.col("box"), 0) * 2 - 0.5, F.get("box", 3) * 1.5 - 0.5))
    return b.select("session", "fi", "side", r6(F.col("m.x"), "x"), r6(F.col("m.y"), "y"), F.col("m.text").alias("text"))


def even_picks(spark, d) -> DataFrame:
    """Eight evenly spaced frames of each session, all where it has no more."""
    n = poses(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    at = F.when(F.col("n") <= 8, F.sequence(F.lit(0), F.col("n").cast("int") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (k * ((F.col("n") - 1) / 7.0)).cast("int")))
    return poses(spark, d).select("session", "fi").join(n.select("session", F.explode(at).alias("fi")), ["session", "fi"])


def late_picks(spark, d) -> DataFrame:
    """Frames at fixed fractions, late ones denser, each once."""
    n = poses(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    at = F.array_distinct(F.array(*(F.bround(F.lit(f) * F.greatest(F.col("n") - 1, F.lit(1))).cast("int") for f in p.LATE_FRACTIONS)))
    return n.select("session", F.explode(at).alias("fi"))


def sampled_rows(spark, d) -> DataFrame:
    """Some forty rows of each session: every (n div 40)-th, all of a short one."""
    w = series.ordered(["session"])
    f = poses(spark, d).select("session", "fi").withColumns({"i": F.row_number().over(w) - 1, "step": F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy("session")) / 40))})
    return f.where(F.col("i") % F.col("step") == 0).select("session", "fi")


def session_list(spark, d) -> DataFrame:
    """Sessions, the latest first, with their length as a label and a frame rate corrected by the elapsed time."""
    s = signals(spark, d).groupBy("session").agg(F.max("us").alias("last"), (F.max("us") - F.min("us")).alias("span"), F.count(F.lit(1)).alias("n"))
    rate = p.corrected_rate(F.lit(15.0), F.col("n"), F.col("span") / 1e8)
    return s.select("session", F.row_number().over(Window.orderBy(F.desc("last"), "session")).alias("place"), p.time_label(F.col("span") / 1e6).alias("length"), r6(rate, "rate"), F.date_format(F.timestamp_micros(F.col("last")), "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"))


def safe_values(spark, d) -> DataFrame:
    """Values as text, not-a-number and infinity among them, read as positive numbers or 30."""
    v = F.when(F.col("kind") == "view", "NaN").when(F.col("kind") == "purchase", "Infinity").when(F.col("kind") == "click", (F.col("v") - 50).cast("string")).otherwise("none")
    return signals(spark, d).select("session", "fi", r6(p.safe_number(v, 30.0), "safe"))


def blocked_hosts(spark, d) -> DataFrame:
    """Pages by host, and whether a downloader refuses their address; every address also as a short link."""
    url = read(spark, d, "pages").select("page_id", F.explode(F.array("url", F.concat(F.lit("https://youtu.be/"), "page_id"))).alias("url"))
    return url.select("page_id", F.lower("url").alias("url"), p.is_blocked(F.col("url")).alias("blocked"))


def event_intensity(spark, d) -> DataFrame:
    """Purchases as punches: their force against the session's greatest, and its class."""
    e = signals(spark, d).where("kind = 'purchase'")
    v, kind = p.intensity(F.col("v"), F.max("v").over(Window.partitionBy("session")), (F.col("bucket") % 10) / 10)
    return e.select("session", "fi", r6(v, "force"), kind.alias("class"))


def landed_membership(spark, d) -> DataFrame:
    """Buckets with clicks thrown, and those of the frames that are in the session's set of purchases' next frames."""
    sig = signals(spark, d)
    landed = sig.where("kind = 'purchase'").select("session", (F.col("fi") + 1).alias("fi")).distinct()
    hit = sig.join(landed.withColumn("landed", F.lit(1)), ["session", "fi"], "left").groupBy("session", "bucket").agg(F.count_if(F.col("kind") == "click").alias("thrown"), F.coalesce(F.sum("landed"), F.lit(0)).alias("landed"))
    return hit.withColumn("effective", p.effective_punches(F.col("thrown"), F.col("landed")))


def merged_events(spark, d) -> DataFrame:
    """Both sides' purchases and clicks in one list by time, with their place in it."""
    sig = signals(spark, d)
    my, op = sig.where("kind = 'purchase'").select("session", "fi", F.lit("my").alias("who")), sig.where("kind = 'click'").select("session", "fi", F.lit("op").alias("who"))
    return my.unionByName(op).withColumn("place", F.row_number().over(series.ordered(["session"])))


def session_gates(spark, d) -> DataFrame:
    """Sessions with an error for too few rows, and whether they may be shown: enough rows and a purchase among them."""
    s = signals(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "purchase").alias("bought"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    few = F.col("n") < 60
    return s.select("session", F.when(few, F.concat(F.lit("too few frames: "), F.col("n"))).alias("error"), (~few & (F.col("bought") > 0)).alias("shown"), "kinds")


def tracked_counts(spark, d) -> DataFrame:
    f = poses(spark, d)
    ok = lambda s: c.shoulder_centre(F.col(f"{s}_kps"), 0).isNotNull()
    return f.groupBy("session").agg(F.count_if(ok("my")).alias("my_tracked"), F.count_if(ok("op")).alias("op_tracked"), F.count_if(ok("my") & ok("op")).alias("both"), F.count_if(ok("my") != F.coalesce(ok("op"), F.lit(False))).alias("one"))


QUERIES = {f.__name__: f for f in (
    box_scores, box_height_default, fallback_boxes, track_confidence, picker_scores, picker_order, detection_filters, matched_pair, near_candidates, match_scores, clinch_flags, blended_boxes, pixel_zones, label_swaps,
    heat_cells, centre_markers, even_picks, late_picks, sampled_rows, session_list, safe_values, blocked_hosts, event_intensity, landed_membership, merged_events, session_gates, tracked_counts,
)}

_PX = "px AS (SELECT session, fi, side, vis, x1 * 1280 AS x1, y1 * 720 AS y1, x2 * 1280 AS x2, y2 * 720 AS y2, kx0 IS NOT NULL AS first FROM pose)"
_RING = lambda b, at: f"(({b}x2 - {b}x1) * ({b}y2 - {b}y1) * greatest(0.05::DOUBLE, 1 - greatest(0, abs({at} - 0.5::DOUBLE) - 0.25::DOUBLE) * 5))"
_AB = "ab AS (SELECT a.session, a.fi, a.vis AS va, b.vis AS vb, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM px a JOIN px b ON a.session = b.session AND a.fi = b.fi AND b.side = 'op' WHERE a.side = 'my')"
_DETS = """det AS (SELECT session, fi, CAST(j AS INTEGER) AS j, CASE j WHEN 0 THEN bx1 + 4 WHEN 1 THEN (ax1 + bx1) / 2 ELSE ax1 - 4 END AS x1, CASE j WHEN 0 THEN by1 + 4 WHEN 1 THEN (ay1 + by1) / 2 ELSE ay1 - 4 END AS y1, CASE j WHEN 0 THEN bx2 + 4 WHEN 1 THEN (ax2 + bx2) / 2 ELSE ax2 - 4 END AS x2,
    CASE j WHEN 0 THEN by2 + 4 WHEN 1 THEN (ay2 + by2) / 2 ELSE ay2 - 4 END AS y2, CASE j WHEN 0 THEN vb WHEN 1 THEN (va + vb) / 2 ELSE va END AS conf, ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 FROM ab, range(3) r(j))"""


def _overlap(a: str, b: str, floor: str = "0") -> str:
    i = f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0))"
    size = lambda k: f"greatest(({k}x2 - {k}x1) * ({k}y2 - {k}y1), {floor})"
    return f"CASE WHEN {i} > 0 THEN {i} / ({size(a)} + {size(b)} - {i}) ELSE 0 END"


def _gap(a: str, b: str) -> str:
    return f"sqrt((({a}x1 + {a}x2) / 2 - ({b}x1 + {b}x2) / 2) ** 2 + (({a}y1 + {a}y2) / 2 - ({b}y1 + {b}y2) / 2) ** 2)"


def _pick(score: str) -> str:
    return f"SELECT session, fi, j, s FROM (SELECT *, {score} AS s FROM sure)"


_PTS = """pts AS (SELECT session, fi, side, i, CAST(trunc(x * 1280) AS INTEGER) AS x, CAST(trunc(y * 720) AS INTEGER) AS y FROM ok WHERE c >= 0.35::DOUBLE),
  pb AS (SELECT session, fi, side, CAST(trunc(x1 * 1280) AS INTEGER) AS bx1, CAST(trunc(y1 * 720) AS INTEGER) AS by1, CAST(trunc(x2 * 1280) AS INTEGER) AS bx2 FROM pose),
  two AS (SELECT session, fi FROM pose GROUP BY ALL HAVING count(*) = 2),
  zn AS (SELECT b.session, b.fi, b.side, any_value(bx1) AS bx1, any_value(by1) AS by1, any_value(bx2) AS bx2, sum(x) FILTER (WHERE i < 5) AS fs, count(x) FILTER (WHERE i < 5) AS fn, min(y) FILTER (WHERE i IN (5, 6)) AS sy, min(x) FILTER (WHERE i IN (5, 6)) AS sl, max(x) FILTER (WHERE i IN (5, 6)) AS sr, max(y) FILTER (WHERE i IN (11, 12)) AS hy
    FROM pb b JOIN two USING (session, fi) LEFT JOIN pts USING (session, fi, side) GROUP BY ALL),
  z2 AS (SELECT *, CAST(floor(fs / nullif(fn, 0)) AS INTEGER) AS hx, CAST(greatest(floor(greatest(sy - by1, 20) / 2), floor(trunc((bx2 - bx1) * 0.45::DOUBLE) / 2)) AS INTEGER) AS half, CAST(trunc((bx2 - bx1) * 0.40::DOUBLE) AS INTEGER) AS least_w FROM zn),
  z3 AS (SELECT *, CASE WHEN sr - sl < least_w THEN CAST(floor((sl + sr) / 2) - floor(least_w / 2) AS INTEGER) ELSE sl END AS lx, CASE WHEN sr - sl < least_w THEN CAST(floor((sl + sr) / 2) + floor(least_w / 2) AS INTEGER) ELSE sr END AS rx FROM z2),
  z4 AS (SELECT session, fi, side, CASE WHEN fn > 0 AND sy IS NOT NULL THEN [hx - half, by1, hx + half, sy] END AS head, CASE WHEN sy IS NOT NULL AND hy IS NOT NULL THEN [lx - greatest(4, CAST(trunc((rx - lx) * 0.10::DOUBLE) AS INTEGER)), sy + CAST(trunc((hy - sy) * 0.20::DOUBLE) AS INTEGER), rx + greatest(4, CAST(trunc((rx - lx) * 0.10::DOUBLE) AS INTEGER)), hy] END AS body FROM z3),
  zz AS (SELECT session, fi, side, 'head' AS zone, head AS z, 0.30::DOUBLE AS reach FROM z4 UNION ALL SELECT session, fi, side, 'body', body, 0.25::DOUBLE FROM z4),
  ct AS (SELECT z.session, z.fi, z.side, zone, bool_or(coalesce(near, false)) AS blocked, bool_or(NOT coalesce(near, false)) AS hit FROM (
    SELECT z.session, z.fi, z.side, z.zone, w.i, bool_or(sqrt((g.x - w.x) ** 2 + (g.y - w.y) ** 2) < greatest(20, z.z[3] - z.z[1]) * z.reach) AS near FROM zz z JOIN pts w ON w.session = z.session AND w.fi = z.fi AND w.side <> z.side AND w.i IN (9, 10) AND w.x BETWEEN z.z[1] AND z.z[3] AND w.y BETWEEN z.z[2] AND z.z[4]
      LEFT JOIN pts g ON g.session = z.session AND g.fi = z.fi AND g.side = z.side AND g.i IN (7, 8, 9, 10) GROUP BY ALL) z GROUP BY ALL)"""
_CENTRE = "(y1 + y2) / 2 / 1280"
_SIG = lambda body, *more: "WITH " + ", ".join([SIGNALS_SQL, *more]) + " " + body
ORACLES = {
    "box_scores": _q(f"SELECT session, fi, side, round({_RING('', '(x1 + x2) / 2 / 1280')}, 6) AS ring, round({_RING('', _CENTRE)}, 6) AS portrait_ring, round(CASE WHEN (y2 - y1) / 288 < 0.55::DOUBLE THEN greatest(0.05::DOUBLE, (y2 - y1) / 288 / 0.55::DOUBLE) WHEN (y2 - y1) / 288 > 1.8::DOUBLE THEN greatest(0.3::DOUBLE, 1.8::DOUBLE / ((y2 - y1) / 288)) ELSE 1 END, 6) AS size, (x1 + x2) / 2 / 1280 < 0.18::DOUBLE OR (x1 + x2) / 2 / 1280 > 0.82::DOUBLE AS on_ropes, round((y2 - y1) / 720, 6) AS height FROM px", _PX),
    "box_height_default": _q("SELECT f.session, f.fi, s.side, round(coalesce(y2 - y1, 0.3::DOUBLE), 6) AS h FROM (SELECT DISTINCT session, fi FROM pose) f CROSS JOIN (VALUES ('my'), ('op')) s(side) LEFT JOIN pose p ON p.session = f.session AND p.fi = f.fi AND p.side = s.side"),
    "fallback_boxes": _q("SELECT session, fi, side, CAST(trunc(x - 96) AS INTEGER) AS x1, CAST(trunc(y - 144) AS INTEGER) AS y1, CAST(trunc(x + 96) AS INTEGER) AS x2, CAST(trunc(y + 144) AS INTEGER) AS y2, round(greatest(4, y - 60), 6) AS head_y, round(least(716, y + 45), 6) AS belly_y FROM (SELECT session, fi, side, (x1 + x2) * 0.5::DOUBLE AS x, (y1 + y2) * 0.5::DOUBLE AS y FROM px)", _PX),
    "track_confidence": _q("SELECT session, fi, side, round(greatest(0, 1 - (17 - round(vis * 17)) * 0.2::DOUBLE) * CASE WHEN first THEN 1 ELSE 0.85::DOUBLE END, 6) AS confidence, round(vis * 17) = 17 AND first AS reliable FROM px", _PX),
    "picker_scores": _q(f"SELECT a.session, a.fi, round({_gap('a.', 'b.')} / 1280 * (1 - ({_overlap('a.', 'b.')})) * ((a.s + b.s) / (1280 * 720 * 2)), 6) AS score FROM rk a JOIN rk b ON a.session = b.session AND a.fi = b.fi AND a.r = 1 AND b.r = 2", _PX, _AB, _DETS, f"rk AS (SELECT *, row_number() OVER (PARTITION BY session, fi ORDER BY s DESC, j) AS r FROM (SELECT *, {_RING('', '(x1 + x2) / 2 / 1280')} AS s FROM det))"),
    "detection_filters": _q("SELECT session, fi, CAST(count(*) FILTER (WHERE conf >= 0.3::DOUBLE AND (x2 - x1) * (y2 - y1) >= 0.01::DOUBLE * 1280 * 720) AS INTEGER) AS picker, CAST(count(*) FILTER (WHERE conf >= 0.45::DOUBLE AND (x2 - x1) * (y2 - y1) >= 0.02::DOUBLE * 1280 * 720) AS INTEGER) AS tracked, CAST(count(*) FILTER (WHERE conf >= 0.5::DOUBLE AND (x1 + x2) / 2 > 0.08::DOUBLE * 1280 AND (x1 + x2) / 2 < 0.92::DOUBLE * 1280) AS INTEGER) AS seeds FROM det GROUP BY ALL", _PX, _AB, _DETS),
    "matched_pair": _q("SELECT session, fi, CASE WHEN n >= 2 AND m.s >= 0.2::DOUBLE AND o.s >= 0.2::DOUBLE THEN m.j END AS my_pick, CASE WHEN n >= 2 AND m.s >= 0.2::DOUBLE AND o.s >= 0.2::DOUBLE THEN o.j END AS op_pick FROM ab LEFT JOIN (SELECT session, fi, count(*) AS n FROM sure GROUP BY ALL) USING (session, fi) LEFT JOIN m USING (session, fi) LEFT JOIN o USING (session, fi)", _PX, _AB, _DETS,
        "sure AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY session, fi ORDER BY j) - 1 AS INTEGER) AS j) FROM det WHERE conf >= 0.45::DOUBLE)",
        f"m AS (SELECT session, fi, j, s FROM (SELECT *, row_number() OVER (PARTITION BY session, fi ORDER BY s DESC, j DESC) AS r FROM (SELECT *, {_overlap('', 'a')} AS s FROM sure)) WHERE r = 1)",
        f"o AS (SELECT session, fi, j, s FROM (SELECT *, row_number() OVER (PARTITION BY session, fi ORDER BY s DESC, j DESC) AS r FROM (SELECT sure.*, {_overlap('', 'b')} AS s FROM sure JOIN m ON m.session = sure.session AND m.fi = sure.fi AND m.j <> sure.j)) WHERE r = 1)"),
    "near_candidates": _q("SELECT session, fi, array_to_string(list_sort(CASE WHEN count(*) FILTER (WHERE far <= 126) < 2 THEN list(j) FILTER (WHERE r <= 2) ELSE list(j) FILTER (WHERE far <= 126) END), ',') AS kept FROM (SELECT *, row_number() OVER (PARTITION BY session, fi ORDER BY far, j) AS r FROM nd) GROUP BY ALL", _PX, _AB, _DETS, f"nd AS (SELECT session, fi, j, least({_gap('', 'a')}, {_gap('', 'b')}) AS far FROM det)"),
    "match_scores": _q("SELECT session, fi, j, round((0.28::DOUBLE * CASE WHEN o > 0 THEN o ELSE greatest(0, 1 - g / 300) * 0.25::DOUBLE END + 0.72::DOUBLE * CASE WHEN j <> 1 THEN conf ELSE 0.5::DOUBLE END) * CASE WHEN h < 0.55::DOUBLE THEN greatest(0.05::DOUBLE, h / 0.55::DOUBLE) WHEN h > 1.8::DOUBLE THEN greatest(0.3::DOUBLE, 1.8::DOUBLE / h) ELSE 1 END, 6) AS score FROM ms", _PX, _AB, _DETS, f"ms AS (SELECT session, fi, j, conf, {_overlap('', 'a')} AS o, {_gap('', 'a')} AS g, (y2 - y1) / 288 AS h FROM det)"),
    "clinch_flags": _q(f"SELECT a.session, a.fi, coalesce({_gap('a.', 'b.')} < (a.x2 - a.x1 + b.x2 - b.x1) / 4, false) AS by_width, coalesce(b.x1 IS NOT NULL AND {_overlap('a.', 'b.')} > 0.2::DOUBLE OR {_gap('a.', 'b.')} < 0.3::DOUBLE * 0.55::DOUBLE, false) AS by_height, round(CASE WHEN b.x1 IS NULL THEN 0 ELSE {_overlap('a.', 'b.', '0.25::DOUBLE')} END, 6) AS floored_iou FROM pose a LEFT JOIN pose b ON a.session = b.session AND a.fi = b.fi AND b.side = 'op' WHERE a.side = 'my'"),
    "blended_boxes": _q("SELECT session, fi, " + ", ".join(f"round({n}, 6) AS {n}, CAST(trunc({n} * {k}) AS INTEGER) AS p{n}" for n, k in (("x1", 1280), ("y1", 720), ("x2", 1280), ("y2", 720))) + " FROM (SELECT a.session, a.fi, " + ", ".join(f"coalesce(a.{n} + (b.{n} - a.{n}) * (1.0::DOUBLE / 3), a.{n}) AS {n}" for n in ("x1", "y1", "x2", "y2")) + " FROM pose a LEFT JOIN pose b ON a.session = b.session AND a.fi = b.fi AND b.side = 'op' WHERE a.side = 'my')"),
    "pixel_zones": _q("SELECT z4.session, z4.fi, z4.side, array_to_string(head, ',') AS head, array_to_string(body, ',') AS body, coalesce(h.hit, false) AS head_hit, coalesce(h.blocked, false) AS head_blocked, coalesce(b.hit, false) AS body_hit, coalesce(b.blocked, false) AS body_blocked FROM z4 LEFT JOIN ct h ON h.session = z4.session AND h.fi = z4.fi AND h.side = z4.side AND h.zone = 'head' LEFT JOIN ct b ON b.session = z4.session AND b.fi = z4.fi AND b.side = z4.side AND b.zone = 'body'", _PTS),
    "label_swaps": _q("SELECT v.session, count(*) FILTER (WHERE vote) AS votes, any_value(r1.fi) AS run1, any_value(r2.fi) AS run2, any_value(r5.fi) AS run5 FROM vt v LEFT JOIN (SELECT session, min(fi) AS fi FROM rn WHERE n >= 1 GROUP BY 1) r1 USING (session) LEFT JOIN (SELECT session, min(fi) AS fi FROM rn WHERE n >= 2 GROUP BY 1) r2 USING (session) LEFT JOIN (SELECT session, min(fi) AS fi FROM rn WHERE n >= 5 GROUP BY 1) r5 USING (session) GROUP BY v.session",
        "cc AS (SELECT a.session, a.fi, a.cx AS mx, a.cy AS my, b.cx AS ox, b.cy AS oy, a.x2 - a.x1 AS mw, b.x2 - b.x1 AS ow FROM body a LEFT JOIN body b ON a.session = b.session AND a.fi = b.fi AND b.side = 'op' WHERE a.side = 'my')",
        "lg AS (SELECT *, lag(mx) OVER w AS pmx, lag(my) OVER w AS pmy, lag(ox) OVER w AS pox, lag(oy) OVER w AS poy FROM cc WINDOW w AS (PARTITION BY session ORDER BY fi))",
        "vt AS (SELECT session, fi, coalesce(sqrt((mx - ox) ** 2 + (my - oy) ** 2) >= (greatest(mw, 0.001::DOUBLE) + greatest(ow, 0.001::DOUBLE)) / 4 AND k > 0 AND s < k * 0.65::DOUBLE, false) AS vote FROM (SELECT *, sqrt((pmx - mx) ** 2 + (pmy - my) ** 2) + sqrt((pox - ox) ** 2 + (poy - oy) ** 2) AS k, sqrt((pmx - ox) ** 2 + (pmy - oy) ** 2) + sqrt((pox - mx) ** 2 + (poy - my) ** 2) AS s FROM lg))",
        "rn AS (SELECT session, min(fi) AS fi, count(*) AS n FROM (SELECT *, fi - row_number() OVER (PARTITION BY session ORDER BY fi) AS g FROM vt WHERE vote) GROUP BY session, g)"),
    "heat_cells": _q("SELECT session, side, CAST(trunc(least(greatest((x1 + x2) * 0.5::DOUBLE / 1280 * 400, 0), 399)) AS INTEGER) AS gx, CAST(trunc(least(greatest(round((1 - least(greatest(((y2 - y1) / greatest(ref, 1) - 0.65::DOUBLE) / 0.70::DOUBLE, 0), 1)) * 399, 9), 0), 399)) AS INTEGER) AS gy, count(*) AS n FROM px JOIN (SELECT session, quantile_cont(y2 - y1, 0.5) AS ref FROM px GROUP BY session) USING (session) GROUP BY ALL", _PX),
    "centre_markers": _q("SELECT session, fi, side, round(CASE WHEN o THEN x ELSE least(greatest(x, 0.03::DOUBLE), 0.97::DOUBLE) END, 6) AS x, round(CASE WHEN o THEN y ELSE least(greatest(y, 0.05::DOUBLE), 0.95::DOUBLE) END, 6) AS y, CASE WHEN NOT o THEN 'CENTER off ' || CASE WHEN x > 1 THEN '→' WHEN x < 0 THEN '←' ELSE '' END || CASE WHEN y > 1 THEN '↓' WHEN y < 0 THEN '↑' ELSE '' END END AS text FROM (SELECT *, x BETWEEN -0.02::DOUBLE AND 1.02::DOUBLE AND y BETWEEN -0.02::DOUBLE AND 1.02::DOUBLE AS o FROM (SELECT session, fi, side, cx * 2 - 0.5::DOUBLE AS x, y2 * 1.5::DOUBLE - 0.5::DOUBLE AS y FROM body))"),
    "even_picks": _q("SELECT DISTINCT session, CAST(CASE WHEN n <= 8 THEN k ELSE trunc(k * ((n - 1) / 7.0::DOUBLE)) END AS INTEGER) AS fi FROM (SELECT session, count(DISTINCT fi) AS n FROM pose GROUP BY session), range(8) r(k) WHERE n > 8 OR k < n"),
    "late_picks": _q("SELECT DISTINCT session, CAST(round_even(f * greatest(n - 1, 1), 0) AS INTEGER) AS fi FROM (SELECT session, count(DISTINCT fi) AS n FROM pose GROUP BY session), (VALUES (0.10::DOUBLE), (0.30::DOUBLE), (0.55::DOUBLE), (0.80::DOUBLE), (0.92::DOUBLE), (0.99::DOUBLE)) v(f)"),
    "sampled_rows": _q("SELECT session, fi FROM (SELECT session, fi, row_number() OVER (PARTITION BY session ORDER BY fi) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY session) // 40) AS step FROM (SELECT DISTINCT session, fi FROM pose)) WHERE i % step = 0"),
    "session_list": _SIG("SELECT session, CAST(row_number() OVER (ORDER BY last DESC, session) AS INTEGER) AS place, CAST(span // 60000000 AS VARCHAR) || ':' || lpad(CAST(span // 1000000 % 60 AS VARCHAR), 2, '0') AS length, round(CASE WHEN span / 1e8 > 500 AND n > 10 AND n / (span / 1e8 / 1000.0::DOUBLE) > 10 AND n / (span / 1e8 / 1000.0::DOUBLE) < 240 THEN n / (span / 1e8 / 1000.0::DOUBLE) ELSE 15 END, 6) AS rate, strftime(make_timestamp(last), '%Y-%m-%dT%H:%M:%S') AS stamp FROM (SELECT session, max(us) AS last, max(us) - min(us) AS span, count(*) AS n FROM sig GROUP BY session)"),
    "safe_values": _SIG("SELECT session, fi, round(CASE WHEN kind = 'click' AND v - 50 > 0 THEN v - 50 ELSE 30 END, 6) AS safe FROM sig"),
    "blocked_hosts": "SELECT page_id, lower(u) AS url, u LIKE '%youtube.com%' OR u LIKE '%youtu.be%' AS blocked FROM (SELECT page_id, url AS u FROM pages UNION ALL SELECT page_id, 'https://youtu.be/' || page_id FROM pages)",
    "event_intensity": _SIG("SELECT session, fi, round(f, 6) AS force, CASE WHEN f > 0.65 THEN 'HARD' WHEN f > 0.35 THEN 'MED' ELSE 'LIGHT' END AS class FROM (SELECT session, fi, 0.6::DOUBLE * (v / (max(v) OVER (PARTITION BY session) + 1e-9::DOUBLE)) + 0.4::DOUBLE * (bucket % 10 / 10.0::DOUBLE) AS f FROM sig WHERE kind = 'purchase')"),
    "landed_membership": _SIG("SELECT s.session, bucket, count(*) FILTER (WHERE kind = 'click') AS thrown, CAST(count(l.fi) AS BIGINT) AS landed, 3 * count(l.fi) + greatest(0, count(*) FILTER (WHERE kind = 'click') - count(l.fi)) AS effective FROM sig s LEFT JOIN (SELECT DISTINCT session, fi + 1 AS fi FROM sig WHERE kind = 'purchase') l ON l.session = s.session AND l.fi = s.fi GROUP BY ALL"),
    "merged_events": _SIG("SELECT session, fi, CASE kind WHEN 'purchase' THEN 'my' ELSE 'op' END AS who, CAST(row_number() OVER (PARTITION BY session ORDER BY fi) AS INTEGER) AS place FROM sig WHERE kind IN ('purchase', 'click')"),
    "session_gates": _SIG("SELECT session, CASE WHEN count(*) < 60 THEN 'too few frames: ' || count(*) END AS error, count(*) >= 60 AND count(*) FILTER (WHERE kind = 'purchase') > 0 AS shown, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM sig GROUP BY session"),
    "tracked_counts": _q("SELECT session, count(*) FILTER (WHERE a) AS my_tracked, count(*) FILTER (WHERE b) AS op_tracked, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a <> b) AS one FROM (SELECT session, fi, bool_or(side = 'my' AND scx IS NOT NULL) AS a, bool_or(side = 'op' AND scx IS NOT NULL) AS b FROM body GROUP BY ALL) GROUP BY session"),
}
ORACLES["picker_order"] = ORACLES["picker_scores"].replace("SELECT a.session, a.fi, round", "SELECT session, fi, CAST(row_number() OVER w - 1 AS INTEGER) AS place, CAST(row_number() OVER w % count(*) OVER (PARTITION BY session) AS INTEGER) AS next_place, row_number() OVER w = 1 AS best FROM (SELECT a.session, a.fi, round", 1) + ") WINDOW w AS (PARTITION BY session ORDER BY score DESC, fi)"
