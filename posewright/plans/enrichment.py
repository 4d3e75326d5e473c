"""Enriched frames: sparse tracks laid on every frame, detections dealt to them, and identities put right on the way.

Tracks of both fighters come every few frames and are interpolated side by side (J2, one sort of a union). Detections go
to the two boxes by overlap, mine first (J13). Whoever leaves a clinch, and whoever is seen again after a while, is held
against how both looked before (ST6); if they look exchanged, all later frames are exchanged too, which changes who
chooses first.

That feedback has two states only. So each frame is dealt twice, once for each state, and everything that a decision needs
is told for both by windows: the looks when the clinch began, and the reference looks, whose frame comes before any
periodic check and is found by a scan of the clinches alone (operators/scans.py). What is left for a fold is the state and
the time of the last check.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posewright.fixtures import POSES_SQL, SIGNALS_SQL, poses, signals
from posewright.functions import columns as c
from posewright.functions.perception import blended_box, clinch_by_width
from posewright.operators import asof, folds, geometry, scans

# fixed values: least overlap of a detection, and margins and period of the identity checks
LEAST_OVERLAP = 0.15
CLINCH_MARGIN, REID_MARGIN, REID_PERIOD_S = 0.15, 0.05, 1.5


def by_frame():
    return Window.partitionBy("session").orderBy("fi")


def centred(look: Column) -> Column:
    """A histogram without its mean and of length one, so that the correlation of two is their inner product."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    even = F.transform(look, lambda x: x - total(look) / F.size(look))
    return F.transform(even, lambda x: F.try_divide(x, F.sqrt(total(F.transform(even, lambda y: y * y)))))


def alike(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def on_frames(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """frames with my_box and op_box between the tracks around them; a side that one of them lacks takes the other's."""
    boxes = tracks.select("session", "fi", F.struct("my", "op").alias("boxes"))
    f = asof.bracket(frames, boxes, "session", "fi", "boxes")
    t = F.coalesce(F.try_divide((F.col("fi") - F.col("_prev_at")).cast("double"), (F.col("_next_at") - F.col("_prev_at")).cast("double")), F.lit(0.0))
    return f.withColumns({f"{s}_box": blended_box(F.col("_prev")[s], F.col("_next")[s], t) for s in ("my", "op")}).drop("_prev", "_prev_at", "_next", "_next_at")


def dealt_both_ways(f: DataFrame) -> DataFrame:
    """Adds m0, o0, m1, o1: places of the detections of both fighters where nothing, and where everything, is exchanged."""
    boxes = f.withColumn("_boxes", F.transform("dets", lambda x: x["box"]))
    for s, (a, b) in enumerate((("my_box", "op_box"), ("op_box", "my_box"))):
        boxes = geometry.greedy_pair(boxes, ["session"], "_boxes", F.col(a), F.col(b), LEAST_OVERLAP).withColumnsRenamed({"my_pick": f"m{s}", "op_pick": f"o{s}"})
    return boxes.drop("_boxes")


def sums(mine: Column, other: Column, my_ref: Column, op_ref: Column) -> tuple[Column, Column]:
    """Likeness as the two are, and exchanged; null where a look is missing."""
    return alike(my_ref, mine) + alike(op_ref, other), alike(my_ref, other) + alike(op_ref, mine)


def checks(f: DataFrame) -> DataFrame:
    """Adds for both states s: exit{s} and reid{s} (same, swap, turn), and ready{s}, whether a periodic check may take place."""
    w = by_frame()
    held = w.rowsBetween(Window.unboundedPreceding, -1)
    look = lambda pick: F.get(F.transform("dets", lambda x: x["look"]), F.col(pick))
    f = f.withColumns({f"{p}{s}_look": look(f"{p}{s}") for p in "mo" for s in "01"})
    f = f.withColumn("clinch", clinch_by_width(F.col("my_box"), F.col("op_box"))).withColumn("_was", F.coalesce(F.lag("clinch").over(w), F.lit(False)))
    leaves, enters = ~F.col("clinch") & F.col("_was"), F.col("clinch") & ~F.col("_was")
    verdict = lambda same, swap, margin: F.struct(same.alias("same"), swap.alias("swap"), F.coalesce(swap > same + margin, F.lit(False)).alias("turn"))
    for s in "01":
        pair = F.struct(F.col(f"m{s}_look").alias("m"), F.col(f"o{s}_look").alias("o"))
        f = f.withColumn(f"_before{s}", F.last(F.when(enters, pair), ignorenulls=True).over(held))
        then = F.col(f"_before{s}")
        told = verdict(*sums(F.col(f"m{s}_look"), F.col(f"o{s}_look"), then["m"], then["o"]), CLINCH_MARGIN)
        f = f.withColumn(f"exit{s}", F.when(leaves, told))
    turns = [F.coalesce(F.col(f"exit{s}")["turn"], F.lit(False)) for s in "01"]
    f = scans.two_states(f, ["session"], "fi", turns[0], ~turns[1], "_exits")
    start = F.coalesce(F.lag("_exits").over(w), F.lit(False))
    known = lambda s: F.col(f"m{s}_look").isNotNull() & F.col(f"o{s}_look").isNotNull() & ~F.col("clinch")
    first = F.when(start, F.when(known("1"), F.struct(F.col("m1_look").alias("m"), F.col("o1_look").alias("o")))).otherwise(F.when(known("0"), F.struct(F.col("m0_look").alias("m"), F.col("o0_look").alias("o"))))
    f = f.withColumn("_first", first).withColumn("_ref", F.first("_first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    for s, turn in zip("01", turns):
        # a frame that has just been turned has its picks exchanged, but is not dealt anew
        mine, other = (F.when(turn, F.col(f"{b}{s}_look")).otherwise(F.col(f"{a}{s}_look")) for a, b in (("m", "o"), ("o", "m")))
        f = f.withColumn(f"reid{s}", verdict(*sums(mine, other, F.col("_ref")["m"], F.col("_ref")["o"]), REID_MARGIN))
        f = f.withColumn(f"ready{s}", ~F.col("clinch") & F.col("_ref").isNotNull() & F.col(f"m{s}").isNotNull() & F.col(f"o{s}").isNotNull())
    return f.drop("_was", "_before0", "_before1", "_exits", "_first", "_ref", *(f"{p}{s}_look" for p in "mo" for s in "01"))


def identities(told: DataFrame, period: float = REID_PERIOD_S) -> DataFrame:
    """Adds began, exit_turn, checked, reid_turn: the state that a frame began in and what turned it. All other columns go
    through the fold, so that what was told for both states is not told again to be joined."""

    def start(n: int) -> folds.State:
        return {"swapped": np.zeros(n, bool), "last": np.full(n, -np.inf)}

    def step(state: folds.State, at: np.ndarray, row: folds.State) -> folds.State:
        began = state["swapped"][at]
        of = lambda name: np.where(began, row[f"{name}1"], row[f"{name}0"]) > 0
        left = of("_exit")
        checked = of("_ready") & (row["_t"] - state["last"][at] >= period)
        turned = checked & of("_reid")
        state["last"][at] = np.where(checked, row["_t"], state["last"][at])
        state["swapped"][at] = began ^ left ^ turned
        return {"began": began, "exit_turn": left, "checked": checked, "reid_turn": turned}

    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    rows = told.withColumns({"_t": F.col("time_s")} | {f"_{n}{s}": flag(F.col(f"{n}{s}")["turn"]) for n in ("exit", "reid") for s in "01"} | {f"_ready{s}": flag(F.col(f"ready{s}")) for s in "01"})
    asked = ["_t", *(f"_{n}{s}" for n in ("exit", "reid", "ready") for s in "01")]
    kept = [c for c in told.columns if c not in ("session", "fi")]
    return folds.lockstep(rows, ["session"], "fi", asked, start, step, "began boolean, exit_turn boolean, checked boolean, reid_turn boolean", kept)


def enrich(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """(session, fi, time_s, my_box, op_box, my_pick, op_pick, clinch, swapped, exit, reid), one row a frame.

    frames: (session, fi, time_s, dets array of (box, look)); tracks: (session, fi, my, op). exit and reid hold the
    likenesses (same, swap) of the checks that turned the identities, else null."""
    looks = frames.withColumn("dets", F.transform("dets", lambda x: F.struct(x["box"].alias("box"), centred(x["look"]).alias("look"))))
    f = identities(checks(dealt_both_ways(on_frames(looks, tracks))).drop("dets"))
    of = lambda name: F.when(F.col("began"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    turned = F.col("exit_turn") != F.col("reid_turn")
    swapped = F.col("began") != turned
    pick = lambda a, b: F.when(turned, of(b)).otherwise(of(a))
    why = lambda name: F.when(F.col(f"{name}_turn"), F.struct(*(of(name)[x].alias(x) for x in ("same", "swap"))))
    box = lambda a, b: F.when(swapped, F.col(b)).otherwise(F.col(a))
    return f.select("session", "fi", "time_s", box("my_box", "op_box").alias("my_box"), box("op_box", "my_box").alias("op_box"), pick("m", "o").alias("my_pick"), pick("o", "m").alias("op_pick"), "clinch", swapped.alias("swapped"), why("exit").alias("exit"), why("reid").alias("reid"))


def swaps(enriched: DataFrame) -> DataFrame:
    """(session, time_s, reason, same, swap): what turned the identities, two rows where both did."""
    events = F.array(*(F.struct(F.lit(reason).alias("reason"), F.col(n).alias("e")) for reason, n in (("clinch_exit", "exit"), ("periodic_reid", "reid"))))
    rows = enriched.select("session", "fi", F.round("time_s", 2).alias("time_s"), F.explode(F.filter(events, lambda x: x["e"].isNotNull())).alias("x"))
    return rows.select("session", "fi", "time_s", "x.reason", F.round("x.e.same", 3).alias("same"), F.round("x.e.swap", 3).alias("swap"))


def footage(spark, d) -> tuple[DataFrame, DataFrame]:
    """The poses view as detections, three frames a second, and as tracks of every third frame."""
    p = poses(spark, d)
    det = lambda s: F.struct(F.col(f"{s}_bbox").alias("box"), F.transform(f"{s}_kps", lambda k: k[2]).alias("look"))
    mine, other = F.when(c.visibility(F.col("my_kps")) >= 0.5, det("my")), F.when(F.col("op_bbox").isNotNull(), det("op"))
    dets = F.filter(F.when(F.col("fi") % 2 == 0, F.array(mine, other)).otherwise(F.array(other, mine)), lambda x: x.isNotNull())
    return p.select("session", "fi", (F.col("fi") / 3.0).alias("time_s"), dets.alias("dets")), p.where("fi % 3 = 0").select("session", "fi", F.col("my_bbox").alias("my"), F.col("op_bbox").alias("op"))


def enriched_frames(spark, d) -> DataFrame:
    e = enrich(*footage(spark, d))
    return e.select("session", "fi", "clinch", "swapped", F.col("my_pick").cast("int").alias("my_pick"), F.col("op_pick").cast("int").alias("op_pick"), *(F.round(F.get(f"{s}_box", k), 6).alias(f"{s}{k}") for s in ("my", "op") for k in range(4)))


def swap_events(spark, d) -> DataFrame:
    return swaps(enrich(*footage(spark, d)))


def identity_toggle(spark, d) -> DataFrame:
    """Identities over clinches that an error stands for, by a scan of maps on two states alone."""
    sig = signals(spark, d)
    leaves = (F.lag("kind").over(by_frame()) == "error") & (F.col("kind") != "error")
    same, swap = F.col("v") / 100, 1 - F.col("v") / 100
    turn = lambda a, b: F.coalesce(leaves & (b > a + CLINCH_MARGIN), F.lit(False))
    return scans.two_states(sig, ["session"], "fi", turn(same, swap), ~turn(swap, same), "swapped").select("session", "fi", "swapped")


QUERIES = {f.__name__: f for f in (enriched_frames, swap_events, identity_toggle)}

_DEALT = ", ".join(
    f"p{s} AS (SELECT f.session, f.fi, arg_min(j, [-iou, j]) AS m FROM frm f JOIN ov USING (session, fi) WHERE who = '{a}' AND iou > 0.15::DOUBLE GROUP BY ALL), "
    f"q{s} AS (SELECT f.session, f.fi, any_value(p.m) AS m, arg_min(j, [-iou, j]) FILTER (WHERE who = '{b}' AND iou > 0.15::DOUBLE AND j IS DISTINCT FROM p.m) AS o FROM frm f LEFT JOIN p{s} p USING (session, fi) LEFT JOIN ov USING (session, fi) GROUP BY ALL)"
    for s, (a, b) in enumerate((("my", "op"), ("op", "my"))))
_BOX = ("x1", "y1", "x2", "y2")
_CASE = lambda s, a, b: f"CASE WHEN {s} THEN {a} ELSE {b} END"
_FRAMES = f"""look AS (SELECT session, fi, side, [x / n FOR x IN z] AS look FROM (SELECT *, sqrt(list_sum([x * x FOR x IN z])) AS n FROM (SELECT session, fi, side, [x - m FOR x IN l] AS z FROM (SELECT session, fi, side, list(c ORDER BY i) AS l, avg(c) AS m FROM kp GROUP BY ALL)))),
  det AS (SELECT *, CAST(row_number() OVER (PARTITION BY session, fi ORDER BY (side = 'op') <> (fi % 2 = 1)) - 1 AS INTEGER) AS j FROM (SELECT p.session, p.fi, p.side, x1, y1, x2, y2, look FROM pose p JOIN look USING (session, fi, side) WHERE side = 'op' OR vis >= 0.5)),
  trk AS (SELECT p.session, p.fi, p.side, x1, y1, x2, y2 FROM pose p WHERE fi % 3 = 0),
  fi0 AS (SELECT DISTINCT session, fi FROM pose),
  br AS (SELECT f.session, f.fi, max(t.fi) FILTER (WHERE t.fi <= f.fi) AS a, min(t.fi) FILTER (WHERE t.fi >= f.fi) AS b FROM fi0 f JOIN (SELECT DISTINCT session, fi FROM trk) t ON t.session = f.session GROUP BY ALL),
  tb AS (SELECT br.session, br.fi, s.who, {", ".join(f"CASE WHEN p.{k} IS NULL OR br.b IS NULL THEN coalesce(p.{k}, n.{k}) WHEN n.{k} IS NULL OR br.a = br.b THEN p.{k} ELSE p.{k} + (n.{k} - p.{k}) * ((br.fi - br.a) / (br.b - br.a)::DOUBLE) END AS {k}" for k in _BOX)}
    FROM br CROSS JOIN (VALUES ('my'), ('op')) s(who) LEFT JOIN trk p ON p.session = br.session AND p.fi = br.a AND p.side = who LEFT JOIN trk n ON n.session = br.session AND n.fi = br.b AND n.side = who),
  frm AS (SELECT m.session, m.fi, {", ".join(f"m.{k} AS m{k}, o.{k} AS o{k}" for k in _BOX)},
    coalesce(sqrt(((m.x1 + m.x2 - o.x1 - o.x2) / 2) ** 2 + ((m.y1 + m.y2 - o.y1 - o.y2) / 2) ** 2) < (m.x2 - m.x1 + o.x2 - o.x1) / 4, false) AS clinch FROM tb m JOIN tb o ON o.session = m.session AND o.fi = m.fi AND o.who = 'op' WHERE m.who = 'my'),
  ovl AS (SELECT t.session, t.fi, who, j, greatest(least(t.x2, d.x2) - greatest(t.x1, d.x1), 0) * greatest(least(t.y2, d.y2) - greatest(t.y1, d.y1), 0) AS i, (t.x2 - t.x1) * (t.y2 - t.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) AS u FROM tb t JOIN det d USING (session, fi) WHERE t.x1 IS NOT NULL),
  ov AS (SELECT session, fi, who, j, i / (u - i) AS iou FROM ovl), {_DEALT},
  fr AS (SELECT f.*, fi / 3.0::DOUBLE AS t, {", ".join(f"q{s}.m AS m{s}, q{s}.o AS o{s}, dm{s}.look AS lm{s}, do{s}.look AS lo{s}" for s in (0, 1))} FROM frm f
    {" ".join(f"JOIN q{s} USING (session, fi) LEFT JOIN det dm{s} ON dm{s}.session = f.session AND dm{s}.fi = f.fi AND dm{s}.j = q{s}.m LEFT JOIN det do{s} ON do{s}.session = f.session AND do{s}.fi = f.fi AND do{s}.j = q{s}.o" for s in (0, 1))})"""
_DOT = lambda a, b: f"list_inner_product({a}, {b})"
_WALK = f"""nil AS (SELECT CAST(NULL AS DOUBLE[]) AS n),
  walk AS (SELECT session, -1 AS fi, false AS s3, false AS began, false AS d, false AS g, false AS inc, n AS pm, n AS po, n AS rm, n AS ro, -1e9::DOUBLE AS last, NULL::DOUBLE AS es, NULL::DOUBLE AS ew, NULL::DOUBLE AS rs, NULL::DOUBLE AS rw FROM (SELECT DISTINCT session FROM fr), nil UNION ALL
    SELECT session, fi, (s <> d) <> g, s, d, g, clinch, pm, po, rm, ro, CASE WHEN tick THEN t ELSE last END, es, ew, rs, rw FROM (SELECT *, tick AND coalesce(rw > rs + 0.05::DOUBLE, false) AS g FROM (
      SELECT *, {_DOT('rm', 'cm')} + {_DOT('ro', 'co')} AS rs, {_DOT('rm', 'co')} + {_DOT('ro', 'cm')} AS rw, NOT clinch AND rm IS NOT NULL AND m IS NOT NULL AND o IS NOT NULL AND t - last >= 1.5::DOUBLE AS tick FROM (
        SELECT *, {_CASE('d', 'lo', 'lm')} AS cm, {_CASE('d', 'lm', 'lo')} AS co FROM (SELECT *, coalesce(ew > es + 0.15::DOUBLE, false) AS d FROM (
          SELECT *, CASE WHEN inc AND NOT clinch THEN {_DOT('pm0', 'lm')} + {_DOT('po0', 'lo')} END AS es, CASE WHEN inc AND NOT clinch THEN {_DOT('pm0', 'lo')} + {_DOT('po0', 'lm')} END AS ew,
            {_CASE('clinch AND NOT inc', 'lm', 'pm0')} AS pm, {_CASE('clinch AND NOT inc', 'lo', 'po0')} AS po,
            {_CASE('rm0 IS NULL AND NOT clinch AND lm IS NOT NULL AND lo IS NOT NULL', 'lm', 'rm0')} AS rm, {_CASE('rm0 IS NULL AND NOT clinch AND lm IS NOT NULL AND lo IS NOT NULL', 'lo', 'ro0')} AS ro FROM (
            SELECT f.session, f.fi, f.t, f.clinch, w.s3 AS s, w.inc, w.pm AS pm0, w.po AS po0, w.rm AS rm0, w.ro AS ro0, w.last, {", ".join(f"{_CASE('w.s3', f'f.{a}1', f'f.{a}0')} AS {a}" for a in ("m", "o", "lm", "lo"))}
            FROM walk w JOIN fr f ON f.session = w.session AND f.fi = w.fi + 1)))))))"""
_E = "WITH RECURSIVE " + ", ".join([POSES_SQL, _FRAMES, _WALK])
_PICK = lambda a, b: f"CASE WHEN w.d <> w.g THEN {_CASE('began', f'{b}1', f'{b}0')} ELSE {_CASE('began', f'{a}1', f'{a}0')} END"
ORACLES = {
    "enriched_frames": _E + f" SELECT session, fi, f.clinch, s3 AS swapped, {_PICK('m', 'o')} AS my_pick, {_PICK('o', 'm')} AS op_pick, " + ", ".join(f"round({_CASE('s3', f'{b}{k}', f'{a}{k}')}, 6) AS {s}{n}" for s, a, b in (("my", "m", "o"), ("op", "o", "m")) for n, k in enumerate(_BOX)) + " FROM walk w JOIN fr f USING (session, fi)",
    "swap_events": _E + " SELECT session, fi, round(fi / 3.0::DOUBLE, 2) AS time_s, 'clinch_exit' AS reason, round(es, 3) AS same, round(ew, 3) AS swap FROM walk w WHERE d UNION ALL SELECT session, fi, round(fi / 3.0::DOUBLE, 2), 'periodic_reid', round(rs, 3), round(rw, 3) FROM walk w WHERE g",
    "identity_toggle": f"WITH RECURSIVE {SIGNALS_SQL}, " + """walk AS (SELECT session, -1 AS fi, false AS swapped, false AS inc FROM (SELECT DISTINCT session FROM sig) UNION ALL
      SELECT session, fi, swapped <> (inc AND kind <> 'error' AND b > a + 0.15::DOUBLE), kind = 'error' FROM (SELECT s.session, s.fi, s.kind, w.swapped, w.inc, CASE WHEN w.swapped THEN 1 - s.v / 100 ELSE s.v / 100 END AS a, CASE WHEN w.swapped THEN s.v / 100 ELSE 1 - s.v / 100 END AS b
        FROM walk w JOIN sig s ON s.session = w.session AND s.fi = w.fi + 1)) SELECT session, fi, swapped FROM walk WHERE fi >= 0""",
}
