"""Punches heard: sudden sounds, laid to the wrist that moved fastest around them.

Strong onsets of a session (F8) pass a bar of confidence, meet the frames around them by bins of the axis (J12), count
if a wrist moved fast enough for the session's typical height, are thinned to the most confident of each cluster (ST7)
and graded against the session's fastest (SG32). A session is cut into runs of events that stand close enough to touch;
only inside a run does one event depend on the one before, with an anchor and a confidence as all its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posewright.fixtures import SIGNALS_SQL, signals
from posewright.functions.perception import intensity
from posewright.operators import asof, folds, series

# fixed values: share of the height that a punch moves a wrist, what of it is asked for with and without a model of
# sounds, the bars of confidence and of onset strength, the reach around an onset, and the gap between punches
PUNCH_THRESHOLD = 0.21
GATES = {True: 0.50, False: 0.20}
CONFIDENCES = {True: 0.40, False: 0.10}
QUANTILES = {True: 0.70, False: 0.50}
REACH_S, GAP_S, NO_HEIGHT = 0.15, 0.20, 200.0


def strong_onsets(onsets: DataFrame, modelled: bool) -> DataFrame:
    """(session, t, conf) of the onsets that are loud and sure enough; without a model the strength stands for it."""
    cut = onsets.groupBy("session").agg(F.percentile("strength", QUANTILES[modelled]).alias("_cut"))
    loud = onsets.join(cut, "session").where(F.col("strength") >= F.col("_cut"))
    top = F.max("strength").over(Window.partitionBy("session")) + 1e-9
    conf = F.coalesce("conf", F.lit(0.0)) if modelled else F.col("strength") / top * 0.50
    return loud.select("session", "t", conf.alias("conf")).where(F.col("conf") >= CONFIDENCES[modelled])


def heard_punches(frames: DataFrame, onsets: DataFrame, fps: float, modelled: bool = False) -> DataFrame:
    """(session, frame_idx, side, hand, wrist_speed, audio_conf, intensity_val, intensity), one row a punch.

    frames: (session, fi, side, left, right, tall): speeds of both wrists and the height of the box, null where unseen.
    onsets: (session, t, strength, conf)."""
    tall = series.nearest_rank(frames.where("tall is not null"), ["session"], F.col("tall"), 0.5, "_tall")
    ends = frames.groupBy("session").agg(F.max("fi").alias("_end")).join(tall, "session", "left")
    reach, gap = max(1, int(REACH_S * fps)), max(1, int(GAP_S * fps))
    at = F.greatest(F.lit(0), F.least(F.col("_end"), F.floor(F.col("t") * fps))).cast("int")
    heard = strong_onsets(onsets, modelled).join(ends, "session").select("session", "t", "conf", F.coalesce("_tall", F.lit(NO_HEIGHT)).alias("_tall"), at.alias("fi"))
    hands = frames.where("fi > 0").select("session", "fi", "side", F.when(F.col("left") >= F.col("right"), "L").otherwise("R").alias("hand"), F.greatest("left", "right").alias("speed")).where("speed > 0")
    near = asof.within(heard, hands, "session", "fi", reach, reach, 2 * reach)
    best = F.max_by(F.struct(F.col("_at").alias("frame_idx"), "side", "hand", F.col("speed").alias("wrist_speed")), F.struct("speed", -F.col("_at"), F.col("side") == "my"))
    found = near.groupBy("session", "t", "conf", "_tall").agg(best.alias("b")).where(F.col("b.wrist_speed") >= F.col("_tall") * PUNCH_THRESHOLD * GATES[modelled])
    events = found.select("session", "t", F.col("conf").alias("audio_conf"), "b.*")
    kept = folds.keep_best(events, ["session"], "frame_idx", ["t"], "audio_conf", gap)
    value, grade = intensity(F.col("wrist_speed"), F.max("wrist_speed").over(Window.partitionBy("session")), F.col("audio_conf"))
    return kept.select("session", "frame_idx", "side", "hand", "wrist_speed", "audio_conf", value.alias("intensity_val"), grade.alias("intensity"))


def heard_views(spark, d) -> tuple[DataFrame, DataFrame]:
    """The signals view as frames with wrists of both sides, and its purchases and clicks as onsets."""
    sig = signals(spark, d)
    step = F.coalesce(F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("session").orderBy("fi"))), F.lit(0.0))
    wide = sig.withColumn("_step", step).select("session", "fi", F.explode(F.array(
        F.struct(F.lit("my").alias("side"), F.col("v").alias("left"), F.col("_step").alias("right"), F.when(F.col("kind") != "error", 100 + F.col("v")).alias("tall")),
        F.struct(F.lit("op").alias("side"), (F.col("v") / 2).alias("left"), (2 * F.col("_step")).alias("right"), F.lit(None).cast("double").alias("tall")))).alias("s")).select("session", "fi", "s.*")
    onsets = sig.where("kind in ('click', 'purchase')").select("session", ((F.col("fi") + 0.5) / 15).alias("t"), F.col("v").alias("strength"), F.when(F.col("kind") == "purchase", F.col("v") / 100).alias("conf"))
    return wide, onsets


def _heard(spark, d, modelled: bool) -> DataFrame:
    out = heard_punches(*heard_views(spark, d), 15.0, modelled)
    return out.select("session", "frame_idx", "side", "hand", "intensity", *(F.round(c, 6).alias(c) for c in ("wrist_speed", "audio_conf", "intensity_val")))


def audio_punches(spark, d) -> DataFrame:
    return _heard(spark, d, False)


def audio_punches_modelled(spark, d) -> DataFrame:
    return _heard(spark, d, True)


QUERIES = {f.__name__: f for f in (audio_punches, audio_punches_modelled)}


def _sql(modelled: bool) -> str:
    conf = "coalesce(conf, 0)" if modelled else "strength / (top + 1e-9::DOUBLE) * 0.5::DOUBLE"
    return "WITH RECURSIVE " + SIGNALS_SQL + f""", st AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY session ORDER BY fi)), 0) AS step FROM sig),
  fr AS (SELECT session, fi, 'my' AS side, v AS l, step AS r FROM st UNION ALL SELECT session, fi, 'op', v / 2, 2 * step FROM st),
  ends AS (SELECT session, max(fi) AS e, list_sort(list(100 + v) FILTER (WHERE kind <> 'error')) AS hs FROM sig GROUP BY session),
  on0 AS (SELECT session, (fi + 0.5::DOUBLE) / 15 AS t, v AS strength, CASE WHEN kind = 'purchase' THEN v / 100 END AS conf FROM sig WHERE kind IN ('click', 'purchase')),
  loud AS (SELECT o.*, max(strength) OVER (PARTITION BY o.session) AS top FROM on0 o JOIN (SELECT session, quantile_cont(strength, {QUANTILES[modelled]}::DOUBLE) AS cut FROM on0 GROUP BY session) c ON c.session = o.session WHERE strength >= cut),
  heard AS (SELECT l.session, t, {conf} AS conf, greatest(0, least(e, CAST(floor(t * 15) AS INTEGER))) AS mid, coalesce(hs[len(hs) // 2 + 1], 200) AS tall FROM loud l JOIN ends USING (session) WHERE {conf} >= {CONFIDENCES[modelled]}::DOUBLE),
  best AS (SELECT * FROM (SELECT h.*, f.fi, f.side, greatest(l, r) AS speed, CASE WHEN l >= r THEN 'L' ELSE 'R' END AS hand, row_number() OVER (PARTITION BY h.session, t ORDER BY greatest(l, r) DESC, f.fi, f.side) AS k
    FROM heard h JOIN fr f ON f.session = h.session AND f.fi > 0 AND f.fi BETWEEN mid - 2 AND mid + 2 WHERE greatest(l, r) > 0) WHERE k = 1 AND speed >= tall * 0.21::DOUBLE * {GATES[modelled]}::DOUBLE),
  ev AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY fi, t) AS n FROM best),
  walk AS (SELECT session, n, n AS kept, fi AS anchor, conf, true AS fresh FROM ev WHERE n = 1 UNION ALL
    SELECT e.session, e.n, CASE WHEN e.fi - w.anchor >= 3 OR e.conf > w.conf THEN e.n ELSE w.kept END, CASE WHEN e.fi - w.anchor >= 3 OR e.conf > w.conf THEN e.fi ELSE w.anchor END, CASE WHEN e.fi - w.anchor >= 3 OR e.conf > w.conf THEN e.conf ELSE w.conf END, e.fi - w.anchor >= 3
    FROM walk w JOIN ev e ON e.session = w.session AND e.n = w.n + 1),
  fin AS (SELECT session, kept FROM (SELECT session, kept, lead(fresh) OVER (PARTITION BY session ORDER BY n) AS nxt FROM walk) WHERE nxt IS NULL OR nxt),
  val AS (SELECT e.session, e.fi, e.side, e.hand, e.speed, e.conf, 0.6::DOUBLE * (speed / (max(speed) OVER (PARTITION BY e.session) + 1e-9::DOUBLE)) + 0.4::DOUBLE * e.conf AS iv FROM ev e JOIN fin f ON f.session = e.session AND f.kept = e.n)
SELECT session, fi AS frame_idx, side, hand, CASE WHEN iv > 0.65::DOUBLE THEN 'HARD' WHEN iv > 0.35::DOUBLE THEN 'MED' ELSE 'LIGHT' END AS intensity, round(speed, 6) AS wrist_speed, round(conf, 6) AS audio_conf, round(iv, 6) AS intensity_val FROM val"""


ORACLES = {"audio_punches": _sql(False), "audio_punches_modelled": _sql(True)}
