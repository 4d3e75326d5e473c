"""Queries over the signals view: one for each window, join, aggregate and fold operator, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posewright.fixtures import SIGNALS_SQL, read, signals
from posewright.functions.columns import share
from posewright.operators import asof, folds, series
from posewright.operators.geometry import kabsch, ransac_rigid, rigid_prefix
from posewright.operators.relations import snapshot_diff, splice, zone_highlights
from posewright.sources.stages import EDGES, staleness

KEY = ["session"]


def by_frame():
    return Window.partitionBy("session").orderBy("fi")


def sides():
    return F.when(F.col("side") == "my", F.col("v")).otherwise(0.0), F.when(F.col("side") == "op", F.col("v")).otherwise(0.0)


def side_share_per_bucket(spark, d) -> DataFrame:
    return series.bucket_share(signals(spark, d), ["session", "bucket"], *sides())


def dense_spine_default(spark, d) -> DataFrame:
    sig = signals(spark, d)
    shares = series.bucket_share(sig, ["session", "bucket"], *sides())
    filled = series.fill_spine(series.dense_spine(sig, "session", "bucket", F.max("bucket") + 1), shares, ["session", "bucket"], {"my_share": 50, "op_share": 50})
    return filled.groupBy("session").agg(F.count(F.lit(1)).alias("n_buckets"), F.bround(F.avg("my_share")).cast("int").alias("my_score"), F.bround(F.avg("op_share")).cast("int").alias("op_score"))


def closer_side_share(spark, d) -> DataFrame:
    near = signals(spark, d).withColumn("_my", F.abs(F.col("v") - 50)).withColumn("_op", F.abs(F.lag("v").over(by_frame()) - 50)).where("_op is not null")
    counts = near.groupBy("session", "bucket").agg(F.count_if(F.col("_my") < F.col("_op")).alias("my_closer"), F.count_if(F.col("_my") >= F.col("_op")).alias("op_closer"))
    return counts.withColumn("my_ring", share(F.col("my_closer"), F.col("op_closer"), 0))


def guard_bucket_mean(spark, d) -> DataFrame:
    seen = F.when((F.col("side") == "my") & (F.col("v") <= 80), F.col("v") / 100)
    return signals(spark, d).groupBy("session", "bucket").agg(F.bround(F.round(100 * F.coalesce(F.avg(seen), F.lit(0.5)), 6)).cast("int").alias("guard"))


def bucket_mode_first_seen(spark, d) -> DataFrame:
    modes = series.first_seen_mode(signals(spark, d), ["session", "bucket"], "kind")
    n = modes.groupBy("session", "kind").agg(F.count(F.lit(1)).alias("n_buckets"))
    return n.withColumn("share", F.bround(100 * F.col("n_buckets") / F.sum("n_buckets").over(Window.partitionBy("session"))).cast("int"))


def pct_linear_p80(spark, d) -> DataFrame:
    return signals(spark, d).groupBy("session").agg(F.round(F.percentile("v", 0.8), 6).alias("p80"))


def onset_percentile_filter(spark, d) -> DataFrame:
    sig = signals(spark, d)
    cut = sig.groupBy("session").agg(F.percentile("v", 0.7).alias("_cut"))
    return sig.join(cut, "session").where(F.col("v") >= F.col("_cut") - 1e-9).groupBy("session").agg(F.count(F.lit(1)).alias("n_onsets"), F.round(F.sum("v"), 4).alias("strength"))


def nearest_rank_p90(spark, d) -> DataFrame:
    sig = signals(spark, d)
    return series.nearest_rank(sig, KEY, F.col("v"), 0.9, "p90").join(series.nearest_rank(sig, KEY, F.col("v"), 0.8, "p80"), "session")


def upper_median(spark, d) -> DataFrame:
    return series.nearest_rank(signals(spark, d), ["session", "side"], F.col("v"), 0.5, "median_hi")


def true_median_scale(spark, d) -> DataFrame:
    items = read(spark, d, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    medians = series.exact_median(items, keys, "l_extendedprice", "_m")
    return items.groupBy(*keys).agg(F.max("l_quantity").alias("max_quantity")).join(medians, keys).select(*keys, F.round("_m", 4).alias("median_scale"), "max_quantity")


def long_sessions(spark, d, block: int = series.BLOCK) -> DataFrame:
    """Bounded windows (maxima, centred and trailing means, marks around events, displacement) over blocks of a session
    with copied borders, so that no session is one task."""
    f = series.in_blocks(signals(spark, d), KEY, "fi", 9, 9, block)
    w = series.over_blocks(KEY, "fi")
    top = F.max("v").over(w.rowsBetween(-3, 3))
    event = F.max(F.when(F.col("v") > 40, 1).otherwise(0)).over(w.rowsBetween(-6, 2)) == 1
    out = f.withColumns({"is_top": F.col("v") == top, "near_event": event, "centred": F.round(F.avg("v").over(w.rowsBetween(-9, 9)), 6), "trailing": F.round(F.avg("v").over(w.rowsBetween(-4, 0)), 6), "step": F.round(F.coalesce(F.abs(F.col("v") - F.lag("v").over(w)), F.lit(0.0)), 6)})
    return out.where("_own").select("session", "fi", "is_top", "near_event", "centred", "trailing", "step")


def joint_peak_normalise(spark, d) -> DataFrame:
    my, op = sides()
    sums = signals(spark, d).groupBy("session", "bucket").agg(F.round(F.sum(my), 6).alias("a"), F.round(F.sum(op), 6).alias("b"))
    peak = F.greatest(F.max(F.greatest("a", "b")).over(Window.partitionBy("session")), F.lit(0.001))
    pct = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) / peak * 100).cast("int"))
    return sums.select("session", "bucket", pct("a").alias("my_pace"), pct("b").alias("op_pace"))


#: Seconds of a period of the weighted score, and of the best window that highlights leave out.
PERIOD, PEAK = 15, 12


def period_weighted_score(spark, d, period: int = PERIOD) -> DataFrame:
    """Buckets in max(2, n div 15) periods; later periods weigh (k + 1) ** 1.3; the tail that fills no period is left out."""
    spine = dense_shares(spark, d)
    n = F.count(F.lit(1)).over(Window.partitionBy("session"))
    placed = spine.withColumn("_n", n).withColumn("_k", F.greatest(F.lit(2), F.floor(F.col("_n") / period))).withColumn("_size", F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("_k")))).withColumn("period", F.floor(F.col("bucket") / F.col("_size"))).where("period < _k")
    means = placed.groupBy("session", "period").agg(F.avg("my_share").alias("_m"))
    weight = F.pow(F.col("period") + 1.0, F.lit(1.3))
    return means.groupBy("session").agg(F.round(F.sum(weight * F.col("_m")) / F.sum(weight), 6).alias("my_round"))


def dense_shares(spark, d) -> DataFrame:
    sig = signals(spark, d)
    return series.fill_spine(series.dense_spine(sig, "session", "bucket"), series.bucket_share(sig, ["session", "bucket"], *sides()), ["session", "bucket"], {"my_share": 50, "op_share": 50})


def stamina_ratio(spark, d) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("session"))
    parts = dense_shares(spark, d).withColumn("_n", n).withColumn("_third", F.floor(F.col("_n") / 3))
    means = parts.groupBy("session").agg(F.max("_n").alias("n"), F.avg(F.when(F.col("bucket") < F.col("_third"), F.col("my_share"))).alias("_a"), F.avg(F.when(F.col("bucket") >= F.col("_n") - F.col("_third"), F.col("my_share"))).alias("_b"))
    ratio = F.when(F.col("n") < 6, None).when(F.col("_a") <= 0, 100).otherwise(F.least(F.lit(100), F.bround(F.round(100 * F.try_divide(F.col("_b"), F.col("_a")), 9)).cast("int")))
    return means.select("session", ratio.cast("int").alias("stamina"))


def any_flag_buckets(spark, d) -> DataFrame:
    flags = signals(spark, d).groupBy("session", "bucket").agg(F.bool_or((F.col("kind") == "error") & (F.col("v") > 60)).alias("f"))
    return flags.groupBy("session").agg(F.count_if("f").alias("n_flagged"))


def lag_displacement(spark, d) -> DataFrame:
    step = F.abs(F.col("v") - F.lag("v").over(by_frame()))
    return signals(spark, d).select("session", "fi", F.round(F.coalesce(step, F.lit(0.0)), 6).alias("step"))


def path_length(spark, d) -> DataFrame:
    step = F.coalesce(F.abs(F.col("v") - F.lag("v").over(by_frame())), F.lit(0.0))
    return signals(spark, d).withColumn("_s", step).groupBy("session", "bucket").agg(F.round(F.sum("_s"), 6).alias("path"))


def local_peaks(spark, d) -> DataFrame:
    return series.local_peaks(signals(spark, d), KEY, "v", 40.0, 3).select("session", "fi", "v")


def centred_window_p80_carry(spark, d) -> DataFrame:
    """p80 of the positive values within two buckets; under three of them the last value is carried, 0.001 before any."""
    sig = signals(spark, d)
    spine = series.dense_spine(sig, "session", "bucket")
    near = spine.withColumn("_b", F.explode(F.sequence(F.col("bucket") - 2, F.col("bucket") + 2))).join(sig.where("v > 0").select("session", F.col("bucket").alias("_b"), "v"), ["session", "_b"], "left")
    p = near.groupBy("session", "bucket").agg(F.when(F.count("v") >= 3, F.percentile("v", 0.8)).alias("_p"))
    return p.select("session", "bucket", F.round(series.carried(F.col("_p"), 0.001, KEY, "bucket"), 6).alias("pace"))


def direction_weighted_pace(spark, d) -> DataFrame:
    """Nearest-rank p80 within two buckets; the outer bucket's direction weighs neutral values 0.6, retreats 0.3."""
    sig = signals(spark, d)
    shares = dense_shares(spark, d).withColumn("_w", F.when(F.col("my_share") > 60, 1.0).when(F.col("my_share") < 40, 0.3).otherwise(0.6)).select("session", "bucket", "_w")
    near = shares.withColumn("_b", F.explode(F.sequence(F.col("bucket") - 2, F.col("bucket") + 2))).join(sig.where("v > 0").select("session", F.col("bucket").alias("_b"), "v", "side"), ["session", "_b"])
    weighted = F.col("v") * F.when(F.col("_w") == 0.3, 0.3).when((F.col("_w") == 1.0) | (F.col("side") == "my"), 1.0).otherwise(0.6)
    ranked = series.nearest_rank(near.withColumn("_x", weighted), ["session", "bucket"], F.col("_x"), 0.8, "_p")
    counts = near.groupBy("session", "bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3")
    known = shares.join(ranked.join(counts, ["session", "bucket"], "left_semi"), ["session", "bucket"], "left")
    return known.select("session", "bucket", F.round(series.carried(F.col("_p"), 0.001, KEY, "bucket"), 6).alias("pace"))


def best_burst(spark, d) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("session"))
    sums = signals(spark, d).withColumn("_n", n).withColumn("_s", F.round(F.sum("v").over(by_frame().rowsBetween(0, 4)), 6)).where(F.col("fi") <= F.greatest(F.lit(0), F.col("_n") - 5))
    return sums.groupBy("session").agg(F.max("_s").alias("best_burst"))


def best_contiguous_window(spark, d) -> DataFrame:
    sums = dense_shares(spark, d)
    w = Window.partitionBy("session").orderBy("bucket").rowsBetween(0, PEAK - 1)
    full = sums.withColumn("_s", F.sum("my_share").over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == PEAK)
    return full.groupBy("session").agg(F.min_by("bucket", F.struct(-F.col("_s"), F.col("bucket"))).cast("long").alias("start"), F.max("_s").cast("long").alias("total"))


def gap_event_count(spark, d) -> DataFrame:
    return series.gap_events(signals(spark, d), KEY, (F.col("side") == "my") & (F.col("v") > 20), 5)


def occlusion_decay(spark, d) -> DataFrame:
    my, op = sides()
    hidden = F.col("kind") == "error"
    sums = signals(spark, d).groupBy("session", "bucket").agg(F.round(F.sum(F.when(~hidden, my)), 6).alias("a"), F.round(F.sum(F.when(~hidden, op)), 6).alias("b"), (F.count_if(hidden) / F.count(F.lit(1)) >= 0.5).alias("held"))
    total = F.coalesce(F.col("a") + F.col("b"), F.lit(0.0))
    normal = ~F.col("held") & (total > 1e-6)
    return sums.select("session", "bucket", series.decayed(F.bround(100 * F.col("a") / (F.col("a") + F.col("b"))), normal, F.col("held"), KEY, "bucket", 2.5).alias("aggression"))


def first_vote_run(spark, d) -> DataFrame:
    return series.first_run(signals(spark, d), KEY, F.col("v") > F.lit(10), 5)


def half_split_pressing(spark, d) -> DataFrame:
    """Mean of the first and of the second half of the values within 0.75 buckets of each bucket's start."""
    sig = signals(spark, d).withColumn("at", F.col("us"))
    spine = series.dense_spine(sig, "session", "bucket").withColumn("at", F.col("bucket") * 86_400_000_000)
    half = 64_800_000_000
    near = asof.within(spine, sig.select("session", "at", "fi", "v"), "session", "at", half, half, 86_400_000_000)
    w = Window.partitionBy("session", "bucket")
    placed = near.withColumn("_i", F.row_number().over(w.orderBy("fi"))).withColumn("_n", F.count(F.lit(1)).over(w))
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    means = placed.where("_n >= 3").groupBy("session", "bucket").agg(F.round(F.avg(F.when(first, F.col("v"))), 6).alias("first_half"), F.round(F.avg(F.when(~first, F.col("v"))), 6).alias("second_half"))
    return means.withColumn("pressing", F.col("second_half") - F.col("first_half") > 0.005)


def recent5_asof(spark, d) -> DataFrame:
    """Number and sum of the latest five big values of the same side at or before each frame."""
    big = F.when(F.col("v") > 20, F.col("v"))
    w = Window.partitionBy("session", "side").orderBy("fi").rowsBetween(Window.unboundedPreceding, 0)
    ranked = signals(spark, d).withColumn("_big", big).withColumn("_k", F.count("_big").over(w)).withColumn("_total", F.sum("_big").over(w))
    total_at = Window.partitionBy("session", "side").orderBy("_k").rangeBetween(Window.unboundedPreceding, -5)
    older = F.max("_total").over(total_at)
    return ranked.select("session", "fi", F.least("_k", F.lit(5)).alias("n_recent"), F.round(F.coalesce("_total", F.lit(0.0)) - F.coalesce(older, F.lit(0.0)), 4).alias("recent_sum"))


def warp_prefix_rigid(spark, d) -> DataFrame:
    steps = signals(spark, d).withColumns({"a": (F.col("v") - 50) / 5000, "dx": F.col("v") / 100, "dy": F.when(F.col("side") == "my", 0.5).otherwise(-0.5)})
    return rigid_prefix(steps, "session", "fi", "a", "dx", "dy").select("session", "fi", *(F.round(c, 6).alias(c) for c in ("theta", "x", "y")))


def _brackets(spark, d) -> DataFrame:
    sig = signals(spark, d)
    samples = sig.where("fi % 7 = 3").select("session", "fi", F.when(F.col("kind") != "error", F.col("v")).alias("x"))
    return asof.bracket(sig.select("session", "fi"), samples, "session", "fi", "x")


def asof_bracket_lerp(spark, d) -> DataFrame:
    return _brackets(spark, d).select("session", "fi", F.round(asof.interpolated(F.col("fi")), 6).alias("x"))


def asof_nearest(spark, d) -> DataFrame:
    return _brackets(spark, d).select("session", "fi", asof.nearest(F.col("fi")).alias("x"))


def locf_expand(spark, d) -> DataFrame:
    return _brackets(spark, d).select("session", "fi", F.col("_prev").alias("x"), F.col("_prev_at").alias("sampled_at"))


def event_window_mark(spark, d) -> DataFrame:
    return signals(spark, d).withColumn("attacked", series.mark_around(None, KEY, F.col("v") > 40, 2, 6)).groupBy("session").agg(F.count_if("attacked").alias("n_attacked"))


def flash_mark(spark, d) -> DataFrame:
    return signals(spark, d).select("session", "fi", series.mark_around(None, KEY, (F.col("v") > 40) & (F.col("side") == "my"), 2, 2).alias("flash"))


def interval_argmax(spark, d) -> DataFrame:
    """For each onset the strongest frame within ±1 bucket; the earliest of equal ones, my before op."""
    sig = signals(spark, d)
    onsets = sig.where("v >= 60").select("session", "us", F.col("fi").alias("onset_fi"))
    near = asof.within(onsets, sig.select("session", "us", "fi", "side", "v"), "session", "us", 86_400_000_000, 86_400_000_000, 2 * 86_400_000_000)
    best = F.max_by(F.struct("fi", "side", "v"), F.struct(F.col("v"), -F.col("fi")))
    return near.groupBy("session", "onset_fi").agg(best.alias("b")).select("session", "onset_fi", F.col("b.fi").alias("best_fi"), F.col("b.side").alias("best_side"), F.col("b.v").alias("best_v"))


def snapshot_full_outer_diff(spark, d) -> DataFrame:
    sig = signals(spark, d)
    stats = lambda rows: rows.groupBy("session").agg(F.round(F.sum("v"), 2).cast("string").alias("volume"), F.max("kind").alias("label"), F.count(F.lit(1)).cast("string").alias("n"))
    return snapshot_diff(stats(sig.where("bucket < 15 and session % 10 <> 1")), stats(sig.where("bucket >= 15 and session % 10 <> 2")), "session", ["volume", "label", "n"])


def splice_union(spark, d) -> DataFrame:
    sig = signals(spark, d).select("session", "fi", F.col("v").alias("my"), F.when(F.col("side") == "op", F.col("v")).alias("op"))
    new = sig.select("session", "fi", F.when(F.col("my") > 30, F.col("my") + 1).alias("my"), F.when(F.col("op") > 30, F.col("op") + 1).alias("op"))
    return splice(sig, new, "fi", 20, ["my", "op"])


def set_difference_topk(spark, d) -> DataFrame:
    return zone_highlights(dense_shares(spark, d), "session", "bucket", "my_share", PEAK, 4)


def ema_fold(spark, d) -> DataFrame:
    out = folds.ema(signals(spark, d), KEY, "fi", "v", 0.08)
    return out.groupBy("session").agg(F.round(F.max_by("y", "fi"), 6).alias("ema"))


def swap_vote_hysteresis(spark, d) -> DataFrame:
    votes = signals(spark, d).select("session", "fi", (F.col("v") > 15).cast("double").alias("vote"))
    return folds.hysteresis(votes, KEY, "fi", "vote").groupBy("session").agg(F.max("swaps").cast("int").alias("swaps"))


def dedup_replace(spark, d) -> DataFrame:
    events = signals(spark, d).where("v > 10").select("session", "fi", F.col("v").alias("conf"))
    return folds.keep_best(events, KEY, "fi", [], "conf", 6)


def one_euro_smooth(spark, d) -> DataFrame:
    known = F.col("kind") != "error"
    sig = signals(spark, d).select("session", "fi", (F.col("t") / 3600).alias("t"), F.when(known, F.col("v")).alias("x"), known.cast("double").alias("known"))
    return folds.one_euro(sig, KEY, "fi").select("session", "fi", F.round("y", 6).alias("y"))


def cooldown_counters(spark, d) -> DataFrame:
    w = by_frame().rowsBetween(Window.unboundedPreceding, 0)
    since = F.col("fi") - F.last(F.when(F.col("v") > 40, F.col("fi")), ignorenulls=True).over(w)
    return signals(spark, d).select("session", "fi", F.greatest(F.lit(0), 15 - F.coalesce(since, F.lit(15))).cast("int").alias("cooldown"))


def kalman_track(spark, d) -> DataFrame:
    sizes = (("cx", 9.0), ("cy", 5.0), ("w", 1.5), ("h", 3.0))
    sig = signals(spark, d).select("session", "fi", *(F.when(F.col("kind") != "error", F.col("v") * s).alias(c) for c, s in sizes))
    return folds.kalman_track(sig, KEY, "fi").where("cx is not null").select("session", "fi", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")), "coast", F.round("conf", 6).alias("conf"))


def rigid_fit_kabsch(spark, d) -> DataFrame:
    pts = signals(spark, d).select("session", F.col("v").alias("x"), (F.col("fi") * 0.5).alias("y")).select("session", "x", "y", (0.8 * F.col("x") - 0.6 * F.col("y") + 3).alias("u"), (0.6 * F.col("x") + 0.8 * F.col("y") - 2 + F.col("x") / 100).alias("v"))
    return kabsch(pts, KEY, "x", "y", "u", "v").select("session", "n", *(F.round(c, 6).alias(c) for c in ("theta", "tx", "ty")))


def ransac_rigid_fit(spark, d) -> DataFrame:
    pts = signals(spark, d).select("session", "fi", F.col("v").alias("x"), (F.col("fi") * 1.0).alias("y"))
    pts = pts.select("session", "fi", "x", "y", (F.col("x") + 3 + F.when(F.col("fi") % 5 == 0, 40.0).otherwise(0.0)).alias("u"), (F.col("y") - 2).alias("v"))
    return pts.groupBy("session").applyInPandas(lambda r: ransac_rigid(r.sort_values("fi")).round(6), "session long, inliers int, theta double, tx double, ty double")


def json_props_scan(spark, d) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return read(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count_if(F.get_json_object("props", "$.k").cast("int") > 50).alias("n_big"))


def content_hash_dedup(spark, d) -> DataFrame:
    """First document of every content; equal contents meet by digest, with a partial minimum before the exchange."""
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


#: Stages that the kinds of the signals view stand for.
STAGE_OF = {"click": "compressed", "view": "stabilization", "signup": "pose", "purchase": "arena", "error": "metrics"}


def stage_dependency_closure(spark, d) -> DataFrame:
    """Each session's stored stages that depend on each other; an event stores the stage that its kind stands for."""
    stages = F.create_map(*(F.lit(x) for pair in STAGE_OF.items() for x in pair))
    built = signals(spark, d).select("session", stages[F.col("kind")].alias("stage"), "us").where("stage is not null").groupBy("session", "stage").agg(F.max("us").alias("at"))
    return staleness(built, "session")


QUERIES = {f.__name__: f for f in (
    side_share_per_bucket, dense_spine_default, closer_side_share, guard_bucket_mean, bucket_mode_first_seen, pct_linear_p80, onset_percentile_filter, nearest_rank_p90, upper_median,
    true_median_scale, long_sessions, joint_peak_normalise, period_weighted_score, stamina_ratio, any_flag_buckets, lag_displacement, path_length, local_peaks, centred_window_p80_carry,
    direction_weighted_pace, best_burst, best_contiguous_window, gap_event_count, occlusion_decay, first_vote_run, half_split_pressing, recent5_asof, warp_prefix_rigid,
    asof_bracket_lerp, asof_nearest, locf_expand, event_window_mark, flash_mark, interval_argmax, snapshot_full_outer_diff, splice_union, set_difference_topk, ema_fold,
    swap_vote_hysteresis, dedup_replace, one_euro_smooth, cooldown_counters, kalman_track, rigid_fit_kabsch, ransac_rigid_fit, json_props_scan, content_hash_dedup, stage_dependency_closure,
)}

_SHARES = """sh AS (SELECT session, bucket, CASE WHEN a + b > 1e-6 THEN CAST(round_even(100 * a / (a + b), 0) AS INTEGER) ELSE 50 END AS my_share FROM (
    SELECT session, bucket, round(sum(CASE WHEN side = 'my' THEN v ELSE 0 END), 6) AS a, round(sum(CASE WHEN side = 'op' THEN v ELSE 0 END), 6) AS b FROM sig GROUP BY ALL)),
  ends AS (SELECT session, max(bucket) AS e FROM sig GROUP BY session),
  spine AS (SELECT session, unnest(range(0, e + 1)) AS bucket FROM ends),
  dense AS (SELECT session, bucket, coalesce(my_share, 50) AS my_share FROM spine LEFT JOIN sh USING (session, bucket))"""
_BRACKET = """smp AS (SELECT session, fi AS sfi, CASE WHEN kind <> 'error' THEN v END AS x FROM sig WHERE fi % 7 = 3),
  br AS (SELECT s.session, s.fi, max(p.sfi) FILTER (WHERE p.sfi <= s.fi) AS pi, min(p.sfi) FILTER (WHERE p.sfi >= s.fi) AS ni FROM sig s LEFT JOIN smp p ON p.session = s.session GROUP BY ALL),
  bx AS (SELECT br.*, a.x AS p, b.x AS n FROM br LEFT JOIN smp a ON a.session = br.session AND a.sfi = br.pi LEFT JOIN smp b ON b.session = br.session AND b.sfi = br.ni)"""


def _kalman(dims: tuple) -> str:
    """Columns of one walk's step for dims that share a covariance: predicted, then fused where a box was seen."""
    p, k = f"p{dims[0]}", f"k{dims[0]}"
    return ", ".join([*(f"CASE WHEN seen THEN x{d} + {k} * (z{d} - x{d}) ELSE x{d} END AS x{d}, CASE WHEN seen THEN v{d} + {k}v * (z{d} - x{d}) WHEN coast >= 2 THEN v{d} * 0.85::DOUBLE ELSE v{d} END AS v{d}" for d in dims),
                      f"CASE WHEN seen THEN (1 - {k}) * {p}a ELSE {p}a END AS {p}a, CASE WHEN seen THEN (1 - {k}) * {p}b ELSE {p}b END AS {p}b, CASE WHEN seen THEN {p}c - {k}v * {p}b ELSE {p}c END AS {p}c"])


#: Each of the four numbers of a box is a filter of its own; the two of the centre share a covariance, and those of the size.
_KALMAN = """box AS (SELECT session, fi, kind <> 'error' AS seen, v * 9 AS z0, v * 5 AS z1, greatest(v * 1.5::DOUBLE, 10) AS z2, greatest(v * 3, 10) AS z3 FROM sig),
  walk AS (SELECT b.session, b.fi, 0::BIGINT AS coast, z0 AS x0, 0.0::DOUBLE AS v0, z1 AS x1, 0.0::DOUBLE AS v1, 100.0::DOUBLE AS p0a, 0.0::DOUBLE AS p0b, 500.0::DOUBLE AS p0c, z2 AS x2, 0.0::DOUBLE AS v2, z3 AS x3, 0.0::DOUBLE AS v3, 100.0::DOUBLE AS p2a, 0.0::DOUBLE AS p2b, 100.0::DOUBLE AS p2c
      FROM box b JOIN (SELECT session, min(fi) AS fi FROM box WHERE seen GROUP BY session) USING (session, fi) UNION ALL
    SELECT session, fi, CASE WHEN seen THEN 0 ELSE coast + 1 END, """ + _kalman((0, 1)) + ", " + _kalman((2, 3)) + """ FROM (
      SELECT *, p0a / (p0a + 25) AS k0, p0b / (p0a + 25) AS k0v, p2a / (p2a + 100) AS k2, p2b / (p2a + 100) AS k2v FROM (
        SELECT b.*, w.coast, x0 + v0 AS x0, v0, x1 + v1 AS x1, v1, x2 + v2 AS x2, v2, x3 + v3 AS x3, v3, p0a + 2 * p0b + p0c + 9 AS p0a, p0b + p0c AS p0b, p0c + 16 AS p0c, p2a + 2 * p2b + p2c + 4 AS p2a, p2b + p2c AS p2b, p2c + 4 AS p2c
        FROM walk w JOIN box b ON b.session = w.session AND b.fi = w.fi + 1)))"""


def _q(body: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join([SIGNALS_SQL, *parts]) + " " + body


ORACLES = {
    "stage_dependency_closure": _q("SELECT u.session, u.stage, l.stage AS dependent, u.at > l.at AS stale FROM built u JOIN (SELECT DISTINCT stage, dependent FROM reach) r ON r.stage = u.stage JOIN built l ON l.session = u.session AND l.stage = r.dependent",
      "e AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + ") t(stage, dependent)), reach AS (SELECT * FROM e UNION SELECT r.stage, e.dependent FROM reach r JOIN e ON e.stage = r.dependent)",
      "built AS (SELECT session, CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF.items()) + " END AS stage, max(us) AS at FROM sig GROUP BY ALL HAVING stage IS NOT NULL)"),
    "side_share_per_bucket": _q("SELECT session, bucket, my_share, 100 - my_share AS op_share FROM sh", _SHARES),
    "dense_spine_default": _q("""SELECT session, count(*) AS n_buckets, CAST(round_even(avg(coalesce(my_share, 50)), 0) AS INTEGER) AS my_score, CAST(round_even(avg(coalesce(100 - my_share, 50)), 0) AS INTEGER) AS op_score
      FROM (SELECT session, unnest(range(0, e + 2)) AS bucket FROM ends) LEFT JOIN sh USING (session, bucket) GROUP BY session""", _SHARES),
    "closer_side_share": _q("""SELECT session, bucket, count(*) FILTER (WHERE m < o) AS my_closer, count(*) FILTER (WHERE m >= o) AS op_closer, CAST(round_even(100.0 * count(*) FILTER (WHERE m < o) / count(*), 0) AS INTEGER) AS my_ring
      FROM (SELECT session, bucket, abs(v - 50) AS m, abs(lag(v) OVER (PARTITION BY session ORDER BY fi) - 50) AS o FROM sig) WHERE o IS NOT NULL GROUP BY ALL"""),
    "guard_bucket_mean": _q("SELECT session, bucket, CAST(round_even(round(100 * coalesce(avg(v / 100) FILTER (WHERE side = 'my' AND v <= 80), 0.5), 6), 0) AS INTEGER) AS guard FROM sig GROUP BY ALL"),
    "bucket_mode_first_seen": _q("""SELECT session, kind, count(*) AS n_buckets, CAST(round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY session), 0) AS INTEGER) AS share FROM (
      SELECT session, bucket, kind FROM (SELECT session, bucket, kind, row_number() OVER (PARTITION BY session, bucket ORDER BY count(*) DESC, min(fi)) AS r FROM sig GROUP BY session, bucket, kind) WHERE r = 1) GROUP BY session, kind"""),
    "pct_linear_p80": _q("SELECT session, round(quantile_cont(v, 0.8), 6) AS p80 FROM sig GROUP BY session"),
    "onset_percentile_filter": _q("SELECT session, count(*) AS n_onsets, round(sum(v), 4) AS strength FROM sig JOIN (SELECT session, quantile_cont(v, 0.7) AS cut FROM sig GROUP BY session) USING (session) WHERE v >= cut - 1e-9 GROUP BY session"),
    "nearest_rank_p90": _q("SELECT session, list_sort(list(v))[CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90, list_sort(list(v))[CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) + 1] AS p80 FROM sig GROUP BY session"),
    "upper_median": _q("SELECT session, side, list_sort(list(v))[count(*) // 2 + 1] AS median_hi FROM sig GROUP BY session, side"),
    "true_median_scale": "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS median_scale, max(l_quantity) AS max_quantity FROM lineitem GROUP BY ALL",
    "long_sessions": _q("""SELECT session, fi, v = max(v) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS is_top, max(CASE WHEN v > 40 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 6 PRECEDING AND 2 FOLLOWING) = 1 AS near_event,
      round(avg(v) OVER (w ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING), 6) AS centred, round(avg(v) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS trailing, round(coalesce(abs(v - lag(v) OVER w), 0), 6) AS step FROM sig WINDOW w AS (PARTITION BY session ORDER BY fi)"""),
    "joint_peak_normalise": _q("""SELECT session, bucket, greatest(1, CAST(round_even(a / p * 100, 0) AS INTEGER)) AS my_pace, greatest(1, CAST(round_even(b / p * 100, 0) AS INTEGER)) AS op_pace FROM (
      SELECT *, greatest(max(greatest(a, b)) OVER (PARTITION BY session), 0.001) AS p FROM (SELECT session, bucket, round(sum(CASE WHEN side = 'my' THEN v ELSE 0 END), 6) AS a, round(sum(CASE WHEN side = 'op' THEN v ELSE 0 END), 6) AS b FROM sig GROUP BY ALL))"""),
    "period_weighted_score": _q("""SELECT session, round(sum(pow(period + 1.0, 1.3) * m) / sum(pow(period + 1.0, 1.3)), 6) AS my_round FROM (
      SELECT session, bucket // size AS period, avg(my_share) AS m FROM (SELECT *, greatest(1, n // k) AS size FROM (SELECT *, greatest(2, n // 15) AS k FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM dense))) WHERE bucket // size < k GROUP BY ALL) GROUP BY session""", _SHARES),
    "stamina_ratio": _q("""SELECT session, CASE WHEN n < 6 THEN NULL WHEN a <= 0 THEN 100 ELSE least(100, CAST(round_even(round(100 * b / a, 9), 0) AS INTEGER)) END AS stamina FROM (
      SELECT session, max(n) AS n, avg(my_share) FILTER (WHERE bucket < n // 3) AS a, avg(my_share) FILTER (WHERE bucket >= n - n // 3) AS b FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM dense) GROUP BY session)""", _SHARES),
    "any_flag_buckets": _q("SELECT session, count(*) FILTER (WHERE f) AS n_flagged FROM (SELECT session, bucket, bool_or(kind = 'error' AND v > 60) AS f FROM sig GROUP BY ALL) GROUP BY session"),
    "lag_displacement": _q("SELECT session, fi, round(coalesce(abs(v - lag(v) OVER (PARTITION BY session ORDER BY fi)), 0), 6) AS step FROM sig"),
    "path_length": _q("SELECT session, bucket, round(sum(s), 6) AS path FROM (SELECT session, bucket, coalesce(abs(v - lag(v) OVER (PARTITION BY session ORDER BY fi)), 0) AS s FROM sig) GROUP BY ALL"),
    "local_peaks": _q("""SELECT session, fi, v FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY fi) AS r FROM kept)""", """cand AS (SELECT session, fi, v, row_number() OVER (PARTITION BY session ORDER BY fi) AS r FROM (
        SELECT *, max(v) OVER (PARTITION BY session ORDER BY fi ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM sig) WHERE v >= 40 AND v = top),
      walk AS (SELECT session, fi, v, r, fi AS anchor, true AS keep FROM cand WHERE r = 1 UNION ALL
        SELECT c.session, c.fi, c.v, c.r, CASE WHEN c.fi - w.anchor > 3 THEN c.fi ELSE w.anchor END, c.fi - w.anchor > 3 FROM walk w JOIN cand c ON c.session = w.session AND c.r = w.r + 1),
      kept AS (SELECT session, fi, v FROM walk WHERE keep)"""),
    "centred_window_p80_carry": _q("""SELECT session, bucket, round(coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY session ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.001), 6) AS pace FROM (
      SELECT spine.session, spine.bucket, CASE WHEN count(v) >= 3 THEN quantile_cont(v, 0.8) END AS p FROM spine LEFT JOIN (SELECT session, bucket AS b, v FROM sig WHERE v > 0) s ON s.session = spine.session AND s.b BETWEEN spine.bucket - 2 AND spine.bucket + 2 GROUP BY ALL)""", _SHARES),
    "direction_weighted_pace": _q("""SELECT session, bucket, round(coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY session ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.001), 6) AS pace FROM (
      SELECT d.session, d.bucket, CASE WHEN count(v) >= 3 THEN (list_sort(list(v * CASE WHEN my_share > 60 THEN 1.0::DOUBLE WHEN my_share < 40 THEN 0.3::DOUBLE WHEN side = 'my' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) FILTER (WHERE v IS NOT NULL)))[CAST(floor(count(v) * 0.8::DOUBLE) AS BIGINT) + 1] END AS p
      FROM dense d LEFT JOIN (SELECT session, bucket AS b, v, side FROM sig WHERE v > 0) s ON s.session = d.session AND s.b BETWEEN d.bucket - 2 AND d.bucket + 2 GROUP BY ALL)""", _SHARES),
    "best_burst": _q("SELECT session, max(s) AS best_burst FROM (SELECT session, fi, round(sum(v) OVER (PARTITION BY session ORDER BY fi ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 6) AS s, count(*) OVER (PARTITION BY session) AS n FROM sig) WHERE fi <= greatest(0, n - 5) GROUP BY session"),
    "best_contiguous_window": _q("""SELECT session, arg_min(bucket, (-s) * 100000 + bucket) AS start, CAST(max(s) AS BIGINT) AS total FROM (SELECT session, bucket, sum(my_share) OVER w AS s, count(*) OVER w AS n FROM dense WINDOW w AS (PARTITION BY session ORDER BY bucket ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) WHERE n = 12 GROUP BY session""", _SHARES),
    "gap_event_count": _q("""SELECT session, coalesce(n, 0) AS n_events FROM (SELECT DISTINCT session FROM sig) LEFT JOIN (SELECT session, count(*) FILTER (WHERE p IS NULL OR fi - p > 5) AS n FROM (SELECT session, fi, lag(fi) OVER (PARTITION BY session ORDER BY fi) AS p FROM sig WHERE side = 'my' AND v > 20) GROUP BY session) USING (session)"""),
    "occlusion_decay": _q("""SELECT session, bucket, CASE WHEN normal THEN pct WHEN held AND lp IS NOT NULL THEN CAST(round_even(round(50 + (lp - 50) * exp(-(bucket - lb) / 2.5::DOUBLE), 9), 0) AS INTEGER) ELSE 50 END AS aggression FROM (
      SELECT *, last_value(CASE WHEN normal THEN pct END IGNORE NULLS) OVER w AS lp, last_value(CASE WHEN normal THEN bucket END IGNORE NULLS) OVER w AS lb FROM (
        SELECT *, NOT held AND coalesce(a + b, 0) > 1e-6 AS normal, CAST(round_even(100 * a / (a + b), 0) AS INTEGER) AS pct FROM (
          SELECT session, bucket, round(sum(CASE WHEN side = 'my' THEN v ELSE 0 END) FILTER (WHERE kind <> 'error'), 6) AS a, round(sum(CASE WHEN side = 'op' THEN v ELSE 0 END) FILTER (WHERE kind <> 'error'), 6) AS b, count(*) FILTER (WHERE kind = 'error') / count(*)::DOUBLE >= 0.5 AS held FROM sig GROUP BY ALL))
      WINDOW w AS (PARTITION BY session ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""),
    "first_vote_run": _q("""SELECT session, first_fi FROM (SELECT DISTINCT session FROM sig) LEFT JOIN (SELECT session, min(s) AS first_fi FROM (SELECT session, min(fi) AS s FROM (SELECT session, fi, v, sum(CASE WHEN v > 10 THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY fi) AS run FROM sig) WHERE v > 10 GROUP BY session, run HAVING count(*) >= 5) GROUP BY session) USING (session)"""),
    "half_split_pressing": _q("""SELECT session, bucket, f AS first_half, g AS second_half, g - f > 0.005 AS pressing FROM (SELECT session, bucket, round(avg(v) FILTER (WHERE i <= n // 2), 6) AS f, round(avg(v) FILTER (WHERE i > n // 2), 6) AS g FROM (
      SELECT p.session, p.bucket, v, row_number() OVER (PARTITION BY p.session, p.bucket ORDER BY fi) AS i, count(*) OVER (PARTITION BY p.session, p.bucket) AS n FROM spine p JOIN sig s ON s.session = p.session AND s.us BETWEEN p.bucket * 86400000000 - 64800000000 AND p.bucket * 86400000000 + 64800000000) WHERE n >= 3 GROUP BY ALL)""", _SHARES),
    "recent5_asof": _q("""SELECT s.session, s.fi, count(b.fi) AS n_recent, round(coalesce(sum(b.v), 0), 4) AS recent_sum FROM sig s LEFT JOIN LATERAL (SELECT fi, v FROM sig b WHERE b.session = s.session AND b.side = s.side AND b.v > 20 AND b.fi <= s.fi ORDER BY b.fi DESC LIMIT 5) b ON true GROUP BY s.session, s.fi"""),
    "warp_prefix_rigid": _q("""SELECT session, fi, round(bf + a, 6) AS theta, round(sum(cos(bf) * dx - sin(bf) * dy) OVER w, 6) AS x, round(sum(sin(bf) * dx + cos(bf) * dy) OVER w, 6) AS y FROM (
      SELECT *, sum(a) OVER (PARTITION BY session ORDER BY fi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - a AS bf FROM (SELECT session, fi, (v - 50) / 5000 AS a, v / 100 AS dx, CASE WHEN side = 'my' THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS dy FROM sig))
      WINDOW w AS (PARTITION BY session ORDER BY fi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "asof_bracket_lerp": _q("SELECT session, fi, round(CASE WHEN pi IS NULL THEN n WHEN ni IS NULL THEN p WHEN pi = ni THEN p ELSE coalesce(p + (n - p) * ((fi - pi) / CAST(ni - pi AS DOUBLE)), p, n) END, 6) AS x FROM bx", _BRACKET),
    "asof_nearest": _q("SELECT session, fi, CASE WHEN pi IS NULL OR ni - fi <= fi - pi THEN n ELSE p END AS x FROM bx", _BRACKET),
    "locf_expand": _q("SELECT session, fi, p AS x, pi AS sampled_at FROM bx", _BRACKET),
    "event_window_mark": _q("SELECT session, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM sig e WHERE e.session = s.session AND e.v > 40 AND s.fi BETWEEN e.fi - 2 AND e.fi + 6)) AS n_attacked FROM sig s GROUP BY session"),
    "flash_mark": _q("SELECT session, fi, max(CASE WHEN v > 40 AND side = 'my' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY fi ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS flash FROM sig"),
    "interval_argmax": _q("""SELECT session, onset_fi, fi AS best_fi, side AS best_side, v AS best_v FROM (SELECT o.session, o.fi AS onset_fi, s.fi, s.side, s.v, row_number() OVER (PARTITION BY o.session, o.fi ORDER BY s.v DESC, s.fi) AS r
      FROM sig o JOIN sig s ON s.session = o.session AND s.us BETWEEN o.us - 86400000000 AND o.us + 86400000000 WHERE o.v >= 60) WHERE r = 1"""),
    "snapshot_full_outer_diff": _q("""SELECT session, metric, CASE WHEN b IS NULL THEN 'new' WHEN c IS NULL THEN 'removed' ELSE 'changed' END AS status, bn AS baseline, cn AS current, round(cn - bn, 6) AS delta FROM (
        SELECT coalesce(b.session, c.session) AS session, m.metric, b.session AS b, c.session AS c, TRY_CAST(CASE m.metric WHEN 'volume' THEN b.volume WHEN 'label' THEN b.label ELSE b.n END AS DOUBLE) AS bn, TRY_CAST(CASE m.metric WHEN 'volume' THEN c.volume WHEN 'label' THEN c.label ELSE c.n END AS DOUBLE) AS cn
        FROM (SELECT session, CAST(round(sum(v), 2) AS VARCHAR) AS volume, max(kind) AS label, CAST(count(*) AS VARCHAR) AS n FROM sig WHERE bucket < 15 AND session % 10 <> 1 GROUP BY session) b
        FULL JOIN (SELECT session, CAST(round(sum(v), 2) AS VARCHAR) AS volume, max(kind) AS label, CAST(count(*) AS VARCHAR) AS n FROM sig WHERE bucket >= 15 AND session % 10 <> 2 GROUP BY session) c ON b.session = c.session
        CROSS JOIN (VALUES ('volume'), ('label'), ('n')) m(metric)) WHERE (b IS NULL OR c IS NULL OR abs(cn - bn) >= 0.01) AND (bn IS NOT NULL OR cn IS NOT NULL)"""),
    "splice_union": _q("""SELECT session, fi, v AS my, CASE WHEN side = 'op' THEN v END AS op FROM sig WHERE fi < 20 UNION ALL SELECT session, fi, my, op FROM (SELECT session, fi, CASE WHEN v > 30 THEN v + 1 END AS my, CASE WHEN side = 'op' AND v > 30 THEN v + 1 END AS op FROM sig) WHERE fi >= 20 AND (my IS NOT NULL OR op IS NOT NULL)"""),
    "set_difference_topk": _q("""SELECT session, bucket, my_share, zone FROM (SELECT *, row_number() OVER (PARTITION BY session, zone ORDER BY my_share DESC, bucket) AS r FROM (
      SELECT d.session, d.bucket, d.my_share, CASE WHEN d.bucket < 0.4::DOUBLE * n THEN 'first' WHEN d.bucket >= 0.6::DOUBLE * n THEN 'last' END AS zone FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM dense) d LEFT JOIN best USING (session) WHERE start IS NULL OR d.bucket < start OR d.bucket >= start + 12) WHERE zone IS NOT NULL) WHERE r <= 4""", _SHARES, """best AS (SELECT session, arg_min(bucket, (-s) * 100000 + bucket) AS start FROM (SELECT session, bucket, sum(my_share) OVER w AS s, count(*) OVER w AS n FROM dense WINDOW w AS (PARTITION BY session ORDER BY bucket ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) WHERE n = 12 GROUP BY session)"""),
    "ema_fold": _q("SELECT session, round(arg_max(e, fi), 6) AS ema FROM walk GROUP BY session", "walk AS (SELECT session, fi, v AS e FROM sig WHERE fi = 0 UNION ALL SELECT s.session, s.fi, w.e * (1 - 0.08::DOUBLE) + s.v * 0.08::DOUBLE FROM walk w JOIN sig s ON s.session = w.session AND s.fi = w.fi + 1)"),
    "swap_vote_hysteresis": _q("SELECT session, arg_max(k, fi) AS swaps FROM walk GROUP BY session", """walk AS (SELECT session, -1 AS fi, 0 AS n, 0 AS k FROM (SELECT DISTINCT session FROM sig) UNION ALL
      SELECT s.session, s.fi, CASE WHEN s.v > 15 THEN CASE WHEN w.n + 1 >= 3 THEN 0 ELSE w.n + 1 END ELSE greatest(w.n - 1, 0) END, CASE WHEN s.v > 15 AND w.n + 1 >= 3 THEN w.k + 1 ELSE w.k END FROM walk w JOIN sig s ON s.session = w.session AND s.fi = w.fi + 1)"""),
    "dedup_replace": _q("SELECT session, fi, conf FROM (SELECT session, anchor AS fi, conf, r, lead(fresh) OVER (PARTITION BY session ORDER BY r) AS nxt FROM walk) WHERE nxt IS NULL OR nxt", """ev AS (SELECT session, fi, v, row_number() OVER (PARTITION BY session ORDER BY fi) AS r FROM sig WHERE v > 10),
      walk AS (SELECT session, r, fi AS anchor, v AS conf, true AS fresh FROM ev WHERE r = 1 UNION ALL
        SELECT e.session, e.r, CASE WHEN e.fi - w.anchor >= 6 OR e.v > w.conf THEN e.fi ELSE w.anchor END, CASE WHEN e.fi - w.anchor >= 6 OR e.v > w.conf THEN e.v ELSE w.conf END, e.fi - w.anchor >= 6 FROM walk w JOIN ev e ON e.session = w.session AND e.r = w.r + 1)"""),
    "cooldown_counters": _q("SELECT session, fi, CAST(greatest(0, 15 - coalesce(fi - last_value(CASE WHEN v > 40 THEN fi END IGNORE NULLS) OVER (PARTITION BY session ORDER BY fi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 15)) AS INTEGER) AS cooldown FROM sig"),
    "one_euro_smooth": _q("SELECT session, fi, round(y, 6) AS y FROM walk", """raw AS (SELECT session, fi, t / 3600 AS t, CASE WHEN kind <> 'error' THEN v END AS x FROM sig),
      walk AS (SELECT session, fi, x AS y, 0.0::DOUBLE AS s, CASE WHEN x IS NOT NULL THEN t END AS tl FROM raw WHERE fi = 0 UNION ALL
        SELECT session, fi, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE a * x + (1 - a) * y END, CASE WHEN x IS NULL OR y IS NULL THEN s ELSE ds END, CASE WHEN x IS NULL THEN tl ELSE t END FROM (
          SELECT *, 1 / (1 + 1 / (2 * pi() * (1.0::DOUBLE + 0.4::DOUBLE * abs(ds))) / dt) AS a FROM (SELECT *, ad * (x - y) / dt + (1 - ad) * s AS ds FROM (SELECT *, 1 / (1 + 1 / (2 * pi()) / dt) AS ad FROM (
            SELECT r.session, r.fi, r.t, r.x, w.y, w.s, w.tl, greatest(r.t - w.tl, 1e-6::DOUBLE) AS dt FROM walk w JOIN raw r ON r.session = w.session AND r.fi = w.fi + 1)))))"""),
    "kalman_track": _q("SELECT session, fi, round(x0, 6) AS cx, round(x1, 6) AS cy, round(x2, 6) AS w, round(x3, 6) AS h, coast, round(greatest(0, 1 - 0.2::DOUBLE * coast), 6) AS conf FROM walk", _KALMAN),
    "rigid_fit_kabsch": _q("""SELECT session, n, round(th, 6) AS theta, round(mu - (cos(th) * mx - sin(th) * my), 6) AS tx, round(mv - (sin(th) * mx + cos(th) * my), 6) AS ty FROM (SELECT *, atan2(cr - n * (mx * mv - my * mu), dt - n * (mx * mu + my * mv)) AS th FROM (
      SELECT session, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(w) AS mv, sum(x * w - y * u) AS cr, sum(x * u + y * w) AS dt FROM (SELECT session, x, y, 0.8::DOUBLE * x - 0.6::DOUBLE * y + 3 AS u, 0.6::DOUBLE * x + 0.8::DOUBLE * y - 2 + x / 100 AS w FROM (SELECT session, v AS x, fi * 0.5::DOUBLE AS y FROM sig)) GROUP BY session))"""),
    "json_props_scan": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50) AS n_big FROM events GROUP BY event_type",
    "content_hash_dedup": "SELECT sha256(text) AS content, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)",
}
