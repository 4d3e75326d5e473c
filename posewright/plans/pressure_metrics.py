"""Scores of the second metric family: punches by a score against the session's own 90th percentiles, pressing by who
closed the distance, pace against the joint peak, and control as their blend. All windows and groups are keyed by
session, second or both; only a session's few quantiles are joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posewright.config import DEFAULT, SHOULDER_L, SHOULDER_R, WRIST_L, WRIST_R, Config
from posewright.functions import columns as c
from posewright.functions import perception
from posewright.operators import series
from posewright.plans.arena_metrics import percent
from posewright.plans.pose_frames import PAIRS, window

SERIES = ("pace", "aggression", "guard", "ring", "control")


def length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def mean_known(*values: Column) -> Column:
    """Mean of those that are not null; null without any."""
    known = F.filter(F.array(*values), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))


def motions(frames: DataFrame) -> DataFrame:
    """Adds for each side p: shoulders (sx, sy) from those that are seen, wrists relative to them, extension, acceleration,
    body move, box centre and box height (th, .3 where there is none)."""
    w, first, steps, moves = window(), {}, {}, {}
    for p in ("my", "op"):
        k = lambda i, axis, p=p: c.keypoint(F.col(f"{p}_kps"), i, axis)
        for axis, n in ((0, "x"), (1, "y")):
            first |= {f"{p}_s{n}": mean_known(k(SHOULDER_L, axis), k(SHOULDER_R, axis)), f"{p}_wl{n}": k(WRIST_L, axis), f"{p}_wr{n}": k(WRIST_R, axis)}
        first |= {f"{p}_th": perception.height(F.col(f"{p}_bbox")), f"{p}_cx": c.box_centre(F.col(f"{p}_bbox"), 0)}
        steps |= {f"{p}_{h}{n}": F.col(f"{p}_w{h}{n}") - F.col(f"{p}_s{n}") for h in "lr" for n in "xy"}
    frames = frames.withColumns(first).withColumns(steps)
    frames = frames.withColumns({f"{p}_{n}_before": F.lag(f"{p}_{n}").over(w) for p in ("my", "op") for n in ("lx", "ly", "rx", "ry", "sx", "sy", "cx")})
    for p in ("my", "op"):
        col = lambda n, p=p: F.col(f"{p}_{n}")
        step = lambda n: length(col(f"{n}x") - col(f"{n}x_before"), col(f"{n}y") - col(f"{n}y_before"))  # noqa: B023, E731
        far = F.greatest(length(col("lx"), col("ly")), length(col("rx"), col("ry")))
        moves |= {f"{p}_ext": F.when((col("th") >= 0.01) & far.isNotNull(), far / col("th")).otherwise(0.0), f"{p}_acc": F.coalesce(F.greatest(step("l"), step("r")), F.lit(0.0)), f"{p}_bd": F.coalesce(step("s"), F.lit(0.0))}
    return frames.withColumns(moves)


def quantiles(moved: DataFrame) -> DataFrame:
    """(session, ext_p90, acc_p90, median_h) over both sides."""
    rows = moved.select("session", F.inline(F.array(*(F.struct(F.col(f"{p}_ext").alias("ext"), F.col(f"{p}_acc").alias("acc"), (F.get(f"{p}_bbox", 3) - F.get(f"{p}_bbox", 1)).alias("h")) for p in ("my", "op")))))
    positive = lambda n: F.when(F.col(n) > 0, F.col(n))
    ext, acc = (series.nearest_rank(rows, ["session"], positive(n), 0.9, f"{n}_p90") for n in ("ext", "acc"))
    return rows.select("session").distinct().join(ext, "session", "left").join(acc, "session", "left").join(series.nearest_rank(rows, ["session"], F.col("h"), 0.5, "median_h"), "session", "left")


def guard_of(p: str, config: Config) -> tuple[Column, Column]:
    """(score, whether it is a defensive frame): of all wrists that are seen, or of the one nearer to the shoulders while
    the other punches; .5 where nothing can be told."""
    punch = F.col(f"{p}_punch")
    left, right = ((F.col(f"{p}_w{h}y") <= F.col(f"{p}_sy") + config.v2_guard_slack).cast("double") for h in "lr")
    both = mean_known(left, right)
    dl, dr = (length(F.col(f"{p}_{h}x"), F.col(f"{p}_{h}y")) for h in "lr")
    nearer = F.when(right.isNull() | (dl <= dr), left).otherwise(right)
    unseen = F.col(f"{p}_sx").isNull()
    return F.when(unseen, 0.5).otherwise(F.coalesce(F.when(punch, nearer).otherwise(both), F.lit(0.5))), unseen | ~punch


def signals(frames: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per frame with punch, activity, guard, advance, retreat, cornered and aggressing flags of each side."""
    f = motions(frames)
    f = f.join(quantiles(f), "session")
    punches = {}
    for p in ("my", "op"):
        score = config.v2_weights[0] * (F.col(f"{p}_ext") / F.greatest(F.coalesce("ext_p90", F.lit(0.30)), F.lit(0.01))) + config.v2_weights[1] * (F.col(f"{p}_acc") / F.greatest(F.coalesce("acc_p90", F.lit(0.10)), F.lit(0.001)))
        punches[f"{p}_punch"] = (F.col(f"{p}_acc") >= F.coalesce("median_h", F.lit(0.3)) * config.v2_accel_floor) & (score > config.v2_threshold)
    f = f.withColumns(punches)
    flags = {}
    for p, q in PAIRS:
        move = (F.col(f"{p}_cx") - F.col(f"{p}_cx_before")) * F.when(F.col(f"{q}_cx") > F.col(f"{p}_cx"), 1.0).when(F.col(f"{q}_cx").isNotNull(), -1.0)
        flags |= {f"{p}_adv": F.coalesce(move > config.v2_advance, F.lit(False)), f"{p}_ret": F.coalesce(move < -config.v2_advance, F.lit(False)), f"{p}_cornered": F.coalesce((F.col(f"{p}_cx") < config.ropes[0]) | (F.col(f"{p}_cx") > config.ropes[1]), F.lit(False))}
        flags[f"{p}_act"] = F.col(f"{p}_bd") + 1.5 * F.col(f"{p}_acc")
        flags[f"{p}_guard"], flags[f"{p}_def"] = guard_of(p, config)
    f = f.withColumns(flags)
    return f.withColumns({f"{p}_aggressing": F.col(f"{p}_punch") | (F.col(f"{p}_adv") & (F.col(f"{q}_cornered") | (F.col(f"{q}_ret") & ~F.col(f"{q}_punch")))) for p, q in PAIRS} | {"sec": F.floor("time_s").cast("int"), "duration": (F.floor(F.max("time_s").over(Window.partitionBy("session"))) + 1).cast("int")})


def pressing(f: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(session, sec, my_press, op_press): who moved toward the other while the gap closed, first half against second half
    of the frames within .75 s of the second. A frame goes to the few seconds that it is near to."""
    half = config.v2_window_s / 2
    near = f.where("my_cx is not null and op_cx is not null").select("session", "fi", "my_cx", "op_cx", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.col("time_s") - half).cast("int")), F.floor(F.col("time_s") + half).cast("int"))).alias("sec"), "duration").where("sec < duration")
    w = Window.partitionBy("session", "sec")
    near = near.withColumns({"i": F.row_number().over(w.orderBy("fi")), "n": F.count(F.lit(1)).over(w)}).where("n >= 3")
    early = F.col("i") <= F.floor(F.col("n") / 2)
    halves = near.groupBy("session", "sec").agg(*(F.avg(F.when(when, F.col(f"{p}_cx"))).alias(f"{p}{k}") for p in ("my", "op") for k, when in ((1, early), (2, ~early))))
    closed = F.abs(F.col("my1") - F.col("op1")) > F.abs(F.col("my2") - F.col("op2"))
    toward = lambda p, q: (F.col(f"{p}2") - F.col(f"{p}1")) * F.when(F.col(f"{q}1") > F.col(f"{p}1"), 1.0).otherwise(-1.0)
    return halves.select("session", "sec", *((closed & (toward(p, q) > config.v2_move)).alias(f"{p}_press") for p, q in PAIRS))


def pace(f: DataFrame, spine: DataFrame) -> DataFrame:
    """(session, sec, my_raw, op_raw): 80th percentile of the activity in the seconds around, full while pressing or
    punching, .3 of it in retreat, else .6; null with fewer than 3 samples. spine: (session, sec, my_press, op_press)."""
    wide = F.floor(F.greatest(F.lit(5), F.least(F.lit(15), F.floor(F.col("duration") / 6))) / 2).cast("int")
    acts = f.select("session", "sec", "duration", F.inline(F.array(*(F.struct(F.lit(p).alias("side"), F.col(f"{p}_act").alias("act"), F.col(f"{p}_punch").alias("punch")) for p in ("my", "op"))))).where("act > 0")
    spread = acts.select("session", "side", "act", "punch", F.explode(F.sequence(F.greatest(F.lit(0), F.col("sec") - wide), F.least(F.col("duration") - 1, F.col("sec") + wide))).alias("sec"))
    own, other = (F.when(F.col("side") == "my", F.col(f"{a}_press")).otherwise(F.col(f"{b}_press")) for a, b in (("my", "op"), ("op", "my")))
    weight = F.when(other & ~own, 0.3).when(own | F.col("punch"), 1.0).otherwise(0.6)
    ranked = series.nearest_rank(spread.join(spine, ["session", "sec"]).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("session", "sec", "side"))).where("n >= 3"), ["session", "sec", "side"], F.col("act") * weight, 0.8, "p80")
    return ranked.groupBy("session", "sec").agg(*(F.max(F.when(F.col("side") == p, F.col("p80"))).alias(f"{p}_raw") for p in ("my", "op")))


def per_second(f: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(session, sec) over the dense spine with pace, aggression, guard, ring and control of both sides. f: signals."""
    spine = f.groupBy("session").agg(F.max("duration").alias("duration")).select("session", F.explode(F.sequence(F.lit(0), F.col("duration") - 1)).alias("sec"))
    spine = spine.join(pressing(f, config), ["session", "sec"], "left").fillna(False, ["my_press", "op_press"])
    sums = {"cli": F.avg(F.col("clinch").cast("double"))}
    for p in ("my", "op"):
        of = lambda when, p=p: F.coalesce(F.avg(F.when(when, F.col(f"{p}_guard"))), F.lit(0.5))
        sums |= {f"{p}_aggression": percent(F.count_if(f"{p}_aggressing") / F.count(F.lit(1)) * 100), f"{p}_guard": percent((config.v2_guard_mix[0] * of(F.col(f"{p}_def")) + config.v2_guard_mix[1] * of(~F.col(f"{p}_def"))) * 100)}
    own = f.groupBy("session", "sec").agg(*(v.alias(k) for k, v in sums.items()))
    out = spine.join(own, ["session", "sec"], "left").join(pace(f, spine), ["session", "sec"], "left")
    out = out.fillna({"my_aggression": 0, "op_aggression": 0, "my_guard": 50, "op_guard": 50, "cli": 0.0})
    out = out.withColumns({f"{p}_raw": series.carried(F.col(f"{p}_raw"), 0.001, ["session"], "sec") for p in ("my", "op")})
    peak = F.greatest(F.max(F.greatest("my_raw", "op_raw")).over(Window.partitionBy("session")), F.lit(0.001))
    out = out.withColumns({f"{p}_pace": F.greatest(F.lit(1), percent(F.col(f"{p}_raw") / peak * 100)) for p in ("my", "op")})
    a, b, k = config.v2_ring_weights
    hold = {p: a * F.col(f"{p}_press").cast("double") + b * (1 - (F.col(f"{q}_press") & ~F.col(f"{p}_press")).cast("double")) + k * (1 - F.col("cli")) for p, q in PAIRS}
    out = out.withColumn("my_ring", F.when(hold["my"] + hold["op"] > 0, percent(hold["my"] / (hold["my"] + hold["op"]) * 100)).otherwise(50)).withColumn("op_ring", 100 - F.col("my_ring"))
    blend = {p: sum(x * F.col(f"{p}_{n}") for x, n in zip(config.v2_control_weights, ("aggression", "ring", "pace", "guard"))) / 100 for p in ("my", "op")}
    out = out.withColumn("my_control", F.when(blend["my"] + blend["op"] > 0, percent(blend["my"] / (blend["my"] + blend["op"]) * 100)).otherwise(50)).withColumn("op_control", 100 - F.col("my_control"))
    return out.select("session", "sec", *(f"{p}_{s}" for p in ("my", "op") for s in SERIES))


def summary(frames: DataFrame, fps: float = 15.0, config: Config = DEFAULT) -> DataFrame:
    """One row per session of at least 4 frames: the mean of each series, punches apart by more than the dedup gap, and
    seconds with a clinch. frames: session, fi, time_s, kps and bbox of both sides, clinch."""
    frames = frames.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("session"))).where("_n >= 4").drop("_n")
    f = signals(frames, config)
    means = per_second(f, config).groupBy("session").agg(F.count(F.lit(1)).cast("int").alias("duration_s"), *(percent(F.avg(f"{p}_{s}")).alias(f"{p}_{s}") for p in ("my", "op") for s in SERIES))
    gap, w = max(2, round(fps * config.v2_dedup_s)), window().rowsBetween(Window.unboundedPreceding, -1)
    starts = f.withColumns({f"_{p}": F.col("fi") - F.last(F.when(F.col(f"{p}_punch"), F.col("fi")), ignorenulls=True).over(w) for p in ("my", "op")})
    counts = starts.groupBy("session").agg(*(F.count_if(F.col(f"{p}_punch") & (F.col(f"_{p}").isNull() | (F.col(f"_{p}") > gap))).alias(f"{p}_punches") for p in ("my", "op")), F.count_distinct(F.when(F.col("clinch"), F.col("sec"))).alias("clinch_seconds"), F.count(F.lit(1)).alias("n_frames"))
    return means.join(counts, "session")
