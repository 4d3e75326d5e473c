"""Scores of the classic metric family, in pixels: punches by the wrist's own speed, guard, advance and ring events of each
frame, their sums by second of ordinal frames, pace by a wide percentile window, and a round score of weighted periods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posewright.config import SHOULDER_L, SHOULDER_R, WRIST_L, WRIST_R
from posewright.functions import columns as c
from posewright.functions import perception
from posewright.operators import series
from posewright.plans.arena_metrics import percent
from posewright.plans.pose_frames import PAIRS, window
from posewright.plans.pressure_metrics import length, mean_known

SERIES = ("pace", "punches", "guard", "advance", "ring", "aggression", "control")


@dataclass(frozen=True)
class Classic:
    # fixed values of the family
    kp_conf: float = 0.40
    punch_share: float = 0.21
    guard_slack: float = 0.08
    wrist_weight: float = 1.5
    centre: tuple = (0.35, 0.65)
    advance: float = 0.07
    burst_s: int = 5
    burst_elite: float = 0.18
    pace_quantile: float = 0.8
    aggression: tuple = (0.60, 0.40)
    control: tuple = (0.40, 0.35, 0.25)
    period: tuple = (0.45, 0.35, 0.20)
    period_s: int = 15
    period_power: float = 1.3
    unknown_height: float = 0.40


def detected(kps: Column, i: int, axis: int, config: Classic) -> Column:
    """Coordinate of a keypoint that is confident and not at the origin, else null."""
    p = F.get(kps, i)
    return F.when((F.get(p, 2) >= config.kp_conf) & ~((F.get(p, 0) <= 0) & (F.get(p, 1) <= 0)), F.get(p, axis))


def signals(frames: DataFrame, width: float, tall: float, fps: float, landed: DataFrame | None = None, config: Classic = Classic()) -> DataFrame:
    """One row per frame with activity, wrist speeds and events of both sides. frames: session, fi, kps and bbox of both
    sides in pixels, both boxes known; my_reliable and op_reliable, where given, tell which heights count. landed: (session, side, fi) of punches that are known to have landed."""
    portrait, w = tall > 1.2 * width, window()
    dim, axis = (tall, "y") if portrait else (width, "x")
    first = {}
    for p in ("my", "op"):
        k = lambda i, a, p=p: detected(F.col(f"{p}_kps"), i, a, config)
        for a, n in ((0, "x"), (1, "y")):
            first |= {f"{p}_s{n}": mean_known(k(SHOULDER_L, a), k(SHOULDER_R, a)), f"{p}_l{n}": k(WRIST_L, a), f"{p}_r{n}": k(WRIST_R, a), f"{p}_c{n}": c.box_centre(F.col(f"{p}_bbox"), a)}
    f = frames.withColumns(first).withColumn("i", (F.row_number().over(w) - 1).cast("int"))
    f = f.withColumns({f"{p}_{v}{n}_before": F.lag(f"{p}_{v}{n}").over(w) for p in ("my", "op") for v in "slrc" for n in "xy"})
    speeds = {}
    for p in ("my", "op"):
        d = lambda v, n, p=p: F.col(f"{p}_{v}{n}") - F.col(f"{p}_{v}{n}_before")
        sway = {n: F.coalesce(d("s", n), F.lit(0.0)) for n in "xy"}
        speeds |= {f"{p}_{h}_speed": F.coalesce(length(d(h, "x") - sway["x"], d(h, "y") - sway["y"]), F.lit(0.0)) for h in "lr"}  # noqa: B023
        speeds[f"{p}_move"] = length(d("c", "x"), d("c", "y"))
    f = f.withColumns(speeds).withColumns({f"{p}_speed": F.greatest(f"{p}_l_speed", f"{p}_r_speed") for p in ("my", "op")})
    trusted = lambda p: F.coalesce(f"{p}_reliable", F.lit(True)) if f"{p}_reliable" in frames.columns else F.lit(True)
    heights = f.select("session", F.explode(F.array(*(F.when(trusted(p), F.get(f"{p}_bbox", 3) - F.get(f"{p}_bbox", 1)) for p in ("my", "op")))).alias("h"))
    f = f.join(series.nearest_rank(heights, ["session"], F.col("h"), 0.5, "ref_h"), "session", "left").withColumn("ref_h", F.coalesce("ref_h", F.lit(tall * config.unknown_height)))
    place = {p: F.col(f"{p}_c{axis}") for p in ("my", "op")}
    step = dim * config.advance / max(fps, 1)
    toward = {"my": F.when(place["op"] > place["my"], 1.0).otherwise(-1.0)}
    toward["op"] = -toward["my"]
    low, high = (x * dim for x in config.centre)
    centred = {p: place[p].between(low, high) for p in place}
    ropes = {p: perception.on_ropes(F.col(f"{p}_bbox"), width, tall) for p in place}
    off = {p: F.abs(place[p] / dim - 0.5) for p in place}
    events = {}
    for p, q in PAIRS:
        move = (place[p] - F.col(f"{p}_c{axis}_before")) * toward[p]
        wrists = F.filter(F.array(F.col(f"{p}_ly"), F.col(f"{p}_ry")), lambda y: y.isNotNull())
        down = F.coalesce((F.size(wrists) > 0) & F.forall(wrists, lambda y: y > F.col(f"{p}_sy") + tall * config.guard_slack), F.lit(False))  # noqa: B023
        events |= {
            f"{p}_act": F.coalesce((F.col(f"{p}_move") + config.wrist_weight * F.col(f"{p}_speed")) / dim, F.lit(0.0)), f"{p}_punch": F.col(f"{p}_speed") > F.col("ref_h") * config.punch_share,
            f"{p}_up": ~down, f"{p}_adv": F.coalesce(move > step, F.lit(False)), f"{p}_ret": F.coalesce(move < -step, F.lit(False)), f"{p}_ropes": ropes[p],
            f"{p}_centre": centred[p] & ~centred[q], f"{p}_ring": (centred[p] & ~centred[q]) | ropes[q] | ((off[p] < off[q]) & ~ropes[p]),
        }
    f = f.withColumns(events)
    f = f.withColumns({f"{p}_aggressing": F.col(f"{p}_punch") | (F.col(f"{p}_adv") & (F.col(f"{q}_ropes") | (F.col(f"{q}_ret") & ~F.col(f"{q}_punch")))) for p, q in PAIRS})
    if landed is None:
        return f.withColumns({f"{p}_landed": F.lit(False) for p in ("my", "op")})
    hits = landed.groupBy("session", "fi").agg(*(F.bool_or(F.col("side") == p).alias(f"{p}_landed") for p in ("my", "op")))
    return f.join(hits, ["session", "fi"], "left").fillna(False, ["my_landed", "op_landed"])


def pace(f: DataFrame, fps_int: int, config: Classic) -> DataFrame:
    """(session, sec, my_raw, op_raw): percentile of the positive activity within a wide window around each second; null
    with fewer than 3 samples. A frame goes to the seconds whose window holds it, 31 at most."""
    reach = F.least(F.lit(15), F.greatest(F.lit(5), F.floor(F.col("n_secs") / 6))) * fps_int
    acts = f.select("session", "i", "n_secs", F.inline(F.array(*(F.struct(F.lit(p).alias("side"), F.col(f"{p}_act").alias("act")) for p in ("my", "op"))))).where("act > 0")
    near = acts.select("session", "side", "act", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("i") - reach) / fps_int).cast("int")), F.least(F.col("n_secs") - 1, F.floor((F.col("i") + reach) / fps_int).cast("int")))).alias("sec"))
    found = near.groupBy("session", "sec", "side").agg(F.percentile("act", config.pace_quantile).alias("v"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return found.groupBy("session", "sec").agg(*(F.max(F.when(F.col("side") == p, F.col("v"))).alias(f"{p}_raw") for p in ("my", "op")))


def per_second(f: DataFrame, fps: float, audio: bool = False, config: Classic = Classic()) -> DataFrame:
    """(session, sec, n_secs) and all series of both sides. audio: landed punches count three times."""
    fps_int, whole = max(1, round(fps)), Window.partitionBy("session")
    f = f.withColumn("n_secs", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(whole) / fps_int)).cast("int"))
    f = f.withColumn("sec", F.floor(F.col("i") / fps_int).cast("int"))
    share = lambda flag: percent(F.count_if(flag) / F.count(F.lit(1)) * 100)
    sums = {f"{p}_{n}": share(f"{p}_{v}") for p in ("my", "op") for n, v in (("guard", "up"), ("advance", "adv"), ("ring", "ring"))}
    for p in ("my", "op"):
        thrown, hit = F.count_if(f"{p}_punch"), F.count_if(f"{p}_landed")
        sums[f"_{p}"] = perception.effective_punches(thrown, hit) if audio else thrown
    out = f.where("sec < n_secs").groupBy("session", "sec", "n_secs").agg(*(v.alias(k) for k, v in sums.items()))
    out = out.join(pace(f, fps_int, config), ["session", "sec"], "left")
    out = out.withColumns({f"{p}_raw": series.carried(F.col(f"{p}_raw"), 0.0, ["session"], "sec") for p in ("my", "op")})
    peak = lambda n, floor: F.greatest(F.max(F.greatest(f"my_{n}" if n == "raw" else "_my", f"op_{n}" if n == "raw" else "_op")).over(whole), F.lit(floor))
    out = out.withColumns({"_top": peak("raw", 1e-9), "_most": peak("punches", 1)})
    out = out.withColumns({f"{p}_{n}": percent(v / F.col(t) * 100) for p in ("my", "op") for n, v, t in (("pace", F.col(f"{p}_raw"), "_top"), ("punches", F.col(f"_{p}"), "_most"))})
    blend = lambda weights, *names: sum(k * F.col(n) for k, n in zip(weights, names))
    out = out.withColumns({f"{p}_aggression": percent(blend(config.aggression, f"{p}_punches", f"{p}_advance")) for p in ("my", "op")})
    my, op = (blend(config.control, f"{p}_ring", f"{p}_aggression", f"{p}_pace") for p in ("my", "op"))
    out = out.withColumn("my_control", F.when(my + op < 0.5, 50).otherwise(percent(my / (my + op) * 100))).withColumn("op_control", 100 - F.col("my_control"))
    return out.select("session", "sec", "n_secs", *(f"{p}_{s}" for p in ("my", "op") for s in SERIES))


def periods(seconds: DataFrame, config: Classic = Classic()) -> DataFrame:
    """(session, period, share, weight, start, end): the own share of each scoring period, its weight and its seconds; the
    last seconds that fill no period are left out, as the family has it."""
    n = F.greatest(F.lit(2), F.floor(F.col("n_secs") / config.period_s)).cast("int")
    k = seconds.withColumn("k", n).withColumn("size", F.greatest(F.lit(1), F.floor(F.col("n_secs") / F.col("k"))).cast("int"))
    spine = k.select("session", "k", "size", "n_secs").distinct().select("session", "size", "n_secs", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("period"))
    own = k.withColumn("period", F.floor(F.col("sec") / F.col("size")).cast("int")).groupBy("session", "period").agg(*(F.avg(f"{p}_{s}").alias(f"{p}_{s}") for p in ("my", "op") for s in ("control", "aggression", "pace")))
    own = spine.join(own, ["session", "period"], "left").fillna(0.0)
    bounds = F.col("period") * F.col("size"), F.least("n_secs", (F.col("period") + 1) * F.col("size"))
    part = lambda s: F.col(f"my_{s}") / F.greatest(F.col(f"my_{s}") + F.col(f"op_{s}"), F.lit(1.0))
    a, b, d = config.period
    weight = F.pow(F.col("period") + 1.0, F.lit(config.period_power))
    return own.select("session", "period", (a * F.col("my_control") / 100 + b * part("aggression") + d * part("pace")).alias("share"), (weight / F.sum(weight).over(Window.partitionBy("session"))).alias("weight"), bounds[0].alias("start"), bounds[1].alias("end"))


def summary(frames: DataFrame, width: float, tall: float, fps: float = 15.0, landed: DataFrame | None = None, config: Classic = Classic()) -> DataFrame:
    """One row per session: burst, aggression, guard, stamina, ring and round scores of both sides."""
    f = signals(frames, width, tall, fps, landed, config)
    seconds = per_second(f, fps, landed is not None, config)
    win, whole = max(1, int(fps * config.burst_s)), Window.partitionBy("session")
    moving = window().rowsBetween(0, win - 1)
    f = f.withColumns({f"_{p}_burst": F.when(F.col("i") <= F.greatest(F.lit(0), F.count(F.lit(1)).over(whole) - win), F.sum(f"{p}_act").over(moving)) for p in ("my", "op")})
    share = lambda flag, n: percent(F.count_if(flag) / F.greatest(n, F.lit(1)) * 100)
    later, n = F.col("i") >= 1, F.count(F.lit(1))
    scores = {}
    for p in ("my", "op"):
        scores |= {f"{p}_burst": F.least(F.lit(100), F.greatest(F.lit(1), percent(F.max(f"_{p}_burst") / (fps * config.burst_s * config.burst_elite) * 100))), f"{p}_aggression": share(later & F.col(f"{p}_aggressing"), n - 1), f"{p}_guard": share(f"{p}_up", n), f"{p}_ring": share(f"{p}_centre", n)}
    out = f.groupBy("session").agg(*(v.alias(k) for k, v in scores.items()))
    seg = F.greatest(F.lit(1), F.floor(F.col("n_secs") / 3))
    thirds = seconds.groupBy("session", "n_secs").agg(*(F.avg(F.when(when, F.col(f"{p}_pace"))).alias(f"_{p}{k}") for p in ("my", "op") for k, when in ((1, F.col("sec") < seg), (2, F.col("sec") >= F.col("n_secs") - seg))))
    stamina = lambda p: F.when(F.col("n_secs") >= 6, F.when(F.col(f"_{p}1") <= 0, 100).otherwise(F.least(F.lit(100), percent(F.col(f"_{p}2") / F.col(f"_{p}1") * 100))))
    out = out.join(thirds.select("session", stamina("my").alias("my_stamina"), stamina("op").alias("op_stamina")), "session")
    scored = periods(seconds, config).groupBy("session").agg(percent(F.sum(F.col("share") * F.col("weight")) * 100).alias("my_round"))
    return out.join(scored.withColumn("op_round", 100 - F.col("my_round")), "session")
