"""Scores of a session against its arena: the flagship plan.

Frames and the arena's tracks come in as relations keyed by session; every window, peak and sum is partitioned by
session, so one exchange of the per-frame signals serves them all. Per-second shares are rounded before they are
averaged over the dense spine of seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posewright.config import DEFAULT, Config
from posewright.functions import columns as c
from posewright.operators import geometry, series
from posewright.plans import pose_frames as pf

#: States of a frame.
STATES = ("open", "close", "clinch", "occlusion")


def with_feet(frames: DataFrame, edge: float | None = None, config: Config = DEFAULT) -> DataFrame:
    """Adds each side's foot points as p_feet."""
    return frames.withColumns({f"{p}_feet": c.foot_points(F.col(f"{p}_kps"), F.col(f"{p}_bbox"), edge, config) for p in ("my", "op")})


def arena_of(frames: DataFrame, edge: float | None = None, config: Config = DEFAULT) -> DataFrame:
    """(session, centre_x, centre_y, axis_len, scale, my_seen, op_seen, tier): the arena where no stabilised one is given.

    Centre and axis are those of all foot points, null and 0 below three of them. The scale is the median of both sides'
    frame scales that are not 0, else 0. A side is seen in the frames in which it has a foot point; the tier goes by the
    frames in which either has one.
    """
    f, none = with_feet(frames, edge, config), F.lit(None).cast("double")
    seen = lambda p: (F.size(f"{p}_feet") > 0).cast("double")
    row = lambda x, y, size, my, op: F.struct(x.alias("x"), y.alias("y"), size.alias("size"), my.alias("my"), op.alias("op"))
    sizes = [F.nullif(c.frame_scale(F.col(f"{p}_kps"), F.col(f"{p}_bbox"), config), F.lit(0.0)) for p in ("my", "op")]
    # points, sizes and what is seen as rows of one relation, so that one aggregation has moments, median and shares
    rows = F.concat(F.transform(F.concat("my_feet", "op_feet"), lambda q: row(q["x"], q["y"], none, none, none)), F.array(row(none, none, sizes[0], seen("my"), seen("op")), row(none, none, sizes[1], none, none)))
    either = F.avg(F.greatest("my", "op"))
    more = {"n_points": F.count("x"), "scale": F.coalesce(F.median("size"), F.lit(0.0)), "my_seen": F.avg("my"), "op_seen": F.avg("op"), "feet_seen": either}
    axis = geometry.principal_axis(f.select("session", F.inline(rows)), ["session"], "x", "y", more)
    known = lambda n, default: F.when(F.col("n_points") >= 3, F.col(n)).otherwise(default)
    return axis.select("session", known("cx", None).alias("centre_x"), known("cy", None).alias("centre_y"), known("axis_len", 0.0).alias("axis_len"), "scale", "my_seen", "op_seen", c.tier(F.col("feet_seen")).alias("tier"))


def tracks_of(frames: DataFrame, edge: float | None = None, config: Config = DEFAULT) -> DataFrame:
    """Adds each side's place on the floor: the mean of its foot points, null without any."""
    f = with_feet(frames, edge, config)
    return f.withColumns({f"{p}_{a}": c.mean_of(F.col(f"{p}_feet"), a) for p in ("my", "op") for a in ("x", "y")}).drop("my_feet", "op_feet")


def signals(frames: DataFrame, arena: DataFrame, fps: float = 15.0, config: Config = DEFAULT) -> DataFrame:
    """One row per frame with every signal that the scores sum up."""
    scale = F.coalesce(F.nullif("scale", F.lit(0.0)), F.lit(100.0))
    f = tracks_of(frames).join(arena, "session", "left")
    f = pf.motions(pf.bodies(f), config)
    for p in ("my", "op"):
        f = f.withColumn(f"{p}_to_centre", c.distance(F.col(f"{p}_x"), F.col(f"{p}_y"), F.col("centre_x"), F.col("centre_y")) / scale)
    f = pf.states(f, c.distance(F.col("my_x"), F.col("my_y"), F.col("op_x"), F.col("op_y")) / scale, config)
    w = pf.window()
    before = lambda n: F.lag(n).over(w)
    f = f.withColumns({f"{p}_path": F.coalesce(c.distance(F.col(f"{p}_x"), F.col(f"{p}_y"), before(f"{p}_x"), before(f"{p}_y")) / scale, F.lit(0.0)) for p in ("my", "op")} | {"_closing": before("apart") - F.col("apart")})
    total = F.greatest(F.col("my_path") + F.col("op_path"), F.lit(1e-6))
    f = f.withColumns({f"{p}_closing": F.coalesce(F.col("_closing") * F.col(f"{p}_path") / total, F.lit(0.0)) for p in ("my", "op")})
    found = {}
    for p, q in pf.PAIRS:
        n = lambda x, s, p=p: c.normed(F.col(f"{p}_{x}"), s)
        mix = lambda weights, *parts: sum((k * v for k, v in zip(weights[1:], parts[1:])), weights[0] * parts[0])
        advance, forced = (F.col(f"{p}_closing") > config.advance_eps).cast("double"), (F.col(f"{q}_closing") < -config.advance_eps).cast("double")
        found[f"{p}_aggression"] = (
            F.when(F.col("state") == "open", mix(config.aggression_open, n("score", config.norm_punch), advance, forced))
            .when(F.col("state") == "close", mix(config.aggression_close, n("wrist", config.norm_wrist), n("score", config.norm_punch), n("push", config.norm_push)))
            .when(F.col("state") == "clinch", mix(config.aggression_clinch, n("wrist", config.norm_wrist), n("head_move", config.norm_head), n("push", config.norm_push)))
        )
        ramp = F.coalesce(c.clamp((F.col("apart") - config.defence_near) / (config.defence_far - config.defence_near)), F.lit(0.0))
        pillars = {"dist": ramp, "head": n("head_move", config.defence_head_norm), "guarded": F.coalesce(f"{p}_guard", F.lit(0.0)), "counter": n("wrist", config.defence_counter_norm)}
        found |= {f"{p}_{k}": v for k, v in pillars.items()} | {f"{p}_defence": mix(config.defence_weights, *pillars.values())}
    f = f.withColumns(found)
    for p in ("my", "op"):
        f = pf.with_peaks(f, p, fps, config)
    return f.withColumns({f"{p}_attacked": series.mark_around(None, ["session"], F.col(f"{q}_peak"), config.defence_before, config.defence_after) & (F.col("state") != "occlusion") for p, q in pf.PAIRS})


def percent(x: Column) -> Column:
    """Half to even after the last bits of a sum's order are cut off."""
    return F.bround(F.round(x, 9)).cast("int")


SCORES = ("ring", "aggression", "movement", "volume", "defence", "head_movement", "guard")
PILLARS = ("dist", "head", "guarded")
#: Verdicts on a punch.
VERDICTS = ("landed_head", "landed_body", "missed", "unknown")


def seconds_seen(f: DataFrame, aspect: float = 1.0, config: Config = DEFAULT) -> DataFrame:
    """One row per session and second with frames: shares, state and punches by verdict."""
    weights = F.element_at(F.create_map(*(x for k, v in config.tier_weights.items() for x in (F.lit(k), F.lit(v)))), F.coalesce("tier", F.lit("none")))
    known = F.col("my_to_centre").isNotNull() & F.col("op_to_centre").isNotNull()
    total = lambda x: F.round(F.sum(x), 9)
    sums = {"_n": F.count(F.lit(1)), "_last": F.max("time_s"), "_hidden": F.count_if(F.col("state") == "occlusion"), "_my_near": F.count_if(known & (F.col("my_to_centre") < F.col("op_to_centre"))), "_op_near": F.count_if(known & (F.col("my_to_centre") >= F.col("op_to_centre")))}
    sums |= {"tier": F.first("tier"), "my_seen": F.first("my_seen"), "op_seen": F.first("op_seen")}
    sums |= {f"_{s}_n": F.count_if(F.col("state") == s) for s in STATES} | {f"_{s}_first": F.min(F.when(F.col("state") == s, F.col("fi"))) for s in STATES}
    f = pf.with_verdicts(f, aspect, config)
    for p in ("my", "op"):
        sums |= {f"_{p}_agg": F.coalesce(total(f"{p}_aggression"), F.lit(0.0)), f"_{p}_path": total(F.col(f"{p}_path") * weights), f"_{p}_vol": F.count_if(f"{p}_punching"), f"_{p}_head": total(f"{p}_head_move"), f"_{p}_guard": F.avg(f"{p}_guard"), f"_{p}_def": F.coalesce(F.round(F.avg(F.when(F.col(f"{p}_attacked"), F.col(f"{p}_defence"))), 9), F.lit(0.5))}
        sums |= {f"{p}_{k}_pct": percent(100 * F.avg(F.when(F.col(f"{p}_attacked"), F.col(f"{p}_{k}")))) for k in PILLARS} | {f"{p}_{v}": F.count_if(F.col(f"{p}_peak") & (F.col(f"{p}_verdict") == v)) for v in VERDICTS}
    by_sec = f.groupBy("session", F.floor("time_s").alias("sec")).agg(*(v.alias(k) for k, v in sums.items()))
    held = F.col("_hidden") / F.col("_n") >= 0.5
    share = lambda n, floor=1e-6: c.share(F.col(f"_my_{n}"), F.col(f"_op_{n}"), floor)
    by_sec = by_sec.withColumns({
        "my_ring": share("near", 0), "my_movement": share("path"), "my_volume": share("vol", 0), "my_defence": share("def"), "my_head_movement": share("head"),
        "my_guard": F.coalesce(percent(100 * F.col("_my_guard")), F.lit(50)), "op_guard": F.coalesce(percent(100 * F.col("_op_guard")), F.lit(50)),
        "my_aggression": series.decayed(F.bround(100 * F.col("_my_agg") / (F.col("_my_agg") + F.col("_op_agg"))), ~held & (F.col("_my_agg") + F.col("_op_agg") > 1e-6), held, ["session"], "sec", config.decay_tau_s),
        # the most frequent state, the first seen of equally frequent ones
        "state": F.array_max(F.array(*(F.struct(F.col(f"_{s}_n").alias("n"), (-F.col(f"_{s}_first")).alias("first"), F.lit(s).alias("s")) for s in STATES)))["s"],
    })
    return by_sec.withColumns({f"op_{s}": 100 - F.col(f"my_{s}") for s in SCORES[:-1]}).drop(*(k for k in sums if k.startswith("_") and k != "_last"))


def last_second() -> Column:
    """Of a session: the time of its last frame, rounded up; the spine runs to it."""
    return F.ceil(F.max("_last").over(Window.partitionBy("session")))


def per_second(f: DataFrame, aspect: float = 1.0, config: Config = DEFAULT) -> DataFrame:
    """One row per session and second of the dense spine with all shares; 50 and an open state where there is nothing."""
    defaults = dict.fromkeys([*(f"{p}_{s}" for p in ("my", "op") for s in (*SCORES, *(f"{k}_pct" for k in PILLARS)))], 50) | {"state": "open"}
    seen = seconds_seen(f, aspect, config).withColumn("_end", last_second())
    return series.fill_gaps(seen, "session", "sec", F.col("_end"), defaults).select("session", "sec", *defaults)


def landed(f: DataFrame, aspect: float = 1.0, config: Config = DEFAULT) -> DataFrame:
    """(session, side, fi, time_s, verdict, glove_x, glove_y) of every punch, both sides in one pass."""
    peaks = pf.with_verdicts(f.where("my_peak or op_peak"), aspect, config)
    rows = [F.when(F.col(f"{p}_peak"), F.struct(F.lit(p).alias("side"), F.col(f"{p}_verdict").alias("verdict"), F.col(f"{p}_glove_x").alias("glove_x"), F.col(f"{p}_glove_y").alias("glove_y"))) for p in ("my", "op")]
    return peaks.select("session", "fi", "time_s", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("session", "r.side", "fi", "time_s", "r.verdict", "r.glove_x", "r.glove_y")


def tally(events: DataFrame) -> DataFrame:
    """Counts by verdict and the accuracy of each side; null without a decided punch."""
    counts = events.groupBy("session", "side").agg(F.count(F.lit(1)).alias("punches"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))
    return counts.withColumn("accuracy", accuracy(*(F.col(v) for v in VERDICTS[:3])))


def accuracy(head: Column, body: Column, missed: Column) -> Column:
    decided = head + body + missed
    return F.when(decided > 0, F.bround(100 * (head + body) / decided)).cast("int")


def summary(frames: DataFrame, arena: DataFrame | None = None, fps: float = 15.0, aspect: float = 1.0, config: Config = DEFAULT) -> DataFrame:
    """One row per session of at least 4 frames with all its scores.

    The mean over the dense spine is a sum over the seconds that have frames and 50 for each other one, so the spine
    itself is never made: one exchange by session serves every window and both aggregations.
    """
    enough = frames.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("session"))).where("_n >= 4").drop("_n")
    arena = arena_of(enough) if arena is None else arena
    seen = seconds_seen(signals(enough, arena, fps, config), aspect, config)
    spine, n = F.greatest(F.lit(1), F.ceil(F.max("_last")) + 1), F.count(F.lit(1))
    mean = [percent((F.sum(f"{p}_{s}") + 50 * (spine - n)) / spine).alias(f"{p}_{s}") for s in SCORES for p in ("my", "op")]
    state = [F.bround(100 * (F.count_if(F.col("state") == s) + (spine - n if s == "open" else 0)) / spine).cast("int").alias(f"{s}_share") for s in STATES]
    out = seen.groupBy("session").agg(spine.cast("int").alias("duration_s"), *mean, *state, *(F.first(x).alias(x) for x in ("tier", "my_seen", "op_seen")), *(F.sum(f"{p}_{v}").alias(f"{p}_{v}") for p in ("my", "op") for v in VERDICTS))
    out = out.withColumns({f"{p}_{s}": c.pull_to_neutral(F.col(f"{p}_{s}"), F.col(f"{p}_seen"), config) for s in ("ring", "aggression", "movement", "defence") for p in ("my", "op")})
    out = out.withColumns({f"{p}_punches": sum((F.col(f"{p}_{v}") for v in VERDICTS[1:]), F.col(f"{p}_{VERDICTS[0]}")) for p in ("my", "op")} | {f"{p}_accuracy": accuracy(*(F.col(f"{p}_{v}") for v in VERDICTS[:3])) for p in ("my", "op")})
    return out.drop("my_seen", "op_seen")
