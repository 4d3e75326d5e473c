"""Per-frame signals of two participants: one pass of windows keyed by session, all plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posewright.config import ELBOW_L, ELBOW_R, WRIST_L, WRIST_R, DEFAULT, Config
from posewright.functions import columns as c
from posewright.operators import series

PAIRS = (("my", "op"), ("op", "my"))
W = ("session",)


def window():
    return Window.partitionBy("session").orderBy("fi")


def bodies(frames: DataFrame) -> DataFrame:
    """Adds for each side p: shoulders (scx, scy), torso th, wrists relative to the shoulders (lx, ly, rx, ry), head
    relative to the shoulders (hx, hy), box centre (cx, cy), box height bh and visibility vis."""
    out = {}
    for p in ("my", "op"):
        kps, box = F.col(f"{p}_kps"), F.col(f"{p}_bbox")
        sx, sy = c.shoulder_centre(kps, 0), c.shoulder_centre(kps, 1)
        out |= {
            f"{p}_scx": sx, f"{p}_scy": sy, f"{p}_th": c.torso_height(kps), f"{p}_vis": c.visibility(kps),
            f"{p}_lx": c.keypoint(kps, WRIST_L, 0) - sx, f"{p}_ly": c.keypoint(kps, WRIST_L, 1) - sy, f"{p}_rx": c.keypoint(kps, WRIST_R, 0) - sx, f"{p}_ry": c.keypoint(kps, WRIST_R, 1) - sy,
            f"{p}_hx": c.head_position(kps, 0) - sx, f"{p}_hy": c.head_position(kps, 1) - sy, f"{p}_cx": c.box_centre(box, 0), f"{p}_cy": c.box_centre(box, 1), f"{p}_bh": F.get(box, 3) - F.get(box, 1),
        }
    return frames.withColumns(out)


def motions(frames: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds for each side: punching, punch score, wrist activity, head move, box push, guard (null if unknown)."""
    w = window()
    lagged = {f"{p}_{n}_before": F.lag(f"{p}_{n}").over(w) for p in ("my", "op") for n in ("lx", "ly", "rx", "ry", "hx", "hy", "cx", "cy")}
    frames = frames.withColumns(lagged)
    steps = {}
    for p in ("my", "op"):
        col = lambda n, p=p: F.col(f"{p}_{n}")
        for h in "lr":
            vx, vy = col(f"{h}x") - col(f"{h}x_before"), col(f"{h}y") - col(f"{h}y_before")
            steps |= {f"{p}_{h}vx": vx, f"{p}_{h}vy": vy, f"{p}_{h}v": F.sqrt(vx * vx + vy * vy), f"{p}_{h}ext": F.when(col("th") > 1e-6, F.sqrt(col(f"{h}x") * col(f"{h}x") + col(f"{h}y") * col(f"{h}y")) / col("th"))}
        for name, a, b in (("head_move", "hx", "hy"), ("push", "cx", "cy")):
            dx, dy = col(a) - col(f"{a}_before"), col(b) - col(f"{b}_before")
            steps[f"{p}_{name}"] = F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
        height = F.greatest(col("bh"), F.lit(0.10))
        steps[f"{p}_zoom"] = F.when(height < config.punch_bbox_height, F.least(F.lit(config.punch_zoom_cap), config.punch_bbox_height / height)).otherwise(1.0)
        guard = lambda h: F.when(col("th") > 0, c.clamp(1.0 - (col(f"{h}y") / col("th") + 0.1)))  # noqa: E731, B023
        known = F.filter(F.array(guard("l"), guard("r")), lambda g: g.isNotNull())
        steps[f"{p}_guard"] = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, g: a + g) / F.size(known))
    frames = frames.withColumns(steps)
    scores = {}
    for p, q in PAIRS:
        col = lambda n, p=p: F.col(f"{p}_{n}")
        tx, ty = F.col(f"{q}_cx") - col("cx"), F.col(f"{q}_cy") - col("cy")
        toward = F.sqrt(tx * tx + ty * ty)

        def wrist(h: str) -> Column:
            speed = col(f"{h}v") * col("zoom")  # noqa: B023
            along = (col(f"{h}vx") * tx + col(f"{h}vy") * ty) / (speed * toward)  # noqa: B023
            direction = F.when(F.coalesce(toward, F.lit(0.0)) < 1e-6, 0.5).otherwise(F.greatest(F.lit(config.punch_direction_floor), F.least(F.lit(1.0), (along + 1) / 2)))  # noqa: B023
            return F.when(speed >= 1e-6, col(f"{h}ext") * speed * direction)  # noqa: B023

        scores[f"{p}_score"] = F.coalesce(F.greatest(wrist("l"), wrist("r")), F.lit(0.0))
        scores[f"{p}_wrist"] = F.coalesce(F.greatest(col("lv"), col("rv")), F.lit(0.0))
        scores[f"{p}_punching"] = F.coalesce((F.greatest(col("lext"), col("rext")) >= config.punch_extension) & (F.greatest(col("lv"), col("rv")) >= config.punch_accel), F.lit(False))
    return frames.withColumns(scores)


def states(frames: DataFrame, apart: Column, config: Config = DEFAULT) -> DataFrame:
    """Adds the state of each frame. apart: distance of the two in body heights, null if unknown."""
    hidden = (F.col("my_vis") < config.occluded_fraction) | (F.col("op_vis") < config.occluded_fraction)
    return frames.withColumn("apart", apart).withColumn(
        "state", F.when(hidden, "occlusion").when(c.iou(F.col("my_bbox"), F.col("op_bbox")) >= config.clinch_iou, "clinch").when(F.col("apart") < config.close_distance, "close").otherwise("open")
    )


def with_verdicts(frames: DataFrame, aspect: float = 1.0, config: Config = DEFAULT) -> DataFrame:
    """Adds for each side p: p_verdict, p_glove_x and p_glove_y of its punch at the other, by the more extended wrist
    alone, the left one of equal ones. Zones and wrists become columns first, so no formula holds another's copy."""
    first = {"_overlap": c.iou(F.col("my_bbox"), F.col("op_bbox"))}
    for p in ("my", "op"):
        kps, box = F.col(f"{p}_kps"), F.col(f"{p}_bbox")
        first |= {f"_{p}_headzone": c.head_zone(kps, box, aspect), f"_{p}_bodyzone": c.stomach_zone(kps, aspect, config)}
        first |= {f"_{p}_{h}most": F.coalesce(F.col(f"{p}_{h}ext"), F.lit(-1.0)) for h in "lr"}
    frames = frames.withColumns(first)
    tips = {}
    for p in ("my", "op"):
        kps = F.col(f"{p}_kps")
        for axis, n in ((0, "x"), (1, "y")):
            left, right = (c.glove_tip(c.keypoint(kps, w, axis), c.keypoint(kps, e, axis), config.glove_extension) for w, e in ((WRIST_L, ELBOW_L), (WRIST_R, ELBOW_R)))
            tips[f"_{p}_tip_{n}"] = F.when(F.col(f"_{p}_lmost") >= F.col(f"_{p}_rmost"), left).otherwise(right)
    frames = frames.withColumns(tips)
    found = {}
    for p, q in PAIRS:
        head, body, x, y = F.col(f"_{q}_headzone"), F.col(f"_{q}_bodyzone"), F.col(f"_{p}_tip_x"), F.col(f"_{p}_tip_y")
        unknown = (F.col("_overlap") >= config.landed_clinch_iou) | (head.isNull() & body.isNull()) | (F.greatest(f"_{p}_lmost", f"_{p}_rmost") < config.landed_extension)
        found[f"{p}_verdict"] = F.when(unknown, "unknown").when(c.in_box(x, y, head, config.wrist_pad), "landed_head").when(c.in_box(x, y, body, config.wrist_pad), "landed_body").otherwise("missed")
        found |= {f"{p}_glove_x": F.when(~unknown, x), f"{p}_glove_y": F.when(~unknown, y)}
    return frames.withColumns(found).drop(*first, *tips)


def with_peaks(frames: DataFrame, p: str, fps: float = 15.0, config: Config = DEFAULT) -> DataFrame:
    """Adds p_peak: frames of p's punches, the peaks of the score."""
    return series.with_peaks(frames, list(W), f"{p}_score", config.punch_score, max(1, round(config.punch_separation_s * fps)), f"{p}_peak")
