"""Column builders for detections, pickers and overlays: what the signal formulas need around a tracker's boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posewright.config import DEFAULT, EAR_R, ELBOW_L, ELBOW_R, HIP_L, HIP_R, SHOULDER_L, SHOULDER_R, WRIST_L, WRIST_R, Config
from posewright.functions import columns as c

#: Hosts whose addresses are refused.
BLOCKED_HOSTS = ("youtube.com", "youtu.be", "www.youtube.com", "m.youtube.com")
#: The fractions of a clip at which rows are shown, late ones denser.
LATE_FRACTIONS = (0.10, 0.30, 0.55, 0.80, 0.92, 0.99)


def area(box: Column) -> Column:
    return (F.get(box, 2) - F.get(box, 0)) * (F.get(box, 3) - F.get(box, 1))


def height(box: Column, default: float = 0.3) -> Column:
    return F.coalesce(F.get(box, 3) - F.get(box, 1), F.lit(default))


def primary_place(box: Column, width: float, tall: float) -> Column:
    """Centre along the axis on which the two stand apart, as a fraction: vertical in portrait, else horizontal."""
    return c.box_centre(box, 1) / tall if tall > 1.2 * width else c.box_centre(box, 0) / width


def ring_score(box: Column, width: float, tall: float) -> Column:
    """Area, less where the centre is far from the middle."""
    off = F.abs(primary_place(box, width, tall) - 0.5) - 0.25
    return area(box) * F.greatest(F.lit(0.05), 1.0 - F.greatest(F.lit(0.0), off) * 5.0)


def size_score(box: Column, expected: Column) -> Column:
    """1 for a plausible height, less for far too small or far too large boxes."""
    ratio = (F.get(box, 3) - F.get(box, 1)) / expected
    return F.when(expected.isNull() | (expected <= 0), 1.0).when(ratio < 0.55, F.greatest(F.lit(0.05), ratio / 0.55)).when(ratio > 1.80, F.greatest(F.lit(0.30), 1.80 / ratio)).otherwise(1.0)


def on_ropes(box: Column, width: float, tall: float, config: Config = DEFAULT) -> Column:
    place = primary_place(box, width, tall)
    return (place < config.ropes[0]) | (place > config.ropes[1])


def fallback_box(x: Column, y: Column, width: float, tall: float) -> Column:
    """Box of usual proportions around a point, in whole pixels."""
    w, h = width * 0.15, tall * 0.40
    return F.array(*(e.cast("int") for e in (x - w / 2, y - h / 2, x + w / 2, y + h / 2)))


def prompt_points(x: Column, y: Column, tall: float) -> Column:
    """Head, chest and belly points of a person centred there, inside the frame."""
    return F.array(F.array(x, F.greatest(F.lit(4.0), y - 60)), F.array(x, y), F.array(x, F.least(F.lit(tall - 4.0), y + 45)))


def confidence(coast: Column, detected: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - coast * 0.20) * F.when(detected, 1.0).otherwise(0.85)


def reliable(coast: Column, *cooldowns: Column) -> Column:
    out = coast == 0
    for x in cooldowns:
        out &= x == 0
    return out


def match_score(predicted: Column, box: Column, appearance: Column, expected: Column, reach: float) -> Column:
    """Place and looks of a candidate for a track, scaled by the plausibility of its size; looks count .5 if unknown."""
    overlap = c.iou(predicted, box)
    apart = c.distance(c.box_centre(predicted, 0), c.box_centre(predicted, 1), c.box_centre(box, 0), c.box_centre(box, 1))
    place = F.when(overlap > 0, overlap).otherwise(F.greatest(F.lit(0.0), 1.0 - apart / reach) * 0.25)
    return (0.28 * place + 0.72 * F.coalesce(appearance, F.lit(0.5))) * size_score(box, expected)


def clinch_by_width(a: Column, b: Column) -> Column:
    """Centres within a quarter of both widths together."""
    apart = c.distance(c.box_centre(a, 0), c.box_centre(a, 1), c.box_centre(b, 0), c.box_centre(b, 1))
    return F.coalesce(apart < (F.get(a, 2) - F.get(a, 0) + F.get(b, 2) - F.get(b, 0)) / 4, F.lit(False))


def clinch_by_height(a: Column, b: Column, tall: Column) -> Column:
    """Boxes overlap, or centres stand within about half a height."""
    apart = c.distance(c.box_centre(a, 0), c.box_centre(a, 1), c.box_centre(b, 0), c.box_centre(b, 1))
    return F.coalesce((c.iou(a, b) > 0.20) | (apart < tall * 0.55), F.lit(False))


def blended_box(a: Column, b: Column, t: Column) -> Column:
    """Box between two at t from 0 to 1; the other where one is missing."""
    return F.coalesce(F.zip_with(a, b, lambda x, y: x + (y - x) * t), a, b)


def scaled_box(box: Column, width: float, tall: float) -> Column:
    return F.transform(box, lambda x, i: x * F.when(i % 2 == 0, width).otherwise(tall))


def pixels(box: Column, width: float, tall: float) -> Column:
    return F.transform(scaled_box(box, width, tall), lambda x: x.cast("int"))


def safe_number(x: Column, fallback: float) -> Column:
    """A positive finite number, else the fallback; text that is no number counts as none."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v == float("inf")) | (v <= 0), fallback).otherwise(v)


def corrected_rate(rate: Column, frames: Column, elapsed_ms: Column) -> Column:
    """Frames a second from the time of the last frame, where that is long enough and plausible."""
    real = frames / (elapsed_ms / 1000.0)
    return F.when((elapsed_ms > 500) & (frames > 10) & (real > 10.0) & (real < 240.0), real).otherwise(rate)


def time_label(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def is_blocked(url: Column) -> Column:
    return F.exists(F.array(*map(F.lit, BLOCKED_HOSTS)), lambda h: F.contains(url, h))


def marker(x: Column, y: Column) -> Column:
    """(x, y, text) of a centre mark: where it is if that is on the canvas, else at the edge with arrows."""
    on = x.between(-0.02, 1.02) & y.between(-0.02, 1.02)
    sideways = F.when(x > 1, "→").when(x < 0, "←").otherwise("")
    upright = F.when(y > 1, "↓").when(y < 0, "↑").otherwise("")
    return F.struct(F.when(on, x).otherwise(c.clamp(x, 0.03, 0.97)).alias("x"), F.when(on, y).otherwise(c.clamp(y, 0.05, 0.95)).alias("y"), F.when(~on, F.concat(F.lit("CENTER off "), sideways, upright)).alias("text"))


def pixel_points(kps: Column, width: float, tall: float) -> Column:
    """Keypoints in whole pixels, null where not confident."""
    return F.transform(kps, lambda k: F.when(k[2] >= DEFAULT.kp_conf, F.struct((k[0] * width).cast("int").alias("x"), (k[1] * tall).cast("int").alias("y"))))


def _known(points: Column, *which: int) -> Column:
    return F.filter(F.array(*(F.get(points, i) for i in which)), lambda p: p.isNotNull())


def _halved(x: Column) -> Column:
    return F.floor(x / 2).cast("int")


def pixel_head(points: Column, box: Column) -> Column:
    """[x1, y1, x2, y2] in pixels from the box's top to the shoulders, at least .45 of the box wide."""
    face, shoulders = _known(points, *range(EAR_R + 1)), _known(points, SHOULDER_L, SHOULDER_R)
    x = F.floor(F.aggregate(face, F.lit(0), lambda a, p: a + p["x"]) / F.size(face)).cast("int")
    bottom, top = F.array_min(F.transform(shoulders, lambda p: p["y"])), F.get(box, 1)
    half = F.greatest(_halved(F.greatest(bottom - top, F.lit(20))), _halved(((F.get(box, 2) - F.get(box, 0)) * 0.45).cast("int")))
    return F.when((F.size(face) > 0) & (F.size(shoulders) > 0), F.array(x - half, top, x + half, bottom))


def pixel_stomach(points: Column, box: Column) -> Column:
    """[x1, y1, x2, y2] in pixels from the armpits to the hips, at least .40 of the box wide, a tenth wider at each side."""
    shoulders, hips = _known(points, SHOULDER_L, SHOULDER_R), _known(points, HIP_L, HIP_R)
    xs = F.transform(shoulders, lambda p: p["x"])
    top, low = F.array_min(F.transform(shoulders, lambda p: p["y"])), F.array_max(F.transform(hips, lambda p: p["y"]))
    least = ((F.get(box, 2) - F.get(box, 0)) * 0.40).cast("int")
    narrow, middle = F.array_max(xs) - F.array_min(xs) < least, _halved(F.array_min(xs) + F.array_max(xs))
    left, right = F.when(narrow, middle - _halved(least)).otherwise(F.array_min(xs)), F.when(narrow, middle + _halved(least)).otherwise(F.array_max(xs))
    pad = F.greatest(F.lit(4), ((right - left) * 0.10).cast("int"))
    return F.when((F.size(shoulders) > 0) & (F.size(hips) > 0), F.array(left - pad, top + ((low - top) * 0.20).cast("int"), right + pad, low))


def wrist_contact(zone: Column, attacker: Column, defender: Column, reach: float) -> Column:
    """Struct hit, blocked: whether a wrist of the attacker is in the zone without, or with, an arm of the defender near it."""
    wrists, arms = _known(attacker, WRIST_L, WRIST_R), _known(defender, ELBOW_L, ELBOW_R, WRIST_L, WRIST_R)
    radius = F.greatest(F.lit(20), F.get(zone, 2) - F.get(zone, 0)) * reach
    inside = F.filter(wrists, lambda w: w["x"].between(F.get(zone, 0), F.get(zone, 2)) & w["y"].between(F.get(zone, 1), F.get(zone, 3)))
    guarded = lambda w: F.exists(arms, lambda a: F.hypot(a["x"] - w["x"], a["y"] - w["y"]) < radius)
    return F.struct(F.coalesce(F.exists(inside, lambda w: ~guarded(w)), F.lit(False)).alias("hit"), F.coalesce(F.exists(inside, guarded), F.lit(False)).alias("blocked"))


def intensity(speed: Column, top: Column, conf: Column) -> tuple[Column, Column]:
    """(value, class) of a punch against the fastest one."""
    v = 0.6 * (speed / (top + 1e-9)) + 0.4 * conf
    return v, F.when(v > 0.65, "HARD").when(v > 0.35, "MED").otherwise("LIGHT")


def effective_punches(thrown: Column, landed: Column) -> Column:
    return 3 * landed + F.greatest(F.lit(0), thrown - landed)
