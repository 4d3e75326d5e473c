"""Column builders for poses, boxes and shares: plain expressions, no UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from posewright.config import ANKLE_L, ANKLE_R, DEFAULT, EAR_L, EAR_R, EYE_L, EYE_R, HIP_L, HIP_R, NOSE, SHOULDER_L, SHOULDER_R, Config


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def normed(x: Column, scale: float) -> Column:
    return clamp(x / max(scale, 1e-6))


def keypoint(kps: Column, i: int, axis: int, conf: float = DEFAULT.kp_conf) -> Column:
    """Coordinate of a keypoint, null where it is missing or not confident."""
    return F.when(F.get(F.get(kps, i), 2) >= conf, F.get(F.get(kps, i), axis))


def middle(kps: Column, a: int, b: int, axis: int) -> Column:
    return (keypoint(kps, a, axis) + keypoint(kps, b, axis)) * 0.5


def shoulder_centre(kps: Column, axis: int) -> Column:
    return middle(kps, SHOULDER_L, SHOULDER_R, axis)


def torso_height(kps: Column) -> Column:
    return distance(shoulder_centre(kps, 0), shoulder_centre(kps, 1), middle(kps, HIP_L, HIP_R, 0), middle(kps, HIP_L, HIP_R, 1))


def head_position(kps: Column, axis: int) -> Column:
    """Nose, else the middle of the eyes."""
    return F.when(keypoint(kps, NOSE, 0).isNotNull(), keypoint(kps, NOSE, axis)).otherwise(middle(kps, EYE_L, EYE_R, axis))


def visibility(kps: Column, conf: float = DEFAULT.kp_conf) -> Column:
    return F.when(kps.isNull(), 0.0).otherwise(F.size(F.filter(kps, lambda k: F.get(k, 2) >= conf)) / 17.0)


def box_centre(box: Column, axis: int) -> Column:
    return (F.get(box, axis) + F.get(box, axis + 2)) * 0.5


def upright(box: Column, config: Config = DEFAULT) -> Column:
    """Whether a box is tall enough for its lower edge and height to tell of feet and body."""
    return (F.get(box, 3) - F.get(box, 1)) / (F.get(box, 2) - F.get(box, 0)) >= config.upright


def foot_points(kps: Column, box: Column, edge: float | None = None, config: Config = DEFAULT) -> Column:
    """Array of (x, y): the confident ankles and the middle of an upright box's lower edge. edge: from this y on a box
    counts as cut off by the frame's border and gives no point; None where boxes may leave the frame."""
    ankle = lambda i: F.when(F.get(F.get(kps, i), 2) > config.ankle_conf, F.struct(F.get(F.get(kps, i), 0).alias("x"), F.get(F.get(kps, i), 1).alias("y")))
    stands = upright(box, config) if edge is None else upright(box, config) & (F.get(box, 3) < edge)
    points = F.array(ankle(ANKLE_L), ankle(ANKLE_R), F.when(stands, F.struct(box_centre(box, 0).alias("x"), F.get(box, 3).alias("y"))))
    return F.filter(points, lambda q: q.isNotNull())


def frame_scale(kps: Column, box: Column, config: Config = DEFAULT) -> Column:
    """Largest of 2.2 torsos, 2.6 shoulder widths (without hips only) and an upright box's height; 0 without any."""
    width = distance(*(keypoint(kps, i, a) for i in (SHOULDER_L, SHOULDER_R) for a in (0, 1)))
    torso, height = config.scale_torso * torso_height(kps), F.get(box, 3) - F.get(box, 1)
    return F.coalesce(F.greatest(torso, F.when(middle(kps, HIP_L, HIP_R, 0).isNull(), config.scale_shoulders * width), F.when(upright(box, config), height)), F.lit(0.0))


def mean_of(points: Column, axis: str) -> Column:
    """Mean coordinate of an array of points, null without any."""
    return F.try_divide(F.aggregate(points, F.lit(0.0), lambda s, q: s + q[axis]), F.size(points))


def iou(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Intersection over union of [x1, y1, x2, y2]; 0 for a missing box. floor: least area that counts for a box."""
    side = lambda k: F.greatest(F.least(F.get(a, k + 2), F.get(b, k + 2)) - F.greatest(F.get(a, k), F.get(b, k)), F.lit(0.0))
    area = lambda x: F.greatest(F.greatest(F.get(x, 2) - F.get(x, 0), F.lit(0.0)) * F.greatest(F.get(x, 3) - F.get(x, 1), F.lit(0.0)), F.lit(floor))
    inter = side(0) * side(1)
    union = area(a) + area(b) - inter
    return F.when(a.isNull() | b.isNull(), 0.0).when((inter > 0) & (union > 1e-9), inter / union).otherwise(0.0)


def in_box(x: Column, y: Column, box: Column, pad: float = 0.0) -> Column:
    inside = x.between(F.get(box, 0) - pad, F.get(box, 2) + pad) & y.between(F.get(box, 1) - pad, F.get(box, 3) + pad)
    return F.coalesce(inside, F.lit(False))


def glove_tip(wrist: Column, elbow: Column, extension: float = DEFAULT.glove_extension) -> Column:
    return F.coalesce(wrist + extension * (wrist - elbow), wrist)


def head_zone(kps: Column, box: Column, aspect: float = 1.0) -> Column:
    """[x1, y1, x2, y2] of the head target, visually square and inside the box; null if it can't be told."""
    k = lambda i, axis: keypoint(kps, i, axis)
    height = F.get(box, 3) - F.get(box, 1)
    top = F.get(box, 1)
    shoulders = F.coalesce((k(SHOULDER_L, 1) + k(SHOULDER_R, 1)) * 0.5, k(SHOULDER_L, 1), k(SHOULDER_R, 1))
    bottom = shoulders - F.greatest(0.01 * height, 0.10 * (shoulders - top))
    head = bottom - top
    centre = box_centre(box, 0)
    face = F.coalesce(k(EAR_L, 0), k(EAR_R, 0), k(EYE_L, 0), k(EYE_R, 0))
    x = F.coalesce(k(NOSE, 0), (k(EYE_L, 0) + k(EYE_R, 0)) * 0.5, (k(EAR_L, 0) + k(EAR_R, 0)) * 0.5, (centre + face) * 0.5, centre)
    half = head / max(aspect, 1e-6) / 2.0
    x = F.greatest(F.get(box, 0) + half, F.least(F.get(box, 2) - half, x))
    return F.when((height >= 0.04) & shoulders.isNotNull() & (head >= 0.02), F.array(x - half, top, x + half, bottom))


def stomach_zone(kps: Column, aspect: float = 1.0, config: Config = DEFAULT) -> Column:
    """[x1, y1, x2, y2] of the body target between shoulders and hips."""
    sx, sy, hx, hy = shoulder_centre(kps, 0), shoulder_centre(kps, 1), middle(kps, HIP_L, HIP_R, 0), middle(kps, HIP_L, HIP_R, 1)
    top = sy + config.stomach_top * (hy - sy)
    half, x = (hy - top) / max(aspect, 1e-6) / 2.0, (sx + hx) * 0.5
    return F.when((hy > sy) & (hy - top >= 0.02), F.array(x - half, top, x + half, hy))


def share(a: Column, b: Column, floor: float = 1e-6) -> Column:
    """Percent of a in a + b, half to even, 50 where there is nothing to share."""
    return F.when(a + b > floor, F.bround(100 * a / (a + b))).otherwise(50).cast("int")


def tier(score: Column, config: Config = DEFAULT) -> Column:
    return reduce(lambda c, x: c.when(score >= x[1], x[0]), config.tier_limits[1:], F.when(score >= config.tier_limits[0][1], config.tier_limits[0][0])).otherwise("none")


def pull_to_neutral(score: Column, seen: Column, config: Config = DEFAULT) -> Column:
    """A score is drawn to 50 where little was visible."""
    return F.when(seen >= config.visibility_knee, score).otherwise(F.bround(50 + (score - 50) * clamp(seen / config.visibility_knee))).cast("int")
