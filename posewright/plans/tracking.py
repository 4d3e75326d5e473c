"""The tracker over the poses view, as detections of a video in pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posewright.fixtures import poses
from posewright.functions import columns as c
from posewright.functions.perception import pixels
from posewright.operators.tracker import track_batch

WIDE, TALL = 1280, 720


def video(spark, d) -> DataFrame:
    """(session, fi, cut, boxes, looks) and the picked boxes and looks of the first frame. Mine is seen only where much
    of the pose is, a bystander stands at the side, and a jump of my box counts as a cut."""
    p = poses(spark, d)
    w = Window.partitionBy("session").orderBy("fi")
    det = lambda s: F.struct(pixels(F.col(f"{s}_bbox"), WIDE, TALL).cast("array<double>").alias("box"), look(F.col(f"{s}_kps")).alias("look"))
    look = lambda kps: F.transform(kps, lambda k: k[2])
    aside = F.struct(F.transform(pixels(F.col("my_bbox"), WIDE, TALL), lambda x, i: F.when(i % 2 == 0, x / 3 + 800).otherwise(x * 0.9)).alias("box"), F.reverse(look(F.col("my_kps"))).alias("look"))
    dets = F.filter(F.array(F.when(c.visibility(F.col("my_kps")) >= 0.4, det("my")), F.when(F.col("op_bbox").isNotNull(), det("op")), aside), lambda x: x.isNotNull())
    first: Column = F.row_number().over(w) == 1
    start = lambda s, part: F.when(first, det(s)[part])
    cut = F.coalesce(F.abs(F.get("my_bbox", 0) - F.lag(F.get("my_bbox", 0)).over(w)) > 0.25, F.lit(False))
    rows = p.select("session", "fi", cut.alias("cut"), dets.alias("dets"), start("my", "box").alias("my_start"), start("op", "box").alias("op_start"), start("my", "look").alias("my_look"), start("op", "look").alias("op_look"))
    return rows.select("session", "fi", "cut", F.col("dets.box").alias("boxes"), F.col("dets.look").alias("looks"), F.lit(float(WIDE)).alias("w"), F.lit(float(TALL)).alias("h"), "my_start", "op_start", "my_look", "op_look")


def track_fighters(spark, d) -> DataFrame:
    """Two fighters by assignment, coasting, likeness and search; a state machine, so it has no SQL."""
    t = track_batch(video(spark, d))
    return t.select("session", "fi", "clinch", "my_pick", "op_pick", "my_coast", "op_coast", F.round("my_conf", 6).alias("my_conf"), F.round("op_conf", 6).alias("op_conf"), "my_reliable", "op_reliable", *(F.get(f"{s}_box", k).alias(f"{s}{k}") for s in ("my", "op") for k in range(4)))


QUERIES = {"track_fighters": track_fighters}
ORACLES: dict[str, str] = {}
