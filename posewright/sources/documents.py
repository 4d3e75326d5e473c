"""Session documents as relations, and relations as documents. All paths are read and written by Spark."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of the documents.
FRAMES_SCHEMA = "fps_pose double, fps_orig double, stride_pose int, stride_sam2 int, frame_w int, frame_h int, identity_swapped boolean, frames array<struct<fi:int,raw_fi:int,time_s:double,my_bbox:array<double>,op_bbox:array<double>,my_kps:array<array<double>>,op_kps:array<array<double>>,clinch:boolean>>"
ARENA_SCHEMA = "ok boolean, frame_w int, frame_h int, centroid array<double>, axis_len double, minor_len double, median_scale_px double, median_fighter_height_px double, my_visibility_score double, op_visibility_score double, confidence_tier string, warps_to_ref array<array<array<double>>>, my_traj_ref array<array<double>>, op_traj_ref array<array<double>>"
#: Fields of a session's status in their order; those without a default are null where missing.
STATUS = (
    "status", "progress", "metrics", "annotated_ready", "error", "punch_events_count", "audio_diag", "audio_error", "overlay_error",
    "sam2_status", "sam2_model", "sam2_fps_eff", "sam2_my_tracked", "sam2_op_tracked", "sam2_frames",
    "sam2_test_status", "sam2_test_error", "sam2_test_model", "sam2_test_fps", "sam2_test_my_tracked", "sam2_test_op_tracked", "sam2_test_frames", "sam2_test_progress", "analysis_status",
)
STATUS_TYPES = {"progress": "double", "annotated_ready": "boolean", "punch_events_count": "long", "metrics": "variant", "audio_diag": "variant"} | {f: "long" for f in STATUS if f.endswith(("_tracked", "_frames"))} | {f: "double" for f in STATUS if f.endswith(("_eff", "_fps", "_progress"))}
#: Fractions of a video at which picker frames are sampled.
FRACTIONS = (0.10, 0.22, 0.35, 0.48, 0.61, 0.75)


def session_of_path() -> Column:
    """The folder that holds the file."""
    return F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)


def documents(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One row per file with its session; files that are no JSON are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(glob).withColumn("session", session_of_path())


def frames(spark: SparkSession, glob: str) -> DataFrame:
    """One row per frame with the document's header; fps_pose is 15 and the frame's size 1 where missing."""
    docs = documents(spark, glob, FRAMES_SCHEMA)
    return docs.select("session", F.coalesce("fps_pose", F.lit(15.0)).alias("fps_pose"), F.coalesce("frame_w", F.lit(1)).alias("frame_w"), F.coalesce("frame_h", F.lit(1)).alias("frame_h"), F.inline("frames"))


def arena(spark: SparkSession, glob: str) -> DataFrame:
    """One row per session; a scale of 0 or none falls back to the fighters' height, then to 100."""
    a = documents(spark, glob, ARENA_SCHEMA)
    scale = F.coalesce(F.nullif("median_scale_px", F.lit(0.0)), F.nullif("median_fighter_height_px", F.lit(0.0)), F.lit(100.0))
    return a.select("session", F.get("centroid", 0).alias("centre_x"), F.get("centroid", 1).alias("centre_y"), scale.alias("scale"), F.coalesce("my_visibility_score", F.lit(0.0)).alias("my_seen"), F.coalesce("op_visibility_score", F.lit(0.0)).alias("op_seen"), F.coalesce("confidence_tier", F.lit("none")).alias("tier"))


def arena_frames(spark: SparkSession, glob: str) -> DataFrame:
    """(session, fi, warp, my_ref, op_ref): the arena's arrays by position, the shorter ones null at their ends."""
    zipped = F.arrays_zip(F.col("warps_to_ref").alias("warp"), F.col("my_traj_ref").alias("my_ref"), F.col("op_traj_ref").alias("op_ref"))
    return documents(spark, glob, ARENA_SCHEMA).select("session", F.posexplode(zipped).alias("fi", "r")).select("session", "fi", "r.warp", "r.my_ref", "r.op_ref")


def status(spark: SparkSession, glob: str, progress: DataFrame | None = None) -> DataFrame:
    """(session, body): each session's status as a JSON document with all fields of STATUS. progress: (session,
    sam2_test_progress) where a test run tells it elsewhere. Nested documents stay what they are, as VARIANT."""
    meta = documents(spark, glob, ", ".join(f"{f} {STATUS_TYPES.get(f, 'string')}" for f in STATUS))
    if progress is not None:
        meta = meta.drop("sam2_test_progress").join(progress, "session", "left")
    known = {"progress": F.coalesce("progress", F.lit(0.0)), "annotated_ready": F.coalesce("annotated_ready", F.lit(False))}
    return meta.select("session", F.to_json(F.struct(*(known.get(f, F.col(f)).alias(f) for f in STATUS)), {"ignoreNullFields": "false"}).alias("body"))


def with_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sessions of `left` of which `right` has a document too."""
    return left.join(right.select("session").distinct(), "session", "left_semi")


def keyed_boxes(df: DataFrame, column: str) -> DataFrame:
    """Detections of a JSON map from frame to [x1, y1, x2, y2, conf] rows; what does not parse gives none."""
    boxes = df.select("session", F.explode(F.from_json(column, "map<string,array<array<double>>>")).alias("frame", "boxes"))
    rows = boxes.select("session", F.expr("try_cast(frame as int)").alias("frame_idx"), F.posexplode("boxes").alias("place", "b"))
    return rows.select("session", "frame_idx", "place", *(F.get("b", k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2", "conf"))))


def sampled(df: DataFrame, fps: float, stride: int, cap_s: float = 300.0) -> DataFrame:
    """Every stride-th raw frame of the first `cap_s` seconds."""
    return df.where((F.pmod("raw_fi", F.lit(stride)) == 0) & (F.col("raw_fi") <= fps * cap_s))


def fraction_frames(df: DataFrame, total: str = "total_frames") -> DataFrame:
    """(session, frac, raw_fi): the frames at fixed fractions of each session's length."""
    return df.select("session", F.explode(F.array(*map(F.lit, FRACTIONS))).alias("frac"), F.col(total).alias("_n")).select("session", "frac", (F.col("_n") * F.col("frac")).cast("int").alias("raw_fi"))


def snapshots(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV snapshots of any generation in one relation: columns a file lacks are null; all cells are strings."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.option("header", True).csv(p) for p in paths])


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object a row, in a folder for each session."""
    df.write.mode("overwrite").partitionBy("session").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The fields in fixed order under a header."""
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir; only in local mode may it be unset."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="posewright-"))


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str = "session") -> None:
    """Replaces the partitions of the changed keys and leaves the others; a field that is null in the change keeps its
    old value. Needs a table that was written with partitionBy(key)."""
    checkpoint_folder(spark)
    old = spark.read.parquet(path).withColumn(key, F.col(key).cast(changes.schema[key].dataType))
    fields = [c for c in old.columns if c != key]
    prior = old.join(changes.select(key), key, "left_semi").select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    merged = changes.join(prior, key, "left").select(*(F.coalesce(c, f"_{c}").alias(c) if c in changes.columns else F.col(f"_{c}").alias(c) for c in fields), key)
    # what is overwritten is read for it, so the rows are settled in the shared folder first
    merged.checkpoint().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
