"""Times the headline queries over BENCH_SF_DIR on local[BENCH_CPUS]; prints one line of JSON.

Each query's whole result goes to a sink that keeps nothing. The first query runs once beforehand, so that no figure
holds the start of the JVM. The session keeps more generated classes than Spark does by default and records no Python
call sites in plans: both cost time for each query and none for each row.

The tables hold too few frames for a throughput, so `flagship_many_sessions` times the flagship over BENCH_COPIES
copies of all sessions, each a session of its own, read from Parquet; it is not part of the total.
"""

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posewright.plans import arena_metrics, event_queries, pose_queries

HEADLINE = (
    "flagship_arena_metrics", "arena_series", "landed_events", "punch_score", "verdict_tally", "state_classify", "density_grid", "greedy_iou_assign",
    "side_share_per_bucket", "dense_spine_default", "occlusion_decay", "local_peaks", "centred_window_p80_carry", "half_split_pressing", "recent5_asof", "asof_bracket_lerp", "interval_argmax", "snapshot_full_outer_diff",
    "set_difference_topk", "dedup_replace", "one_euro_smooth", "kalman_track", "true_median_scale", "centroid_principal_axis", "content_hash_dedup",
)


def many_sessions(frames: DataFrame, copies: int) -> DataFrame:
    """Each session `copies` times under a session number of its own."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    return frames.withColumn("_copy", copy).withColumn("session", F.xxhash64("session", "_copy")).drop("_copy")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = event_queries.QUERIES | pose_queries.QUERIES

    def timed(name: str) -> float:
        began = time.perf_counter()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    timed(HEADLINE[0])
    took = {name: timed(name) for name in HEADLINE}
    frames = pose_queries.poses(spark, sf).count()
    copies, folder = int(os.environ.get("BENCH_COPIES", "300")), tempfile.mkdtemp(prefix="posewright-bench-") + "/frames"
    many_sessions(pose_queries.poses(spark, sf), copies).repartition(int(cpus), "session").write.parquet(folder)
    began = time.perf_counter()
    arena_metrics.summary(spark.read.parquet(folder)).write.format("noop").mode("overwrite").save()
    many = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf).name.removeprefix("sf"), "flagship_frames_per_sec": round(frames / took[HEADLINE[0]]), "flagship_many_sessions": {"frames": frames * copies, "sec": many, "frames_per_sec": round(frames * copies / many)}}))


if __name__ == "__main__":
    main()
