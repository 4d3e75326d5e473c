"""Regression runs: scores of all lab sessions as a snapshot, and its differences from an earlier one.

A run reads the documents of a folder of sessions (SRC2), scores them, writes a CSV of fixed columns (SNK4) and compares
it with the CSV of any earlier generation (SRC3, J7); columns that one of them lacks are left out of the comparison.
A session that can't be scored stays as a row with its reason.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posewright.config import DEFAULT, Config
from posewright.fixtures import poses
from posewright.operators.relations import snapshot_diff
from posewright.plans import arena_metrics, pose_queries
from posewright.sources import documents

# fixed values: the columns of a snapshot in their order, and the scores among them
METRICS = (
    "my_ring", "op_ring", "my_aggression", "op_aggression", "my_movement", "op_movement", "my_volume", "op_volume",
    "my_defense", "op_defense", "my_head_movement", "op_head_movement", "my_guard", "op_guard", "my_punches", "op_punches",
)
COLUMNS = ("session", "filename", "duration_s", "tier", "tier_weight", "my_visibility", "op_visibility", *METRICS)
META_SCHEMA = "filename string, lab_mode boolean, video_ext string"


def lab_sessions(spark: SparkSession, root: str) -> DataFrame:
    """(session, filename): sessions in lab mode with frames; a document that is no JSON is as good as none."""
    meta = documents.documents(spark, f"{root}/*/meta.json", META_SCHEMA).where("lab_mode")
    return documents.with_both(meta.select("session", F.coalesce("filename", F.lit("")).alias("filename")), documents.documents(spark, f"{root}/*/sam2_enriched.json", documents.FRAMES_SCHEMA))


def snapshot(sessions: DataFrame, frames: DataFrame, arena: DataFrame | None = None, fps: float = 15.0, config: Config = DEFAULT) -> DataFrame:
    """COLUMNS and `error`, one row a session; the scores are null where it is not."""
    arena = arena_metrics.arena_of(frames, config=config) if arena is None else arena
    scored = arena_metrics.summary(frames, arena, fps, config=config).withColumnsRenamed({f"{p}_defence": f"{p}_defense" for p in ("my", "op")})
    seen = arena.select("session", *(F.round(f"{p}_seen", 3).alias(f"{p}_visibility") for p in ("my", "op")))
    weights = F.create_map(*(F.lit(x) for pair in config.tier_weights.items() for x in pair))
    rows = sessions.join(scored, "session", "left").join(seen, "session", "left").withColumn("tier_weight", weights[F.col("tier")])
    frames_of = frames.groupBy("session").agg(F.count(F.lit(1)).alias("_n"))
    error = F.when(F.col("duration_s").isNotNull(), None).when(F.coalesce("_n", F.lit(0)) < 4, "too few frames").otherwise("no scores")
    return rows.join(frames_of, "session", "left").select(*COLUMNS, error.alias("error"))


def difference(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Cell by cell; rows with an error are in neither."""
    scored = lambda df: df.where("error is null") if "error" in df.columns else df
    lacking = lambda df: df.select("session", *(F.col(m) if m in df.columns else F.lit(None).alias(m) for m in METRICS))
    return snapshot_diff(lacking(scored(baseline)), lacking(scored(current)), "session", list(METRICS))


def report(diff: DataFrame) -> DataFrame:
    """(session, metric, line): a line of text for each difference, and one for each session that is new or gone."""
    arrow = F.when(F.col("delta") > 0, "↑").otherwise("↓")
    moved = F.format_string("%-12s  %-14s  %8.1f  %8.1f  %s%7.1f", F.col("session").cast("string"), "metric", "baseline", "current", arrow, F.abs("delta"))
    only = F.when(F.col("status") == "new", "(new in current — not in baseline)").otherwise("(removed from current — was in baseline)")
    lines = diff.select("session", F.when(F.col("status") == "changed", F.col("metric")).alias("metric"), F.when(F.col("status") == "changed", moved).otherwise(F.format_string("%-12s  %s", F.col("session").cast("string"), only)).alias("line"))
    return lines.distinct()


def run(spark: SparkSession, root: str, out: str, baseline: str | None = None, fps: float = 15.0) -> DataFrame:
    """Scores the folder, writes the snapshot as CSV and returns the report against a baseline, or the snapshot."""
    frames, arena = documents.frames(spark, f"{root}/*/sam2_enriched.json"), documents.arena(spark, f"{root}/*/arena.json")
    shot = snapshot(lab_sessions(spark, root), frames, arena.withColumn("axis_len", F.lit(0.0)), fps)
    documents.write_csv(shot.where("error is null"), out, list(COLUMNS))
    written = documents.snapshots(spark, [out])
    return report(difference(documents.snapshots(spark, [baseline]), written)) if baseline else shot


#: An earlier calibration, whose snapshots had fewer columns.
EARLIER = replace(DEFAULT, punch_score=0.12)
EARLIER_METRICS = tuple(m for m in METRICS if "guard" not in m)


def _both(spark, d) -> tuple[DataFrame, DataFrame]:
    """The poses view scored by an earlier and by today's constants. The earlier snapshot knows the sessions that are
    seen well, and goes through the text of its CSV."""
    frames = poses(spark, d)
    sessions = frames.select("session").distinct().withColumn("filename", F.format_string("clip %s.mp4", F.col("session").cast("string")))
    old, new = snapshot(sessions, frames, config=EARLIER), snapshot(sessions, frames)
    fields = ["session", *EARLIER_METRICS]
    cells = F.from_csv(F.to_csv(F.struct(*fields)), ", ".join(f"{f} string" for f in fields))
    known = old.where("my_visibility >= 0.9").select(cells.alias("c")).select(F.col("c.session").cast(new.schema["session"].dataType).alias("session"), *(f"c.{m}" for m in EARLIER_METRICS))
    return known, new


def harness_snapshot(spark, d) -> DataFrame:
    return _both(spark, d)[1].drop("my_visibility", "op_visibility")


def harness_diff(spark, d) -> DataFrame:
    return difference(*_both(spark, d))


QUERIES = {f.__name__: f for f in (harness_snapshot, harness_diff)}

_FLAGSHIP = pose_queries.ORACLES["flagship_arena_metrics"]
_EARLIER = _FLAGSHIP.replace("score >= 0.07::DOUBLE", f"score >= {EARLIER.punch_score}::DOUBLE")
_OURS = lambda m: m.replace("defense", "defence")
_CELLS = lambda name, metrics: f"(SELECT * FROM (SELECT session, {', '.join(f'{_OURS(m)}::DOUBLE AS {m}' if m in metrics else f'NULL::DOUBLE AS {m}' for m in METRICS)} FROM {name}) UNPIVOT INCLUDE NULLS (v FOR metric IN ({', '.join(METRICS)})))"
ORACLES = {
    "harness_snapshot": f"SELECT n.session, 'clip ' || n.session || '.mp4' AS filename, duration_s, tier, CASE tier WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE WHEN 'low' THEN 0.4::DOUBLE WHEN 'none' THEN 0.0::DOUBLE END AS tier_weight, {', '.join(f'{_OURS(m)} AS {m}' for m in METRICS)}, CASE WHEN f.session IS NULL THEN 'too few frames' END AS error FROM (SELECT DISTINCT label AS session FROM embeddings) n LEFT JOIN ({_FLAGSHIP}) f ON f.session = n.session",
    "harness_diff": f"""SELECT coalesce(o.session, n.session) AS session, coalesce(o.metric, n.metric) AS metric, CASE WHEN o.session IS NULL THEN 'new' WHEN n.session IS NULL THEN 'removed' ELSE 'changed' END AS status, o.v AS baseline, n.v AS current, round(n.v - o.v, 6) AS delta
      FROM (SELECT c.* FROM {_CELLS(f"({_EARLIER})", EARLIER_METRICS)} c JOIN ({pose_queries.ORACLES["arena_geometry"]}) a ON a.session = c.session AND round(a.my_seen, 3) >= 0.9) o FULL JOIN {_CELLS(f"({_FLAGSHIP})", METRICS)} n ON n.session = o.session AND n.metric = o.metric
      WHERE coalesce(o.v, n.v) IS NOT NULL AND (o.session IS NULL OR n.session IS NULL OR abs(n.v - o.v) >= 0.01)""",
}
