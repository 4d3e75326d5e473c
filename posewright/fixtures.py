"""Views of the driver's tables as signals and poses.

`signals`: every event is a frame of its user's session. `poses`: the embeddings of a label, two to a frame.
`poses_sql` and `SIGNALS_SQL` say the same in SQL for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
SIDES = ("my", "op")
#: Heights of the 17 keypoints in a standing pose.
BASE = [0.20, 0.18, 0.18, 0.19, 0.19, 0.35, 0.35, 0.45, 0.45, 0.42, 0.42, 0.60, 0.60, 0.75, 0.75, 0.90, 0.90]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, fi, us, t, bucket, side, kind, v): frames in time order; bucket is the day."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), (F.row_number().over(w) - 1).alias("fi"), us.alias("us"), (us / 1e6).alias("t"), F.floor(us / DAY_US).alias("bucket"),
        F.when(F.col("event_type").isin("click", "purchase"), "my").otherwise("op").alias("side"), F.col("event_type").alias("kind"), F.col("value").alias("v"),
    )


SIGNALS_SQL = """sig AS (
  SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS fi,
    date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS us, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6 AS t,
    CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 86400000000.0) AS BIGINT) AS bucket,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'my' ELSE 'op' END AS side, event_type AS kind, value AS v
  FROM events)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, fi, time_s, my_kps, op_kps, my_bbox, op_bbox): one row per frame, op null where the last frame has one pose."""
    rn = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("session"), rn.alias("rn"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    side = F.when(F.col("rn") % 2 == 0, "my").otherwise("op")
    shift = F.when(F.col("rn") % 2 == 0, F.lit(0.0)).otherwise(0.3 + 1.5 * F.col("e")[51])
    dim = F.when(F.abs(F.col("e")[52]) > 0.2, 0.45).otherwise(1.0)
    base = F.array(*map(F.lit, BASE))
    point = lambda i: F.array(F.col("shift") + 0.35 + 0.4 * F.get("e", 3 * i), F.get(base, i) + 0.4 * F.get("e", 3 * i + 1), F.least(F.lit(1.0), 0.25 + 4 * F.abs(F.get("e", 3 * i + 2))) * F.col("dim"))
    rows = rows.select("session", F.floor(F.col("rn") / 2).cast("int").alias("fi"), side.alias("side"), shift.alias("shift"), dim.alias("dim"), "e").select("session", "fi", "side", F.transform(F.sequence(F.lit(0), F.lit(16)), point).alias("kps"))
    axis = lambda k: F.transform("kps", lambda p: p[k])
    rows = rows.withColumn("bbox", F.array(F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1))))
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return rows.groupBy("session", "fi").agg(*(pick(s, c).alias(f"{s}_{c}") for s in SIDES for c in ("kps", "bbox"))).withColumn("time_s", F.col("fi") / 15.0)


POSES_SQL = """vec AS (
  SELECT label AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
 par AS (SELECT session, rn, CAST(rn // 2 AS INTEGER) AS fi, CASE WHEN rn % 2 = 0 THEN 'my' ELSE 'op' END AS side, CASE WHEN rn % 2 = 0 THEN 0.0::DOUBLE ELSE 0.3::DOUBLE + 1.5::DOUBLE * e[52] END AS shift,
    CASE WHEN abs(e[53]) > 0.2::DOUBLE THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END AS dim, e FROM vec),
 kp AS (SELECT session, fi, side, i, shift + 0.35::DOUBLE + 0.4::DOUBLE * e[3 * i + 1] AS x,
    [0.20, 0.18, 0.18, 0.19, 0.19, 0.35, 0.35, 0.45, 0.45, 0.42, 0.42, 0.60, 0.60, 0.75, 0.75, 0.90, 0.90][i + 1]::DOUBLE + 0.4::DOUBLE * e[3 * i + 2] AS y,
    least(1.0::DOUBLE, 0.25::DOUBLE + 4 * abs(e[3 * i + 3])) * dim AS c FROM par, range(17) AS r(i)),
 ok AS (SELECT session, fi, side, CAST(i AS INTEGER) AS i, x, y, c, CASE WHEN c >= 0.35::DOUBLE THEN x END AS px, CASE WHEN c >= 0.35::DOUBLE THEN y END AS py FROM kp),
 pose AS (SELECT session, fi, side, count(*) FILTER (WHERE c >= 0.35::DOUBLE) / 17.0::DOUBLE AS vis, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2,
    """ + ", ".join(f"max(px) FILTER (WHERE i = {i}) AS kx{i}, max(py) FILTER (WHERE i = {i}) AS ky{i}" for i in range(17)) + """ FROM ok GROUP BY session, fi, side),
 body AS (SELECT *, (kx5 + kx6) * 0.5::DOUBLE AS scx, (ky5 + ky6) * 0.5::DOUBLE AS scy, (kx11 + kx12) * 0.5::DOUBLE AS hcx, (ky11 + ky12) * 0.5::DOUBLE AS hcy, (x1 + x2) * 0.5::DOUBLE AS cx, (y1 + y2) * 0.5::DOUBLE AS cy,
    coalesce(kx0, (kx1 + kx2) * 0.5::DOUBLE) AS hx, CASE WHEN kx0 IS NOT NULL THEN ky0 ELSE (ky1 + ky2) * 0.5::DOUBLE END AS hy FROM pose),
 torso AS (SELECT *, sqrt((scx - hcx) * (scx - hcx) + (scy - hcy) * (scy - hcy)) AS th FROM body)"""
