"""Queries of the second metric family, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posewright.fixtures import poses
from posewright.functions import perception
from posewright.plans import pressure_metrics as m
from posewright.plans.pose_queries import _q


def frames(spark, d) -> DataFrame:
    f = poses(spark, d)
    return f.withColumn("clinch", perception.clinch_by_width(F.col("my_bbox"), F.col("op_bbox")))


def pressure_summary(spark, d) -> DataFrame:
    return m.summary(frames(spark, d))


def pressure_series(spark, d) -> DataFrame:
    return m.per_second(m.signals(frames(spark, d)))


def pressure_frames(spark, d) -> DataFrame:
    """Punch, guard and aggression of every frame."""
    f = m.signals(frames(spark, d))
    of = lambda p: F.struct(F.lit(p).alias("side"), F.round(f"{p}_ext", 6).alias("ext"), F.round(f"{p}_acc", 6).alias("acc"), F.col(f"{p}_punch").alias("punch"), F.col(f"{p}_guard").alias("guard"), F.col(f"{p}_def").alias("defensive"), F.col(f"{p}_adv").alias("advancing"), F.col(f"{p}_ret").alias("retreating"), F.col(f"{p}_cornered").alias("cornered"), F.col(f"{p}_aggressing").alias("aggressing"))
    return f.select("session", "fi", F.inline(F.array(of("my"), of("op"))))


QUERIES = {f.__name__: f for f in (pressure_summary, pressure_series, pressure_frames)}

_RANK = lambda v, where, q: f"(SELECT session, v FROM (SELECT session, {v} AS v, row_number() OVER (PARTITION BY session ORDER BY {v}) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM mo WHERE {where}) WHERE i = floor(n * {q}::DOUBLE))"
_PCT = lambda x: f"CAST(round_even(round({x}, 9), 0) AS INTEGER)"
_PARTS = [
    "fs AS (SELECT f.session, f.fi, s.side FROM (SELECT DISTINCT session, fi FROM pose) f CROSS JOIN (VALUES ('my'), ('op')) s(side))",
    "sh AS (SELECT fs.session, fs.fi, fs.side, x1, y1, x2, y2, (x1 + x2) * 0.5::DOUBLE AS cx, (y1 + y2) * 0.5::DOUBLE AS cy, coalesce((kx5 + kx6) / 2, kx5, kx6) AS sx, coalesce((ky5 + ky6) / 2, ky5, ky6) AS sy, kx9, ky9, kx10, ky10, coalesce(y2 - y1, 0.3::DOUBLE) AS th FROM fs LEFT JOIN pose USING (session, fi, side))",
    "re AS (SELECT *, kx9 - sx AS lx, ky9 - sy AS ly, kx10 - sx AS rx, ky10 - sy AS ry FROM sh)",
    """mo AS (SELECT *, y2 - y1 AS h, CASE WHEN th >= 0.01 THEN coalesce(greatest(sqrt(lx * lx + ly * ly), sqrt(rx * rx + ry * ry)) / th, 0) ELSE 0 END AS ext,
      coalesce(greatest(sqrt((lx - lag(lx) OVER w) ** 2 + (ly - lag(ly) OVER w) ** 2), sqrt((rx - lag(rx) OVER w) ** 2 + (ry - lag(ry) OVER w) ** 2)), 0) AS acc, coalesce(sqrt((sx - lag(sx) OVER w) ** 2 + (sy - lag(sy) OVER w) ** 2), 0) AS bd, lag(cx) OVER w AS pcx FROM re WINDOW w AS (PARTITION BY session, side ORDER BY fi))""",
    f"qe AS {_RANK('ext', 'ext > 0', 0.9)}", f"qa AS {_RANK('acc', 'acc > 0', 0.9)}", f"qh AS {_RANK('h', 'h IS NOT NULL', 0.5)}",
    "pu AS (SELECT mo.*, bd + 1.5::DOUBLE * acc AS act, acc >= qh.v * 0.03::DOUBLE AND 0.3::DOUBLE * (ext / greatest(qe.v, 0.01::DOUBLE)) + 0.7::DOUBLE * (acc / greatest(qa.v, 0.001::DOUBLE)) > 1.1::DOUBLE AS punch, CASE WHEN ky9 <= sy + 0.08::DOUBLE THEN 1.0::DOUBLE WHEN ky9 IS NOT NULL AND sy IS NOT NULL THEN 0.0::DOUBLE END AS ul, CASE WHEN ky10 <= sy + 0.08::DOUBLE THEN 1.0::DOUBLE WHEN ky10 IS NOT NULL AND sy IS NOT NULL THEN 0.0::DOUBLE END AS ur FROM mo JOIN qe USING (session) JOIN qa USING (session) JOIN qh USING (session))",
    """gu AS (SELECT *, sx IS NULL OR NOT punch AS def, CASE WHEN sx IS NULL THEN 0.5::DOUBLE WHEN punch THEN coalesce(CASE WHEN ur IS NULL OR sqrt(lx * lx + ly * ly) <= sqrt(rx * rx + ry * ry) THEN ul ELSE ur END, 0.5::DOUBLE) ELSE coalesce((ul + ur) / 2, ul, ur, 0.5::DOUBLE) END AS guard FROM pu)""",
    "fl AS (SELECT a.*, b.cx AS ocx, b.punch AS opunch, coalesce((a.cx - a.pcx) * CASE WHEN b.cx > a.cx THEN 1 WHEN b.cx IS NOT NULL THEN -1 END > 0.003::DOUBLE, false) AS adv, coalesce((a.cx - a.pcx) * CASE WHEN b.cx > a.cx THEN 1 WHEN b.cx IS NOT NULL THEN -1 END < -0.003::DOUBLE, false) AS ret, coalesce(a.cx < 0.18::DOUBLE OR a.cx > 0.82::DOUBLE, false) AS cornered, coalesce(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) < (a.x2 - a.x1 + b.x2 - b.x1) / 4, false) AS clinch FROM gu a JOIN gu b ON a.session = b.session AND a.fi = b.fi AND a.side <> b.side)",
    "ag AS (SELECT a.*, a.punch OR (a.adv AND (b.cornered OR (b.ret AND NOT b.punch))) AS aggressing, CAST(floor(a.fi / 15.0::DOUBLE) AS INTEGER) AS sec FROM fl a JOIN fl b ON a.session = b.session AND a.fi = b.fi AND a.side <> b.side)",
    "du AS (SELECT session, max(sec) + 1 AS dur FROM ag GROUP BY session)",
    "sp AS (SELECT session, dur, CAST(unnest(range(dur)) AS INTEGER) AS sec FROM du)",
    "ne AS (SELECT sp.session, sp.sec, fi, ag.cx, ag.ocx, row_number() OVER (PARTITION BY sp.session, sp.sec ORDER BY fi) AS i, count(*) OVER (PARTITION BY sp.session, sp.sec) AS n FROM ag JOIN sp ON sp.session = ag.session AND fi / 15.0::DOUBLE BETWEEN sp.sec - 0.75::DOUBLE AND sp.sec + 0.75::DOUBLE WHERE side = 'my' AND ag.cx IS NOT NULL AND ocx IS NOT NULL)",
    "ha AS (SELECT session, sec, avg(cx) FILTER (WHERE i <= n // 2) AS m1, avg(cx) FILTER (WHERE i > n // 2) AS m2, avg(ocx) FILTER (WHERE i <= n // 2) AS o1, avg(ocx) FILTER (WHERE i > n // 2) AS o2 FROM ne WHERE n >= 3 GROUP BY ALL)",
    "pr AS (SELECT sp.session, sp.sec, sp.dur, coalesce(abs(m1 - o1) > abs(m2 - o2) AND (m2 - m1) * CASE WHEN o1 > m1 THEN 1 ELSE -1 END > 0.005::DOUBLE, false) AS mp, coalesce(abs(m1 - o1) > abs(m2 - o2) AND (o2 - o1) * CASE WHEN m1 > o1 THEN 1 ELSE -1 END > 0.005::DOUBLE, false) AS op FROM sp LEFT JOIN ha USING (session, sec))",
    """pa AS (SELECT pr.session, pr.sec, side, act * CASE WHEN (CASE side WHEN 'my' THEN op AND NOT mp ELSE mp AND NOT op END) THEN 0.3::DOUBLE WHEN punch OR (CASE side WHEN 'my' THEN mp ELSE op END) THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS v
      FROM pr JOIN ag ON ag.session = pr.session AND ag.sec BETWEEN pr.sec - greatest(5, least(15, dur // 6)) // 2 AND pr.sec + greatest(5, least(15, dur // 6)) // 2 WHERE act > 0)""",
    "p8 AS (SELECT session, sec, max(v) FILTER (WHERE side = 'my') AS m, max(v) FILTER (WHERE side = 'op') AS o FROM (SELECT *, row_number() OVER (PARTITION BY session, sec, side ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY session, sec, side) AS n FROM pa) WHERE n >= 3 AND i = floor(n * 0.8::DOUBLE) GROUP BY ALL)",
    "ca AS (SELECT pr.*, coalesce(last_value(m IGNORE NULLS) OVER w, 0.001::DOUBLE) AS m, coalesce(last_value(o IGNORE NULLS) OVER w, 0.001::DOUBLE) AS o FROM pr LEFT JOIN p8 USING (session, sec) WINDOW w AS (PARTITION BY session ORDER BY sec))",
    "su AS (SELECT session, sec, side, 100.0::DOUBLE * count(*) FILTER (WHERE aggressing) / count(*) AS agg, (0.7::DOUBLE * coalesce(avg(guard) FILTER (WHERE def), 0.5::DOUBLE) + 0.3::DOUBLE * coalesce(avg(guard) FILTER (WHERE NOT def), 0.5::DOUBLE)) * 100 AS gd, avg(clinch::INT) AS cli FROM ag GROUP BY ALL)",
    f"""se AS (SELECT ca.session, ca.sec, greatest(1, {_PCT('m / pk * 100')}) AS my_pace, greatest(1, {_PCT('o / pk * 100')}) AS op_pace, coalesce({_PCT('a.agg')}, 0) AS my_aggression, coalesce({_PCT('b.agg')}, 0) AS op_aggression, coalesce({_PCT('a.gd')}, 50) AS my_guard, coalesce({_PCT('b.gd')}, 50) AS op_guard,
      0.6::DOUBLE * mp::INT + 0.25::DOUBLE * (1 - (op AND NOT mp)::INT) + 0.15::DOUBLE * (1 - coalesce(a.cli, 0)) AS mr, 0.6::DOUBLE * op::INT + 0.25::DOUBLE * (1 - (mp AND NOT op)::INT) + 0.15::DOUBLE * (1 - coalesce(a.cli, 0)) AS orr
      FROM (SELECT *, greatest(max(greatest(m, o)) OVER (PARTITION BY session), 0.001::DOUBLE) AS pk FROM ca) ca LEFT JOIN su a ON a.session = ca.session AND a.sec = ca.sec AND a.side = 'my' LEFT JOIN su b ON b.session = ca.session AND b.sec = ca.sec AND b.side = 'op')""",
    f"ri AS (SELECT *, CASE WHEN mr + orr > 0 THEN {_PCT('mr / (mr + orr) * 100')} ELSE 50 END AS my_ring FROM se)",
    "co AS (SELECT *, 100 - my_ring AS op_ring, (0.35::DOUBLE * my_aggression + 0.35::DOUBLE * my_ring + 0.2::DOUBLE * my_pace + 0.1::DOUBLE * my_guard) / 100 AS mc, (0.35::DOUBLE * op_aggression + 0.35::DOUBLE * (100 - my_ring) + 0.2::DOUBLE * op_pace + 0.1::DOUBLE * op_guard) / 100 AS oc FROM ri)",
    f"fi AS (SELECT session, sec, my_pace, my_aggression, my_guard, my_ring, CASE WHEN mc + oc > 0 THEN {_PCT('mc / (mc + oc) * 100')} ELSE 50 END AS my_control, op_pace, op_aggression, op_guard, op_ring, 100 - CASE WHEN mc + oc > 0 THEN {_PCT('mc / (mc + oc) * 100')} ELSE 50 END AS op_control FROM co)",
]
_PUNCHES = lambda s: f"(SELECT session, count(*) FILTER (WHERE g IS NULL OR g > 5) AS {s}_punches FROM (SELECT session, fi - lag(fi) OVER (PARTITION BY session ORDER BY fi) AS g FROM ag WHERE side = '{s}' AND punch) GROUP BY session)"
ORACLES = {
    "pressure_frames": _q("SELECT session, fi, side, round(ext, 6) AS ext, round(acc, 6) AS acc, punch, guard, def AS defensive, adv AS advancing, ret AS retreating, cornered, aggressing FROM ag", *_PARTS[:11]),
    "pressure_series": _q("SELECT * FROM fi", *_PARTS),
    "pressure_summary": _q("SELECT f.session, f.* EXCLUDE (session), coalesce(my_punches, 0) AS my_punches, coalesce(op_punches, 0) AS op_punches, clinch_seconds, n_frames FROM (SELECT session, CAST(count(*) AS INTEGER) AS duration_s, " + ", ".join(f"{_PCT(f'avg({p}_{s})')} AS {p}_{s}" for p in ("my", "op") for s in m.SERIES) + f" FROM fi GROUP BY session) f LEFT JOIN {_PUNCHES('my')} USING (session) LEFT JOIN {_PUNCHES('op')} USING (session) JOIN (SELECT session, count(DISTINCT CASE WHEN clinch THEN sec END) AS clinch_seconds, count(DISTINCT fi) AS n_frames FROM ag GROUP BY session) USING (session)", *_PARTS),
}
