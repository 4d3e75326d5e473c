"""Queries of the classic metric family, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posewright.fixtures import poses
from posewright.functions import columns as c
from posewright.functions import perception
from posewright.plans import classic_metrics as m
from posewright.plans.pose_queries import _q

W, H = 1280.0, 720.0


def frames(spark, d) -> DataFrame:
    """Poses in pixels, of the frames with both boxes."""
    f = poses(spark, d).where("my_bbox is not null and op_bbox is not null")
    px = lambda s: F.transform(f"{s}_kps", lambda k: F.array(k[0] * W, k[1] * H, k[2]))
    return f.select("session", "fi", *(px(s).alias(f"{s}_kps") for s in ("my", "op")), *(perception.scaled_box(F.col(f"{s}_bbox"), W, H).alias(f"{s}_bbox") for s in ("my", "op")))


def heard(spark, d) -> DataFrame:
    """Stand-in for landed punches: frames whose own head is far left or right of the middle, by side."""
    f = frames(spark, d)
    return f.select("session", "fi", F.inline(F.array(*(F.struct(F.lit(s).alias("side"), (F.abs(F.get(F.get(f"{s}_kps", 0), 0) / W - 0.5) > 0.25).alias("far")) for s in ("my", "op"))))).where("far")


def classic_frames(spark, d) -> DataFrame:
    f = m.signals(frames(spark, d), W, H, 15.0)
    of = lambda p: F.struct(F.lit(p).alias("side"), F.round(f"{p}_act", 6).alias("act"), F.round(f"{p}_l_speed", 5).alias("l_speed"), F.round(f"{p}_r_speed", 5).alias("r_speed"), *(F.col(f"{p}_{n}").alias(n) for n in ("punch", "up", "adv", "ret", "ring", "aggressing")))
    return f.select("session", "fi", F.inline(F.array(of("my"), of("op"))))


def classic_series(spark, d) -> DataFrame:
    return m.per_second(m.signals(frames(spark, d), W, H, 15.0, heard(spark, d)), 15.0, audio=True)


def classic_summary(spark, d) -> DataFrame:
    return m.summary(frames(spark, d), W, H, 15.0, heard(spark, d))


def classic_periods(spark, d) -> DataFrame:
    """The table of scoring periods; my punches that are held for landed count as such. Frames in which my pose is half
    seen count for the height, all others do not."""
    f = frames(spark, d).withColumn("my_reliable", c.visibility(F.col("my_kps")) >= 0.5)
    seconds = m.per_second(m.signals(f, W, H, 15.0, heard(spark, d)), 15.0, True)
    whole = lambda x: F.bround(x * 100).cast("int")
    return m.periods(seconds).select("session", "period", whole(F.round("share", 9)).alias("my"), whole(F.round(1 - F.col("share"), 9)).alias("op"), whole(F.round("weight", 9)).alias("weight"), "start", "end")


QUERIES = {f.__name__: f for f in (classic_frames, classic_series, classic_periods, classic_summary)}

_PCT = lambda x: f"CAST(round_even(round({x}, 9), 0) AS INTEGER)"
_K = lambda i, a: f"max(CASE WHEN c >= 0.4::DOUBLE AND NOT (x <= 0 AND y <= 0) THEN {a} * {1280 if a == 'x' else 720} END) FILTER (WHERE i = {i})"
_PARTS = [
    "tw AS (SELECT session, fi FROM pose GROUP BY ALL HAVING count(*) = 2)",
    "kk AS (SELECT session, fi, side, " + ", ".join(f"{_K(i, a)} AS {n}{a}" for n, i in (("sa", 5), ("sb", 6), ("l", 9), ("r", 10)) for a in "xy") + ", any_value(CASE WHEN i = 0 THEN x END) AS nose FROM ok JOIN tw USING (session, fi) GROUP BY ALL)",
    "se AS (SELECT kk.*, coalesce((sax + sbx) / 2, sax, sbx) AS sx, coalesce((say + sby) / 2, say, sby) AS sy, (x1 + x2) * 640 AS cx, (y1 + y2) * 360 AS cy, (y2 - y1) * 720 AS h, row_number() OVER (PARTITION BY session, side ORDER BY fi) - 1 AS i FROM kk JOIN pose USING (session, fi, side))",
    "st AS (SELECT *, " + ", ".join(f"{n} - lag({n}) OVER w AS d{n}" for n in ("sx", "sy", "lx", "ly", "rx", "ry", "cx", "cy")) + " FROM se WINDOW w AS (PARTITION BY session, side ORDER BY fi))",
    "sp AS (SELECT *, coalesce(sqrt((dlx - coalesce(dsx, 0)) ** 2 + (dly - coalesce(dsy, 0)) ** 2), 0) AS ls, coalesce(sqrt((drx - coalesce(dsx, 0)) ** 2 + (dry - coalesce(dsy, 0)) ** 2), 0) AS rs FROM st)",
    "rf AS (SELECT session, h AS ref FROM (SELECT session, h, row_number() OVER (PARTITION BY session ORDER BY h) - 1 AS k, count(*) OVER (PARTITION BY session) AS n FROM sp) WHERE k = floor(n * 0.5::DOUBLE))",
    """ev AS (SELECT a.session, a.fi, a.i, a.side, a.nose, a.ls, a.rs, a.cx, b.cx AS ox, coalesce((sqrt(a.dcx ** 2 + a.dcy ** 2) + 1.5::DOUBLE * greatest(a.ls, a.rs)) / 1280, 0) AS act, greatest(a.ls, a.rs) > ref * 0.21::DOUBLE AS punch,
      NOT coalesce((a.ly IS NOT NULL OR a.ry IS NOT NULL) AND least(a.ly, a.ry) > a.sy + 720 * 0.08::DOUBLE, false) AS up,
      a.dcx * CASE WHEN (b.cx > a.cx AND a.side = 'my') OR (b.cx >= a.cx AND a.side = 'op') THEN 1 ELSE -1 END AS mv, a.cx / 1280 < 0.18::DOUBLE OR a.cx / 1280 > 0.82::DOUBLE AS ropes, b.cx / 1280 < 0.18::DOUBLE OR b.cx / 1280 > 0.82::DOUBLE AS oropes,
      a.cx BETWEEN 0.35::DOUBLE * 1280 AND 0.65::DOUBLE * 1280 AND NOT b.cx BETWEEN 0.35::DOUBLE * 1280 AND 0.65::DOUBLE * 1280 AS centre FROM sp a JOIN sp b ON a.session = b.session AND a.fi = b.fi AND a.side <> b.side JOIN rf ON rf.session = a.session)""",
    "e2 AS (SELECT *, coalesce(mv > 1280 * 0.07::DOUBLE / 15, false) AS adv, coalesce(mv < -(1280 * 0.07::DOUBLE / 15), false) AS ret, centre OR oropes OR (abs(cx / 1280 - 0.5::DOUBLE) < abs(ox / 1280 - 0.5::DOUBLE) AND NOT ropes) AS ring FROM ev)",
    "e3 AS (SELECT a.*, a.punch OR (a.adv AND (a.oropes OR (b.ret AND NOT b.punch))) AS aggressing, abs(a.nose - 0.5::DOUBLE) > 0.25::DOUBLE AS landed, CAST(a.i // 15 AS INTEGER) AS sec FROM e2 a JOIN e2 b ON a.session = b.session AND a.fi = b.fi AND a.side <> b.side)",
    "ns AS (SELECT session, CAST(greatest(1, count(DISTINCT fi) // 15) AS INTEGER) AS n_secs, count(DISTINCT fi) AS n FROM e3 GROUP BY session)",
    f"ps AS (SELECT session, sec, side, any_value(n_secs) AS n_secs, 3 * count(*) FILTER (WHERE landed) + greatest(0, count(*) FILTER (WHERE punch) - count(*) FILTER (WHERE landed)) AS eff, {_PCT('100.0::DOUBLE * count(*) FILTER (WHERE up) / count(*)')} AS guard, {_PCT('100.0::DOUBLE * count(*) FILTER (WHERE adv) / count(*)')} AS advance, {_PCT('100.0::DOUBLE * count(*) FILTER (WHERE ring) / count(*)')} AS ring FROM e3 JOIN ns USING (session) WHERE sec < n_secs GROUP BY session, sec, side)",
    "pw AS (SELECT p.session, p.sec, p.side, quantile_cont(act, 0.8) AS v FROM ps p JOIN e3 e ON e.session = p.session AND e.side = p.side AND act > 0 AND e.i BETWEEN p.sec * 15 - least(15, greatest(5, n_secs // 6)) * 15 AND p.sec * 15 + least(15, greatest(5, n_secs // 6)) * 15 GROUP BY ALL HAVING count(*) >= 3)",
    "cf AS (SELECT ps.*, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY session, side ORDER BY sec), 0) AS raw FROM ps LEFT JOIN pw USING (session, sec, side))",
    f"nm AS (SELECT *, {_PCT('raw / greatest(max(raw) OVER (PARTITION BY session), 1e-9::DOUBLE) * 100')} AS pace, {_PCT('eff / greatest(max(eff) OVER (PARTITION BY session), 1)::DOUBLE * 100')} AS punches FROM cf)",
    f"ag AS (SELECT *, {_PCT('0.6::DOUBLE * punches + 0.4::DOUBLE * advance')} AS aggression FROM nm)",
    "ct AS (SELECT *, 0.4::DOUBLE * ring + 0.35::DOUBLE * aggression + 0.25::DOUBLE * pace AS raw_control FROM ag)",
    f"sr AS (SELECT a.session, a.sec, a.n_secs, " + ", ".join(f"{t}.{s} AS {p}_{s}" for p, t in (("my", "a"), ("op", "b")) for s in m.SERIES[:-1]) + f", CASE WHEN a.raw_control + b.raw_control < 0.5 THEN 50 ELSE {_PCT('a.raw_control / (a.raw_control + b.raw_control) * 100')} END AS my_control FROM ct a JOIN ct b ON a.session = b.session AND a.sec = b.sec AND a.side = 'my' AND b.side = 'op')",
]
_SUMMARY = [
    "kp2 AS (SELECT *, CAST(greatest(2, n_secs // 15) AS INTEGER) AS k FROM sr)",
    "pe AS (SELECT session, k, period, avg(my_control) AS c, avg(my_aggression) AS ma, avg(op_aggression) AS oa, avg(my_pace) AS mp, avg(op_pace) AS op FROM (SELECT *, sec // greatest(1, n_secs // k) AS period FROM kp2) WHERE period < k GROUP BY ALL)",
    f"ro AS (SELECT session, {_PCT('sum((0.45::DOUBLE * c / 100 + 0.35::DOUBLE * ma / greatest(ma + oa, 1) + 0.2::DOUBLE * mp / greatest(mp + op, 1)) * w) * 100')} AS my_round FROM (SELECT *, (period + 1) ** 1.3::DOUBLE / list_sum([(j + 1) ** 1.3::DOUBLE FOR j IN range(k)]) AS w FROM pe) GROUP BY session)",
    "bu AS (SELECT session, side, max(b) AS b FROM (SELECT e3.session, side, sum(act) OVER (PARTITION BY e3.session, side ORDER BY i ROWS BETWEEN CURRENT ROW AND 74 FOLLOWING) AS b, i, n FROM e3 JOIN ns USING (session)) WHERE i <= greatest(0, n - 75) GROUP BY ALL)",
    f"to_ AS (SELECT session, side, {_PCT('100.0::DOUBLE * count(*) FILTER (WHERE aggressing AND i >= 1) / greatest(count(*) - 1, 1)')} AS aggression, {_PCT('100.0::DOUBLE * count(*) FILTER (WHERE up) / count(*)')} AS guard, {_PCT('100.0::DOUBLE * count(*) FILTER (WHERE centre) / count(*)')} AS ring FROM e3 GROUP BY ALL)",
    "th AS (SELECT session, side, any_value(n_secs) AS n_secs, avg(pace) FILTER (WHERE sec < greatest(1, n_secs // 3)) AS fa, avg(pace) FILTER (WHERE sec >= n_secs - greatest(1, n_secs // 3)) AS la FROM ag GROUP BY ALL)",
    f"al_ AS (SELECT session, side, least(100, greatest(1, {_PCT('b / (15.0::DOUBLE * 5 * 0.18::DOUBLE) * 100')})) AS burst, aggression, guard, ring, CASE WHEN n_secs >= 6 THEN CASE WHEN fa <= 0 THEN 100 ELSE least(100, {_PCT('la / fa * 100')}) END END AS stamina FROM to_ JOIN bu USING (session, side) JOIN th USING (session, side))",
]
ORACLES = {
    "classic_frames": _q("SELECT session, fi, side, round(act, 6) AS act, round(ls, 5) AS l_speed, round(rs, 5) AS r_speed, punch, up, adv, ret, ring, aggressing FROM e3", *_PARTS[:9]),
    "classic_series": _q("SELECT *, 100 - my_control AS op_control FROM sr", *_PARTS),
    "classic_periods": _q("SELECT s.session, CAST(j AS INTEGER) AS period, CAST(round_even(round(share, 9) * 100, 0) AS INTEGER) AS my, CAST(round_even(round(1 - share, 9) * 100, 0) AS INTEGER) AS op, CAST(round_even(round((j + 1) ** 1.3::DOUBLE / list_sum([(q + 1) ** 1.3::DOUBLE FOR q IN range(k)]), 9) * 100, 0) AS INTEGER) AS weight, CAST(j * size AS INTEGER) AS start, CAST(least(n_secs, (j + 1) * size) AS INTEGER) AS \"end\" FROM (SELECT k.session, k.k, n_secs, greatest(1, n_secs // k.k) AS size, j, coalesce(0.45::DOUBLE * c / 100 + 0.35::DOUBLE * ma / greatest(ma + oa, 1) + 0.2::DOUBLE * mp / greatest(mp + op, 1), 0) AS share FROM (SELECT session, k, n_secs, unnest(range(k)) AS j FROM (SELECT DISTINCT session, k, n_secs FROM kp2)) k LEFT JOIN pe ON pe.session = k.session AND pe.period = k.j) s", *[p.replace("FROM sp) WHERE k = floor", "FROM sp JOIN (SELECT session, fi, vis AS mv FROM pose WHERE side = 'my') USING (session, fi) WHERE side = 'op' OR mv >= 0.5) WHERE k = floor") for p in _PARTS], *_SUMMARY[:2]),
    "classic_summary": _q("SELECT a.session, " + ", ".join(f"{t}.{s} AS {p}_{s}" for p, t in (("my", "a"), ("op", "b")) for s in ("burst", "aggression", "guard", "ring", "stamina")) + ", my_round, 100 - my_round AS op_round FROM al_ a JOIN al_ b ON a.session = b.session AND a.side = 'my' AND b.side = 'op' JOIN ro ON ro.session = a.session", *_PARTS, *_SUMMARY),
}
