"""Sinks, stage artifacts, regression runs from documents to a report, scans by blocks, folds, and streams of joins."""

import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from oracle import found
from pyspark.sql import functions as F

from posewright.fixtures import poses
from posewright.operators import folds, scans
from posewright.operators.geometry import compose, ransac_rigid
from posewright.plans import arena_metrics, arena_motion, harness, overlays
from posewright.sources import documents as docs
from posewright.sources import stages
from posewright.streaming import windows


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))


@pytest.fixture(scope="module")
def sessions(spark, sf, tmp_path_factory):
    """A folder of sessions as documents: two of the poses view, one outside lab mode, one broken, one too short."""
    root = tmp_path_factory.mktemp("sessions")
    rows = poses(spark, sf).where("session in (0, 1)").orderBy("session", "fi").collect()
    for s, n in ((0, 99), (1, 99), (2, 99), (4, 2)):
        frames = [{k: r[k] for k in ("fi", "time_s", "my_bbox", "op_bbox", "my_kps", "op_kps")} | {"raw_fi": r["fi"], "clinch": False} for r in rows if r["session"] == min(s, 1)][:n]
        write(root / f"s{s}/sam2_enriched.json", {"fps_pose": 15.0, "frame_w": 1, "frame_h": 1, "frames": frames})
        write(root / f"s{s}/meta.json", {"filename": f"clip {s}.mp4", "lab_mode": s != 2})
        write(root / f"s{s}/arena.json", {"ok": True, "centroid": [0.5, 0.9], "median_scale_px": 0.8, "my_visibility_score": 1.0, "op_visibility_score": 0.9, "confidence_tier": "high"})
    write(root / "s3/meta.json", "{ no document")
    write(root / "s3/sam2_enriched.json", {"frames": []})
    write(root / "s5/meta.json", {"filename": "no frames.mp4", "lab_mode": True})
    return str(root)


def test_lab_sessions(spark, sessions):
    assert {tuple(r) for r in harness.lab_sessions(spark, sessions).collect()} == {("s0", "clip 0.mp4"), ("s1", "clip 1.mp4"), ("s4", "clip 4.mp4")}


def test_run_writes_a_snapshot_and_reports(spark, sessions, tmp_path):
    shot = harness.run(spark, sessions, str(tmp_path / "now"))
    rows = {r["session"]: r for r in shot.collect()}
    assert rows["s0"]["error"] is None and rows["s0"]["tier"] == "high" and rows["s0"]["tier_weight"] == 1.0 and rows["s4"]["error"] == "too few frames"
    text = spark.read.text(str(tmp_path / "now")).collect()
    assert text[0][0] == ",".join(harness.COLUMNS)
    written = {r["session"]: r for r in docs.snapshots(spark, [str(tmp_path / "now")]).collect()}
    assert set(written) == {"s0", "s1"} and written["s0"]["my_ring"] == str(rows["s0"]["my_ring"])
    ring = rows["s0"]["my_ring"]
    write(tmp_path / "old.csv", f"session,filename,my_ring,my_punches\ns0,a.mp4,{ring - 3},{rows['s0']['my_punches']}\ns9,b.mp4,50,1\n")
    lines = {(r["session"], r["metric"]): r["line"] for r in harness.run(spark, sessions, str(tmp_path / "again"), str(tmp_path / "old.csv")).collect()}
    assert set(lines) == {("s0", "my_ring"), ("s1", None), ("s9", None)}
    assert lines[("s0", "my_ring")].split() == ["s0", "my_ring", f"{ring - 3}.0", f"{ring}.0", "↑", "3.0"] and "new in current" in lines[("s1", None)] and "removed" in lines[("s9", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [0.5, None]), ("b", None, None)], "session string, n int, box array<double>")
    docs.write_documents(df, str(tmp_path / "docs"))
    assert found(spark.read.schema(df.schema).json(str(tmp_path / "docs"))) == found(df)
    docs.write_csv(df, str(tmp_path / "csv"), ["n", "session"])
    assert found(spark.read.option("header", True).csv(str(tmp_path / "csv")))[1] == {("1", "a"): 1, (None, "b"): 1}


def test_status(spark, tmp_path):
    write(tmp_path / "a/meta.json", {"status": "done", "progress": 80, "metrics": {"my_ring": 51, "deep": [1, None]}, "annotated_ready": True, "sam2_my_tracked": 12, "other": 1})
    write(tmp_path / "b/meta.json", {"status": "queued"})
    write(tmp_path / "c/meta.json", "{ broken")
    told = spark.createDataFrame([("b", 0.25)], "session string, sam2_test_progress double")
    rows = {r["session"]: json.loads(r["body"]) for r in docs.status(spark, f"{tmp_path}/*/meta.json", told).collect()}
    assert set(rows) == {"a", "b"} and all(tuple(r) == docs.STATUS for r in rows.values())
    assert rows["a"]["metrics"] == {"my_ring": 51, "deep": [1, None]} and rows["a"]["progress"] == 80 and rows["a"]["sam2_my_tracked"] == 12 and rows["a"]["sam2_test_progress"] is None
    assert rows["b"]["progress"] == 0 and rows["b"]["annotated_ready"] is False and rows["b"]["metrics"] is None and rows["b"]["sam2_test_progress"] == 0.25


def test_bundle_is_json(spark, sf):
    frames = poses(spark, sf).where("session = 0")
    rows = overlays.bundle(overlays.zone_layer(frames, F.col("fi") == 0)).orderBy("fi").collect()
    items = json.loads(rows[0]["items"])
    assert [i["type"] for i in items][-1] == "skeleton" and items[0]["color"] == overlays.ZONE_HIT and len(items[-1]["kps"]) == 17


def test_stage_artifacts(spark, sf, tmp_path):
    (tmp_path / "in.bin").write_bytes(b"video")
    source = stages.content_hashes(spark, str(tmp_path / "*.bin")).first()
    assert source["content"] == hashlib.sha256(b"video").hexdigest() and source["length"] == 5
    root, content, versions = str(tmp_path / "cache"), source["content"], {"pose": 1, "stabilization": 1, "arena": 2, "metrics": 1}
    frames = poses(spark, sf).where("session = 1")
    asked = []

    def step(name, make):
        return lambda *inputs: asked.append(name) or make(*inputs)

    builders = {
        "pose": ([], step("pose", lambda: frames)), "stabilization": (["pose"], step("stabilization", lambda p: arena_motion.to_first(arena_motion.pose_steps(p)))),
        "arena": (["pose", "stabilization"], step("arena", arena_motion.refresh_arena)), "metrics": (["pose", "arena"], step("metrics", lambda p, a: p.select("session").distinct())),
    }
    assert stages.stored(spark, root, content, "pose", 1) is None
    assert stages.rebuild(spark, root, content, versions, builders) == list(builders) and stages.rebuild(spark, root, content, versions, builders) == []
    first = found(stages.stored(spark, root, content, "arena", 2))
    asked.clear()
    assert stages.refresh_arena(spark, root, content, versions, builders["arena"][1]) == ["arena"] and asked == ["arena"]
    assert found(stages.stored(spark, root, content, "arena", 2)) == first and not stages.has(spark, root, content, "metrics", 1)
    assert stages.rebuild(spark, root, content, versions | {"arena": 3}, builders) == ["arena", "metrics"]
    assert stages.invalidate(spark, root, content, "pose") == ["arena", "metrics", "pose", "reid"] and stages.has(spark, root, content, "stabilization", 1)
    with pytest.raises(ValueError, match="not all stored"):
        stages.rebuild(spark, root, content, versions, {"arena": builders["arena"]})


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    with pytest.raises(ValueError, match="share"):
        docs.checkpoint_folder(type("Session", (), {"sparkContext": Context(), "conf": {}})())


@pytest.mark.parametrize(("block", "levels"), [(1000, 0), (4, 1), (3, 2), (2, 3), (128, 2)])
def test_block_scan_equals_a_plain_product(spark, block, levels):
    rng = np.random.default_rng(1)
    rows = [(s, fi, rng.normal(size=6).tolist()) for s, n in ((1, 37), (2, 1), (3, 9)) for fi in range(n) if fi not in (4, 5, 6)]
    df = spark.createDataFrame(rows, "session int, fi int, m array<double>").select("session", "fi", arena_motion.affine(*(F.get("m", k) for k in range(6))).alias("m"), (F.col("fi") * 2).alias("more"))
    got = {(r["session"], r["fi"]): (tuple(r["m"]), r["more"]) for r in scans.block_scan(df, ["session"], "fi", "m", compose, block, levels).collect()}
    assert len(got) == len(rows)
    for s in (1, 2, 3):
        done = np.eye(3)
        for _, fi, m in (r for r in rows if r[0] == s):
            done = done @ np.vstack([np.reshape(m, (2, 3)), [0, 0, 1]])
            assert np.allclose(got[s, fi][0], done[:2].ravel(), rtol=1e-9) and got[s, fi][1] == 2 * fi


def test_two_states(spark):
    rng = np.random.default_rng(2)
    rows = [(s, fi, bool(rng.integers(2)), bool(rng.integers(2))) for s in (1, 2) for fi in range(40)]
    df = spark.createDataFrame(rows, "session int, fi int, no boolean, yes boolean")
    got = {(r["session"], r["fi"]): r["on"] for r in scans.two_states(df, ["session"], "fi", F.col("no"), F.col("yes"), "on").collect()}
    state = {1: False, 2: False}
    for s, fi, no, yes in rows:
        state[s] = yes if state[s] else no
        assert got[s, fi] == state[s]


def test_lockstep_carries_state_across_batches(spark):
    rows = [(k, fi, float(fi + k)) for k in range(7) for fi in range(50) if (k + fi) % 3]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {(r["k"], r["fi"]): r["y"] for r in folds.ema(spark.createDataFrame(rows, "k int, fi int, x double"), ["k"], "fi", "x", 0.25).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {}
    for k, fi, x in rows:
        held[k] = x if k not in held else held[k] * 0.75 + x * 0.25
        assert got[k, fi] == pytest.approx(held[k], abs=1e-12)
    assert len(got) == len(rows)


def test_ransac_against_planted_maps():
    rng = np.random.default_rng(3)
    p, theta, shift = rng.uniform(0, 500, (60, 2)), 0.3, np.array([12.0, -7.0])
    turn = np.array([[np.cos(theta), -np.sin(theta)], [np.sin(theta), np.cos(theta)]])
    q = p @ turn.T + shift + rng.normal(0, 0.2, p.shape)
    q[:20] += rng.uniform(50, 90, (20, 2))
    frame = lambda n: pd.DataFrame({"session": 1, "x": p[:n, 0], "y": p[:n, 1], "u": q[:n, 0], "v": q[:n, 1]})
    out = ransac_rigid(frame(60)).iloc[0]
    assert out["inliers"] == 40 and abs(out["theta"] - theta) < 1e-2 and np.allclose([out["tx"], out["ty"]], shift, atol=1)
    kept = np.hypot(*(p[20:] @ turn.T + shift - q[20:]).T)
    assert kept.max() < 3
    assert np.isnan(ransac_rigid(frame(7)).iloc[0]["theta"]) and np.isnan(ransac_rigid(frame(20)).iloc[0]["tx"])
    same = pd.DataFrame({"session": 1, "x": [5.0] * 9, "y": [5.0] * 9, "u": [6.0] * 9, "v": [6.0] * 9})
    assert ransac_rigid(same).iloc[0]["inliers"] == 0  # no pair tells an angle


def test_summary_takes_a_given_arena(spark, sf):
    frames = poses(spark, sf)
    given = arena_metrics.arena_of(frames)
    assert found(arena_metrics.summary(frames, given)) == found(arena_metrics.summary(frames))


def test_half_split_stream_equals_batch(spark, tmp_path):
    ticks = [(s, f"2024-01-01 00:00:{k:02d}") for s in (1, 2) for k in range(2, 8)]
    values = [(s, f"2024-01-01 00:00:{k // 4:02d}.{k % 4 * 25:02d}", float(k * s % 7)) for s in (1, 2) for k in range(40)] + [(9, "2024-01-01 00:05:00", 1.0)]
    a = spark.createDataFrame(ticks + [(9, "2024-01-01 00:05:00")], "session int, at string")
    b = spark.createDataFrame(values, "session int, ts string, v double")
    a.coalesce(1).write.json(str(tmp_path / "a"))
    b.coalesce(1).write.json(str(tmp_path / "b"))
    stream = windows.half_split(spark.readStream.schema(a.schema).json(str(tmp_path / "a")), spark.readStream.schema(b.schema).json(str(tmp_path / "b")))
    query = stream.writeStream.format("memory").queryName("halves").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    got = found(spark.table("halves"))
    assert got == found(windows.half_split(a, b)) and sum(got[1].values()) == 12




@pytest.mark.parametrize("block", [10, 16, 1000])
def test_blocks_bound_the_largest_task(spark, sf, block):
    """One session of all frames: the same rows as one window over it, and no block of more than its rows and borders."""
    from posewright.operators import series
    from posewright.plans import event_queries

    whole = found(event_queries.long_sessions(spark, sf, 10**6))
    assert found(event_queries.long_sessions(spark, sf, block)) == whole
    hot = spark.range(1000).select(F.lit(1).alias("session"), F.col("id").cast("int").alias("fi"), (F.col("id") * 7 % 31).cast("double").alias("v"))
    cut = series.in_blocks(hot, ["session"], "fi", 3, 5, block)
    assert cut.groupBy("_block").count().agg(F.max("count")).first()[0] <= min(block + 8, 1000) and cut.where("_own").count() == 1000


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_exact_median(spark, bins):
    from posewright.operators import series

    rng = np.random.default_rng(bins)
    rows = [("a", float(x)) for x in rng.normal(size=101)] + [("b", float(x)) for x in rng.integers(0, 3, 64)] + [("c", 5.0), ("d", 1e12), ("d", -1e-12), ("e", None)]
    got = {r["k"]: r["m"] for r in series.exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m", bins).collect()}
    assert got == {k: float(np.median([v for q, v in rows if q == k])) for k in "abcd"}
