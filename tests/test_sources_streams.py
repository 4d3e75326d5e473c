import json

from oracle import found

from posewright.sources import documents as docs
from posewright.streaming import windows

BOX = [0.1, 0.2, 0.3, 0.8]


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))


def test_documents(spark, tmp_path):
    frame = {"fi": 0, "raw_fi": 0, "time_s": 0.0, "my_bbox": BOX, "op_bbox": None, "my_kps": [[0.1, 0.2, 0.9], None], "op_kps": None, "clinch": False}
    write(tmp_path / "a/frames.json", {"fps_pose": 10.0, "frames": [frame, frame | {"fi": 1, "raw_fi": 2}]})
    write(tmp_path / "b/frames.json", "no document {")
    write(tmp_path / "a/arena.json", {"ok": True, "centroid": [1.0, 2.0], "median_scale_px": 0.0, "warps_to_ref": [[[1, 0, 0], [0, 1, 0]]], "my_traj_ref": [[1.0, 2.0], None], "op_traj_ref": []})
    rows = docs.frames(spark, f"{tmp_path}/*/frames.json").orderBy("fi").collect()
    assert [(r["session"], r["fi"], r["fps_pose"], r["frame_w"], r["my_bbox"], r["op_bbox"]) for r in rows] == [("a", 0, 10.0, 1, BOX, None), ("a", 1, 10.0, 1, BOX, None)]
    arena = docs.arena(spark, f"{tmp_path}/*/arena.json")
    assert [(r["session"], r["centre_x"], r["scale"], r["tier"]) for r in arena.collect()] == [("a", 1.0, 100.0, "none")]
    tracks = docs.arena_frames(spark, f"{tmp_path}/*/arena.json").orderBy("fi").collect()
    assert [(r["fi"], r["warp"] is not None, r["my_ref"], r["op_ref"]) for r in tracks] == [(0, True, [1.0, 2.0], None), (1, False, None, None)]
    assert docs.with_both(docs.frames(spark, f"{tmp_path}/*/frames.json"), arena).count() == 2


def test_maps_samples_and_snapshots(spark, tmp_path):
    boxes = spark.createDataFrame([(1, '{"0": [[1,2,3,4,0.5],[2,3,4,5,0.9]], "7": []}'), (2, "no map")], "session long, boxes string")
    assert [tuple(r) for r in docs.keyed_boxes(boxes, "boxes").orderBy("place").collect()] == [(1, 0, 0, 1.0, 2.0, 3.0, 4.0, 0.5), (1, 0, 1, 2.0, 3.0, 4.0, 5.0, 0.9)]
    assert [r[0] for r in docs.sampled(spark.range(0, 50).withColumnRenamed("id", "raw_fi"), 1.0, 4, 20).collect()] == [0, 4, 8, 12, 16, 20]
    assert [r["raw_fi"] for r in docs.fraction_frames(spark.createDataFrame([(1, 100)], "session long, total_frames long")).collect()] == [10, 22, 35, 48, 61, 75]
    write(tmp_path / "x.csv", "session,ring\na,5\n")
    write(tmp_path / "y.csv", "session,guard\nb,7\n")
    assert found(docs.snapshots(spark, [str(tmp_path / "x.csv"), str(tmp_path / "y.csv")]))[1] == {(None, "5", "a"): 1, ("7", None, "b"): 1}


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "meta")
    spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "session string, n int, status string").write.partitionBy("session").parquet(path)
    docs.upsert(spark, path, spark.createDataFrame([("b", 3, None), ("c", 4, "new")], "session string, n int, status string"))
    assert found(spark.read.parquet(path).select("session", "n", "status"))[1] == {(1, "a", "old"): 1, (3, "b", "old"): 1, (4, "c", "new"): 1}


ROWS = [(s, f"2024-01-01 00:00:{sec:02d}.{ms}00", side, v) for s in (1, 2) for sec, ms, side, v in ((0, 1, "my", 3.0), (0, 5, "op", 1.0), (1, 2, "my", 2.0), (1, 7, "my", 2.0), (2, 1, "my", 9.0), (9, 1, "op", 4.0))]


def streamed(spark, tmp_path, make, mode):
    """Result of a query over all files of a folder, one file a micro-batch."""
    schema, name = "session long, ts string, side string, v double", f"s{abs(hash(str(tmp_path)))}"
    for k in range(0, len(ROWS), 6):
        spark.createDataFrame(ROWS[k : k + 6], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    batch = spark.createDataFrame(ROWS, "session long, ts string, side string, v double")
    for k, make in enumerate((windows.bucket_share, windows.sliding_sum, lambda s: windows.gap_events(s, "side = 'my'"))):
        assert found(streamed(spark, tmp_path / str(k), make, "complete")) == found(make(batch))


def test_swap_votes(spark, tmp_path):
    out = streamed(spark, tmp_path, lambda s: windows.swap_votes(s, "side = 'my'"), "update")
    assert found(out.groupBy("session").max("swaps"))[1] == {(1, 1): 1, (1, 2): 1}
