"""The tracker: its rules one by one, and the same rows from batch and stream."""

import numpy as np
import pandas as pd
import pytest
from oracle import found

from posewright.operators import tracker as t
from posewright.plans.tracking import video

RED, BLUE = [9.0, 1.0, 0.0], [0.0, 1.0, 9.0]


def box(x, y=200, w=100, h=300):
    return [x, y, x + w, y + h]


def followed(frames, my=box(200), op=box(700), looks=(RED, BLUE)):
    """Columns of SHOWN for frames of (detections, looks) or (detections, looks, cut)."""
    pair, out = t.begun(1280, 720, my, op, *looks), []
    for fi, frame in enumerate(frames):
        dets, seen, cut = (*frame, False)[:3]
        pair, shown = t.advance(pair, fi, cut, dets, seen)
        out.append(shown)
    names = [c.split()[0] for c in t.SHOWN.split(", ")]
    return pd.DataFrame(out, columns=names), pair


BOTH = ([box(205), box(705)], [RED, BLUE])
NONE = ([], [])


def test_detections_are_dealt_and_frames_between_are_predicted():
    out, _ = followed([BOTH] * 7)
    assert out["my_pick"].tolist()[::3] == [0, 0, 0] and out["op_pick"].tolist()[::3] == [1, 1, 1]
    assert out["my_conf"].tolist()[:4] == [1.0, 0.85, 0.85, 1.0] and out["my_coast"].tolist() == [0] * 7
    assert out["my_reliable"].all() and not out["clinch"].any()


def test_coasting_damps_and_starts_over():
    out, pair = followed([BOTH] + [NONE] * 300)
    looked = out["my_coast"].tolist()[::3]
    assert looked[:60] == list(range(60)) and looked[60] == 15 and looked[61] == 16
    assert out["my_conf"].tolist()[3] == pytest.approx(0.8) and out["my_conf"].iloc[30] == 0 and not out["my_reliable"].iloc[3]
    assert np.abs(pair.my.v).max() < 1e-3


def test_other_looks_far_places_and_giants_are_no_match():
    assert followed([([box(205)], [BLUE])])[0]["my_pick"].isna().all()
    assert followed([([box(1100, h=290)], [RED])], op=box(100))[0]["my_pick"].isna().all()
    tall = [BOTH] * 4 + [NONE] * 2 + [([box(205, y=100, h=500)], [RED])]
    assert followed(tall)[0]["my_pick"].isna().iloc[-1]


def test_three_votes_exchange_the_tracks():
    """Looks that speak for an exchange while places do not: the third vote takes effect."""
    mixed = [5.0, 4.0, 3.0], [3.0, 4.0, 5.0]
    out, _ = followed([([box(205), box(705)], [mixed[1], mixed[0]])] * 9, looks=([6.0, 3.0, 1.0], [1.0, 3.0, 6.0]))
    assert out["my_pick"].tolist()[::3] == [0, 0, 1] or out["my_pick"].tolist()[::3] == [1, 1, 0]


def test_a_cut_forgets_heights_and_searches_by_looks():
    both = ([box(205), box(905)], [RED, BLUE])
    out, pair = followed([both] * 4 + [NONE, NONE] + [([box(980), box(125)], [RED, BLUE], True)], op=box(900))
    assert out["my_pick"].iloc[-1] == 0 and out["op_pick"].iloc[-1] == 1
    assert pair.my.cooldown == 14 and not out["my_reliable"].iloc[-1]  # found by looks, so it has to settle first
    far, _ = followed([both] * 4 + [NONE, NONE] + [([box(980), box(125, w=20, h=290)], [RED, BLUE], True)], op=box(900))
    assert far["my_pick"].iloc[-1] == 0 and far["op_pick"].isna().iloc[-1]  # too small for a fighter


def test_a_clinch_settles_for_a_while():
    near = ([box(205), box(255)], [RED, BLUE])
    out, _ = followed([near] * 1 + [BOTH] * 65, op=box(255))
    assert out["clinch"].iloc[0] and not out["clinch"].iloc[-1] and not out["my_reliable"].iloc[30] and out["my_reliable"].iloc[-1]


def test_state_survives_its_row():
    _, pair = followed([BOTH] * 5 + [NONE] * 4)
    again = t.from_row(t.to_row(pair))
    for fi in range(9, 30):
        pair, a = t.advance(pair, fi, False, *BOTH)
        again, b = t.advance(again, fi, False, *BOTH)
        assert a == b


def test_stream_equals_batch(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    video(spark, sf).selectExpr("*", "timestamp_seconds(1700000000 + fi / 15) AS ts").write.parquet(str(tmp_path / "all"))
    rows = spark.read.parquet(str(tmp_path / "all"))
    for k in range(2):  # two micro-batches that cut every session
        rows.where(f"fi {'>=' if k else '<'} 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = t.track_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    assert found(spark.table("tracked")) == found(t.track_batch(rows)) and rows.count() > 10
