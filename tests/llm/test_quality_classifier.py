import zlib

from posewright.llm import quality_classifier as q
from posewright.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op4_quality_classifier"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.93 * len(held)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    model = q.fit(odd, labels)
    rows = q.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if not r["text"]}
    assert len(same) == 1
    assert q.fit(odd, labels.where("quality = 1")) is None and q.score(odd, None).where("score = 0.5").count() == odd.count()
    assert q.score(empty, model).count() == 0
