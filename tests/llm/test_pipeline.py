import hashlib
import struct

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from posewright.llm import decontaminate, secrets
from test_jaccard import brute as brute_components


def test_stages_brute_force(spark, sf):
    """Every stage's effect on all rows that the one before it kept."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    benchmark = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5

    out = corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()
    kept = {r["doc_id"] for r in out}
    known = [r["doc_id"] for r in rows if r["doc_id"] in labels]
    assert sum((d in kept) == (labels[d] == 1) for d in known) >= 0.9 * len(known)

    docs, rows = spark.createDataFrame(out, docs.schema), out
    out = corpus_pipeline.STAGES[1][1](spark, docs, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted({c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in rows])})

    docs, rows = spark.createDataFrame(out, docs.schema), out
    out = corpus_pipeline.STAGES[2][1](spark, docs, sf).collect()
    gone = {r["doc_id"] for r in rows} - {r["doc_id"] for r in out}
    for r in rows:
        text = decontaminate.normal(r["text"])
        exact = any(b in text for b in benchmark if b.count(b" ") >= decontaminate.MIN_WORDS)
        assert exact <= (r["doc_id"] in gone)
        if r["doc_id"] in gone:
            assert any(decontaminate.least_distance(b, text, len(b) // 5) is not None for b in benchmark)

    docs, rows = spark.createDataFrame(out, docs.schema), out
    out = corpus_pipeline.STAGES[3][1](spark, docs, sf).collect()
    assert out and list(out[0].asDict()) == columns and len(out) == len(rows)
    after = {r["doc_id"]: r for r in out}
    for r in rows:
        assert secrets.base_spans(after[r["doc_id"]]["text"]) == [] and after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])
        if not secrets.base_spans(r["text"]):
            assert after[r["doc_id"]] == r

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.createDataFrame(out, docs.schema)
    final = {r["doc_id"]: r for r in corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()}
    assert set(final) == set(after)
    for d, r in final.items():
        ids = library.encode(after[d]["text"], add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {d: r["ids_sha256"] for d, r in final.items()}


def test_odd_rows(spark, sf, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, empty):
            assert stage(spark, docs, sf).columns == odd.columns, name
            assert stage(spark, docs, sf).count() <= docs.count()
    assert corpus_pipeline.STAGES[1][1](spark, odd, sf).where("doc_id is null").count() == 2
    assert corpus_pipeline.STAGES[4][1](spark, odd, sf).count() == odd.count()
