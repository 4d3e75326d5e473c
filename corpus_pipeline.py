"""The corpus pipeline: from raw documents to token ids.

Each stage gets the documents that the one before it kept, and all but the last return the columns of documents.
Rows that share a doc_id are one document: they stay or go together. Rows without an id link with nothing by id
and are judged by their own text. Null and empty texts pass the stages unless the classifier rejects them.
Texts may have any length and are handled whole in each stage; further columns stay as they are up to the last stage,
whatever their names; an empty table passes every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posewright.llm import bpe, decontaminate, jaccard_join, quality_classifier, secrets
from posewright.llm.common import cut_lineage, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the compression classifier holds the label 1 likely enough."""
    labels = read(spark, sf_dir, "labels").where(~quality_classifier.held_out())
    model = quality_classifier.fit(docs, labels)
    if model is None:
        return docs
    # the score goes under a name that the documents don't have
    name = "quality" + "_" * (1 + max(map(len, docs.columns)))
    scored = quality_classifier.score(docs, model, name=name)
    return scored.where(F.col(name) >= quality_classifier.THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    placed = jaccard_join.jaccard_components(docs)
    gone = placed.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digests of ids and decoded text."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(docs, path, bpe.build_lexicon(docs, path))
    return coded.select("doc_id", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_removal),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
