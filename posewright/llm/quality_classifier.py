"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled texts. A text is cut into blocks, every
block is compressed with either dictionary, and the difference of the compressed sizes, divided by the text's
size, becomes a probability by logistic calibration on labelled texts that no dictionary has seen.

Fit: at most SAMPLE_ROWS labelled rows of each class with texts of at most SAMPLE_BYTES bytes, chosen by a hash
of the id; half of them make the dictionaries, the other half calibrates. Everything else covers all rows.

Edge cases: null and empty texts get the score of difference 0; labels with nulls are not used; without labelled
rows of both classes every score is 0.5; texts of any length are compressed whole, block by block; repeated rows
give equal results; an empty table gives an empty result. All columns stay, and one of the score's name is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posewright.llm.common import read

SAMPLE_ROWS = 1500
SAMPLE_BYTES = 32_768
BLOCK = 1024
DICTIONARY_BYTES = 65_536
LEVEL = 3
THRESHOLD = 0.7


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    shift: float


def blocks_of(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [b for t in texts for b in blocks_of(t)]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:DICTIONARY_BYTES] or b" "


@lru_cache(4)
def compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (good, bad))


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    """(size with the bad dictionary - size with the good one) / size; above 0 the text is more like good ones."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0.0
    by_good, by_bad = compressors(good, bad)
    blocks = blocks_of(data)
    return sum(len(by_bad.compress(b)) - len(by_good.compress(b)) for b in blocks) / len(data)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a small ridge so that separable samples stay finite."""
    w, xs = np.zeros(2), np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        grad = xs.T @ (p - y) + 1e-3 * w * (1, 0)
        step = np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs + np.diag([1e-3, 1e-6]), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """The model, or None without rows of both classes. Only the bounded sample comes to the driver."""
    texts = {}
    for label in (0, 1):
        known = labels.where(F.col(label_col) == label).select(id_col).where(F.col(id_col).isNotNull()).distinct()
        body = docs.select(id_col, text_col).where(F.octet_length(text_col).between(1, SAMPLE_BYTES))
        order = F.xxhash64(F.lit(11), id_col)
        chosen = known.join(body.select(id_col), id_col, "left_semi").orderBy(order, id_col).limit(SAMPLE_ROWS)
        rows = body.join(F.broadcast(chosen), id_col, "left_semi").orderBy(order, id_col, text_col).limit(SAMPLE_ROWS).collect()
        texts[label] = [r[text_col] for r in rows]
    if not texts[0] or not texts[1]:
        return None
    half = {k: ([t.encode() for t in v[::2]], v[1::2] or v) for k, v in texts.items()}
    good, bad = dictionary(half[1][0]), dictionary(half[0][0])
    x = np.array([difference(t, good, bad) for k in (0, 1) for t in half[k][1]])
    y = np.repeat([0.0, 1.0], [len(half[0][1]), len(half[1][1])])
    return Model(good, bad, *logistic(x, y))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a score double, a column of that name replaced."""
    docs = docs.drop(name)
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # two dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad, slope, shift = shared.value
        for batch in batches:
            z = [slope * difference(t.as_py(), good, bad) + shift for t in batch.column(at)]
            values = [1 / (1 + math.exp(-max(-700.0, min(700.0, v)))) for v in z]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    scored = score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
