"""Sharding by a hypergeometric communication matrix.

Rows are dealt into logical partitions by a hash of their key. How many rows each partition sends to each
shard is drawn exactly (a multivariate hypergeometric draw row by row of the matrix, so row sums are the
partition sizes and column sums the shard capacities). Each partition is permuted, cut at the drawn counts,
exchanged, and every shard is permuted again: a uniform shuffle with shard sizes at most one row apart.

Law `rows`: counts at most one apart. Rows of equal texts may go to different shards.

Edge cases: null keys hash like any value; rows of one key are told apart by their other columns, and rows equal in all
are ranked arbitrarily among themselves, which no result can show (copies of one row in all columns are one partition's
work); an empty table gives an empty result; columns of the input that are called shard or slot are replaced, others
may have any name.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posewright.llm.common import cut_lineage, read

N_PARTS = 4096
N_SUBS = 512


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Draw by inversion from the weights around the mode, each from the next by their exact ratio, so no large
    logarithms cancel; what lies beyond 40 standard deviations is below any double."""
    total, low, high = good + bad, max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    wide = 50 + int(40 * math.sqrt(draws * (good / total) * (bad / total)))
    k = np.arange(max(low, mode - wide), min(high, mode + wide) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[1:]) - np.log(bad - draws + k[1:])
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    sums = np.cumsum(np.exp(logs - logs.max()))
    return int(k[0]) + int(np.searchsorted(sums, rng.random() * sums[-1], "right").clip(0, len(k) - 1))


def communication_matrix(sizes: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """matrix[i][j] rows go from partition i to shard j; shard sizes differ by one at most."""
    rng, total = random.Random(seed), sum(sizes)
    free = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    out = []
    for size in sizes:
        row, left, rest = [], size, sum(free)
        for j in range(n_shards):
            rest -= free[j]
            n = hypergeometric(rng, free[j], rest, left)
            row.append(n)
            left -= n
        free = [f - n for f, n in zip(free, row)]
        out.append(row)
    return out


def shuffle_into_shards(df: DataFrame, keys: list[str], n_shards: int = 8, seed: int = 7) -> DataFrame:
    """All columns of `df` plus shard int (0 to n_shards - 1) and slot long (gapless from 0 in each shard).

    Only N_PARTS counts come to the driver, and only N_PARTS and n_shards * N_SUBS rows are broadcast,
    whatever the input's size. The rows are dealt once and written to the checkpoint folder, so that slots stay gapless
    whatever is computed again.
    """
    spark = df.sparkSession
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    # the rows travel as one struct, so that no helper column can clash with theirs
    rows = df.drop("shard", "slot")
    kept = rows.columns
    values = [rows[f"`{c}`"] for c in kept]
    plain = [v if kind.typeName() != "map" else F.map_entries(v) for v, kind in zip(values, (f.dataType for f in rows.schema.fields))]
    # hot keys are told apart by the rest of their rows
    rows = rows.select(F.struct(*values).alias("row"), F.xxhash64(F.lit(seed), *(rows[f"`{k}`"] for k in keys), *plain).alias("h"))
    rows = rows.withColumn("part", F.pmod("h", F.lit(N_PARTS)).cast("int"))
    sizes = [0] * N_PARTS
    for row in rows.groupBy("part").count().collect():
        sizes[row["part"]] = row["count"]
    cuts = []
    for i, row in enumerate(communication_matrix(sizes, n_shards, seed)):
        ends = [sum(row[: j + 1]) for j in range(n_shards)]
        cuts.append((i, ends))
    matrix = F.broadcast(spark.createDataFrame(cuts, "part int, ends array<bigint>"))

    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "h"), "h")
    dealt = (
        rows.withColumn("rank", F.row_number().over(local))
        .join(matrix, "part")
        .select("row", F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard"), F.xxhash64(F.lit(seed + 2), "h").alias("key"))
        .withColumn("sub", F.shiftrightunsigned("key", 64 - N_SUBS.bit_length() + 1).cast("int"))
    )
    dealt = cut_lineage(dealt)
    ahead = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "sub").count().select("shard", "sub", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "sub").orderBy("key")
    placed = dealt.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(starts), ["shard", "sub"])
    return placed.select(*(F.col("row")[c].alias(c) for c in kept), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(docs, ["doc_id"], 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
