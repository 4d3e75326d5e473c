"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir. Only in local mode, where driver and tasks are one process on
    one machine, may it be unset; on a cluster that is an error, as no folder of one machine is right there."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="posewright-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later reads survive lost executors.

    Spark drops the shuffle files and checkpoints of plans that nothing refers to any more, but only when the driver's
    JVM collects garbage, which a small job gives no cause to; so it is asked to before the next files are written."""
    ensure_checkpoint_dir(df.sparkSession)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`, also where `body` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


#: Bits of a table for each key, and the least and the most slots of a table (2**20 bits are 128 KB, 2**28 are 32 MB).
BITS_A_KEY = 16
LEAST_BITS, MOST_BITS = 20, 28
TABLE_PARTS = 64


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """A table of bits with the slot of every key set: a filter without misses, of 32 MB at most. Beyond some 10^8 keys
    it fills up and lets more and more other keys pass, which costs time and changes no result.

    Tasks set the bits of one part of the table each; the driver only puts the parts side by side."""
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_A_KEY).bit_length()))
    size = (1 << bits) // TABLE_PARTS
    slots = keys.select(F.pmod(column, F.lit(1 << bits)).alias("slot")).distinct().select(F.expr(f"cast(slot div {size} as int)").alias("part"), F.expr(f"cast(slot % {size} as int)").alias("at"))

    def fill(table: pa.Table) -> pa.Table:
        own = np.zeros(size, np.uint8)
        own[table["at"].to_numpy()] = 1
        return pa.table({"part": table["part"].slice(0, 1), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((TABLE_PARTS, size // 8), np.uint8)
    for row in slots.groupBy("part").applyInArrow(fill, "part int, bits binary").toLocalIterator():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel().view(np.uint32)


def in_bit_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.astype(np.int64) & np.int64(len(table) * 32 - 1)
    return (table[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1) == 1
