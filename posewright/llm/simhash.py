"""SimHash fingerprints and near duplicates by multi-index hashing.

1. Fingerprints. Each shingle is hashed; a bit of the fingerprint is set if over half of the hashes have it. Equal
   fingerprints are one from here on, so copies cost nothing.
2. Close ones. Each fingerprint names itself and its 64 neighbours. Those that meet under a name are at a distance of 2
   at most, so they are linked in a row; a name has 65 fingerprints at most. Components of these links are contracted.
3. Tables. Fingerprints at a distance of RADIUS = 4 at most agree, in one of the segments that their bits are split
   into, up to a small distance: with s segments, one of the first 4 % s + 1 of them differs in at most 4 // s bits, or
   one of the others in less. So each fingerprint is entered under its segments, looked up under the small Hamming ball
   around each of them, and a match is verified by the complete distance. A pair inside one component is no longer
   asked for.
4. Full entries. Where over FULL fingerprints share a segment, what is left of their bits is split and indexed
   in the same way, so that no key is long and none needs a list in memory.
5. Components of all links.

The number of segments follows the number of fingerprints, as wide segments pay where there are many; the rows of the
result do not depend on it.

Edge cases: null and empty texts, and texts of spaces alone, have the fingerprint zero and are linked like any other;
fewer words than the shingle's length make one shingle; repeated rows are equal fingerprints; null ids stay and count as
larger than any other, and a component without any other id is null; an empty table gives an empty result; shingles of a
long text are hashed some at a time; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewright.llm.common import cut_lineage, read
from posewright.llm.components import components
from posewright.llm.hashing import text_groups

N = 4
SEED = 42
BITS = 64
RADIUS = 4
#: Fingerprints of one table entry beyond which the rest of their bits is indexed too.
FULL = 1000
#: Beyond so many fingerprints two segments cost less than three.
MANY = 1 << 26
#: Fingerprints that one task spreads over its keys.
TASK_ROWS = 10_000
#: Shingles that are hashed at a time.
BLOCK = 200_000
SPACE = re.compile(rb"[\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the lowest on."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str | None, n: int = N) -> int:
    data = SPACE.sub(b" ", (text or "").encode("utf-8", "replace").translate(LOWER)).strip(b" ")
    if not data:
        return 0
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.append(0, cuts + 1), np.append(cuts, len(data))
    starts, ends = (starts[: 1 - n], ends[n - 1 :]) if len(starts) >= n else (starts[:1], ends[-1:])
    total, hashed = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), BLOCK):
        spans = zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())
        total += bit_sums(np.array([hashed(data[a:z], SEED) for a, z in spans], np.uint64))
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """(id, f): the fingerprint of each row as a signed number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, n) for _, texts in text_groups(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=[id_col, "f"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, f long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def neighbours(at: Column, bits: list[int], radius: int) -> Column:
    """Array of all values that differ from `at` in up to `radius` of the bits."""
    flips = [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(bits, r)]
    return F.transform(F.array(*(F.lit(signed(x)) for x in flips)), lambda flip: at.bitwiseXOR(flip))


def close_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all links at a distance of two at most."""
    named = distinct.select("f", F.explode(neighbours(F.col("f"), list(range(BITS)), 1)).alias("name"))
    met = named.groupBy("name").agg(F.sort_array(F.collect_list("f")).alias("fs")).where(F.size("fs") > 1)  # 65 at most
    return met.select(F.explode(F.zip_with(F.slice("fs", 1, F.size("fs") - 1), F.slice("fs", 2, F.size("fs") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("l")).select("l.a", "l.b").distinct()


def segments(width: int, count: int) -> list[tuple[int, int, int]]:
    """(first bit, end, radius): two values at a distance of RADIUS at most differ in one segment by its radius at most."""
    cuts = [width * k // count for k in range(count + 1)]
    return [(a, z, RADIUS // count - (k > RADIUS % count)) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]


def far_links(named: DataFrame, count: int, full: int) -> DataFrame:
    """(a, b): each link between fingerprints of two components at least once. named: (f, c).

    Rows are entered under their segments and looked up under the ball around them; a radius of two is split, a ball of
    one on either side. `rest` holds the bits that the keys so far don't tell; full buckets go on to the next level."""
    found, width = [], BITS
    rows = named.select(F.lit(0).cast("long").alias("bucket"), "f", "c", F.col("f").alias("rest"), F.explode(F.array(F.lit(True), F.lit(False))).alias("own"))
    while True:
        entered, sought = [], []
        for a, z, radius in segments(width, count):
            at = F.shiftrightunsigned("rest", a).bitwiseAND(F.lit((1 << (z - a)) - 1))
            above = F.shiftleft(F.shiftrightunsigned("rest", z), a) if z < width else F.lit(0).cast("long")
            rest = F.col("rest").bitwiseAND(F.lit((1 << a) - 1)).bitwiseOR(above).alias("rest")
            for own, ball, out in ((True, radius // 2, entered), (False, radius - radius // 2, sought)):
                near = rows.where("own" if own else "not own").select(F.explode(neighbours(at, list(range(z - a)), ball)).alias("at"), "bucket", "f", "c", rest)
                out.append(near.select(F.xxhash64("bucket", F.lit(a), "at").alias("bucket"), "f", "c", "rest"))
        entered, sought = reduce(DataFrame.unionByName, entered), reduce(DataFrame.unionByName, sought)
        width -= width // count
        large = None
        if width >= 2 * count:
            large = cut_lineage(entered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > full).select("bucket"))
            large = None if large.isEmpty() else large
        if large is not None:
            rows = entered.withColumn("own", F.lit(True)).unionByName(sought.withColumn("own", F.lit(False))).join(large, "bucket", "left_semi")
            entered, sought = entered.join(large, "bucket", "left_anti"), sought.join(large, "bucket", "left_anti")
        sought = sought.select(F.col("bucket").alias("_bucket"), F.col("f").alias("b"), F.col("c").alias("cb"))
        linked = (F.col("bucket") == F.col("_bucket")) & (F.col("f") < F.col("b")) & (F.col("c") != F.col("cb")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("b"))) <= RADIUS)
        found.append(entered.join(sought, linked).select(F.col("f").alias("a"), "b"))
        if large is None:
            return reduce(DataFrame.unionByName, found)
        rows = cut_lineage(rows)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, full: int = FULL, count: int | None = None) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable)."""
    placed = cut_lineage(fingerprints(docs, id_col, text_col, n))
    distinct = cut_lineage(placed.select("f").distinct())
    total = distinct.count()
    if count is None:
        count = 2 if total > MANY else 3
    # a few megabytes become some hundred rows each, so their tasks go by rows and not by bytes
    tasks = 1 + total // TASK_ROWS
    distinct = distinct.repartition(tasks)
    close = cut_lineage(close_links(distinct))
    named = cut_lineage(distinct.join(components(close).withColumnRenamed("node", "f"), "f", "left").select("f", F.coalesce("component", "f").alias("c")))
    far = far_links(named.repartition(tasks), count, full)
    # components of the contracted ones: links between the names of components
    ends = far.join(named.select(F.col("f").alias("a"), F.col("c").alias("ca")), "a").join(named.select(F.col("f").alias("b"), F.col("c").alias("cb")), "b")
    joined = components(cut_lineage(ends.select("ca", "cb").distinct()), "ca", "cb").withColumnRenamed("node", "c")
    named = named.join(joined, "c", "left").select("f", F.coalesce("component", "c").alias("c"))
    placed = cut_lineage(placed.join(named, "f"))
    least = placed.groupBy("c").agg(F.min(id_col).alias("component_id"))
    return placed.join(least, "c").select(id_col, F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
