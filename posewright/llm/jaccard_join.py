"""N-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance d is a metric, and two texts link when d <= R = 1/4. Equal sets are one member with many texts.

1. The mass at distance 1. Most sets share nothing, and no pivot tells them apart. Linked sets share one of their
   first n - ceil(3n/4) + 1 shingles in any global order (here rare shingles first, by counts of all sets in a table
   of fixed size, then by hash), so only the sets that meet under such a shingle are compared: its region. The
   region's first pivot is its least member; a set is in the region of each pivot that it meets so. Chance meetings
   grow faster than the input, so members of regions of at most REGION_BLOCK first show signatures of a bit a shingle:
   the bits in which two differ are no more than their shingles that differ, so who is too far from all others leaves.
2. Balls. The exact distance of every member to its first pivots is found; members within R link to the pivot. What
   these links connect needs no further look: a region of one component is done.
3. Voronoi regions. In an open region of more than REGION_BLOCK members, PIVOTS further pivots are drawn from its
   components by hash. Members within R of a pivot link to it. Each member belongs to the Voronoi region of its nearest
   pivot, at distance h, and is replicated into that of every pivot within h + 2R: by the triangle inequality each
   link between two members lies in one of these regions whole. They join recursively in the same way.
4. Leaves. In a region of at most REGION_BLOCK members, those outside the largest component are compared with what
   the triangle inequality leaves: members whose distance to the region's pivot differs by at most R, and whose size
   allows a link. A region that pivots don't separate (its windows would hold over GROWTH times its members, or one
   of them over half) is compared in blocks instead: members outside its largest component with all.
5. Components of the links.

Exact copies and hot near copies cost rows in proportion to their number: links go to pivots, never to all pairs.
Shingles and sets are compared by 64-bit hashes.

Edge cases: null and empty texts have an empty set, link with nothing and are their own component; fewer words than
n make one shingle; repeated rows are members of equal sets; null ids stay null and count as larger than any other;
an empty table gives an empty result; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posewright.llm.common import bit_table, cut_lineage, in_bit_table, read
from posewright.llm.components import components
from posewright.llm.hashing import mixed, packed, text_groups, unpacked, word_hashes

N = 5
LEVEL_BITS = 24
REGION_BLOCK = 512
BASE_BLOCK = 4096
PIVOTS = 8
GROWTH = 2.0
R = 0.25
PART_BYTES = 4_000_000
IS_WORD = np.ones(256, bool)
IS_WORD[[32, *range(9, 14)]] = False
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds): the sorted distinct shingle hashes of text k are shingles[bounds[k]:bounds[k + 1]]."""
    parts = [(t or "").encode("utf-8", "replace").translate(LOWER) for t in texts]
    starts, _, words = word_hashes(b"\n".join(parts) + b"\n", IS_WORD)
    text_of = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, "right")
    counts = np.bincount(text_of, minlength=len(parts))
    first = np.cumsum(counts) - counts
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(parts)), sizes)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gram = mixed(np.minimum(counts, n).astype(np.uint64)[owner] + np.uint64(77))
    for k in range(n):
        inside = k < counts[owner]
        gram = np.where(inside, mixed(gram ^ words[np.minimum(at + k, len(words) - 1)]), gram) if len(words) else gram
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[fresh], owner[fresh]
    return gram, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(parts))))).astype(np.int64)


def set_key(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def prefix_length(n: int) -> int:
    """A set of n shingles and any set that it links with share one of their first so many in any global order."""
    return n - -(-3 * n // 4) + 1


def signature(shingles: np.ndarray) -> bytes:
    """For each slot of the shingles' lowest bits, of which there are as many as shingles or up to twice as many, whether
    the number of shingles in it is odd. Two signatures differ in no more bits than the sets have shingles apart."""
    slots = 1 << max(6, (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_link(sizes: np.ndarray, signatures: list[bytes]) -> np.ndarray:
    """Which sets of a region the sizes and signatures let link to another: sets that link have sizes within 3/4 of each
    other, so as many slots or half of them, and at most a seventh of both sizes apart."""
    out = np.zeros(len(sizes), bool)
    slots = np.array([len(x) for x in signatures])
    for own in np.unique(slots):
        here = np.flatnonzero((slots == own) | (slots == 2 * own))
        table = np.stack([(x := np.frombuffer(signatures[k], np.uint64))[: own // 8] ^ (x[own // 8 :] if slots[k] > own else np.uint64(0)) for k in here])
        for i in np.flatnonzero(slots[here] == own):
            apart = np.bitwise_count(table ^ table[i]).sum(1, dtype=np.int64)
            n, m = sizes[here], sizes[here[i]]
            found = (7 * apart <= n + m) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))
            found[i] = False
            if found.any():
                out[here[found]] = out[here[i]] = True
    return out


def frequency_levels(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """For each of 2**LEVEL_BITS slots of shingle hashes the greatest level of a shingle in it: 0 where only one set
    has it, else 1 and more by the logarithm of the number of sets. All sets are counted; the table has a fixed size.

    Tasks send the first 32 bits of their hashes, sorted and packed, to the part that counts their range.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    part_bits = min(20, max(4, (size // PART_BYTES).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, found = set(), []
            for _, texts in text_groups(batch.column(0)):
                grams, bounds = shingle_sets(texts, n)
                for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    if z > a and (key := set_key(grams[a:z])) not in seen:
                        seen.add(key)
                        found.append((grams[a:z] >> np.uint64(32)).astype(np.uint32))
            if found:
                values = np.sort(np.concatenate(found))
                cuts = np.searchsorted(values, np.arange(1 << part_bits) << (32 - part_bits))
                bounds = np.append(cuts, len(values))
                parts = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([packed(values[bounds[p] : bounds[p + 1]]) for p in parts], pa.binary())], names=["part", "hashes"])

    def count(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        values, counts = np.unique(np.concatenate([unpacked(h.as_py()) for h in table["hashes"]]), return_counts=True)
        levels = np.zeros(1 << (LEVEL_BITS - part_bits), np.uint8)
        many = counts > 1
        np.maximum.at(levels, (values[many] >> (32 - LEVEL_BITS)) - (part << (LEVEL_BITS - part_bits)), np.log2(counts[many]).astype(np.uint8))
        return pa.table({"part": pa.array([part], pa.int32()), "levels": pa.array([levels.tobytes()], pa.binary())})

    counted = docs.select(text_col).mapInArrow(send, "part int, hashes binary").groupBy("part").applyInArrow(count, "part int, levels binary")
    out = np.zeros((1 << part_bits, 1 << (LEVEL_BITS - part_bits)), np.uint8)
    for row in cut_lineage(counted).toLocalIterator():
        out[row["part"]] = np.frombuffer(row["levels"], np.uint8)
    return out.ravel()


def sketch(docs: DataFrame, id_col: str, text_col: str, levels: np.ndarray, n: int) -> DataFrame:
    """(id, k, n_shingles, prefix, signature): set key and size of each text, and the shingles by which its set can meet
    others, of its first in the order of level and hash those that more than one set has; equal sets of a batch once."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 2**LEVEL_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for begin, texts in text_groups(batch.column(1)):
                grams, bounds = shingle_sets(texts, n)
                keys, sizes, out, signs = [], [], [], []
                level = shared.value[(grams >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
                for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    keys.append(key := set_key(grams[a:z]))
                    sizes.append(z - a)
                    # single shingles come first; of the others as many as then still belong to the prefix
                    left = prefix_length(z - a) - int((level[a:z] == 0).sum())
                    if z == a or left <= 0 or key in seen:
                        out.append(None)
                        signs.append(None)
                        continue
                    seen.add(key)
                    signs.append(signature(grams[a:z]))
                    own, rank = grams[a:z][level[a:z] > 0], level[a:z][level[a:z] > 0]
                    out.append(own[np.argsort(rank, kind="stable")][:left].astype(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=[id_col, "k", "n_shingles", "prefix", "signature"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, k long, n_shingles long, prefix array<long>, signature binary")


def least_keys(shingles: np.ndarray, keys: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles in order, the least key of each, and whether it has two keys or is marked so."""
    order = np.lexsort((keys, shingles))
    shingles, keys = shingles[order], keys[order]
    first = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
    last = np.append(first[1:], len(shingles)) - 1
    return shingles[first], keys[first], (keys[first] != keys[last]) | np.logical_or.reduceat(many[order], first)


def prefix_entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(keys, shingles) of a batch of (k, prefix)."""
    counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    return np.repeat(batch.column(0).to_numpy(), counts), batch.column(1).flatten().to_numpy()


def shared_shingles(sketched: DataFrame) -> DataFrame:
    """(shingle, pivot): the shingles that the prefixes of two sets or more have, and the least key of these sets.

    The table of levels has a fixed size and fills up, so that in the end whole prefixes come here. Tasks therefore send
    each shingle of a batch once, sorted and packed, with its least key, to the part that holds its range."""
    total = sketched.agg(F.sum(F.array_size("prefix"))).first()[0] or 0
    part_bits = min(20, max(4, (16 * total // PART_BYTES).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shingles = prefix_entries(batch)
            if not len(keys):
                continue
            values, keys, many = least_keys(shingles.view(np.uint64), keys, np.zeros(len(keys), bool))
            bounds = np.append(np.searchsorted(values, np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits)), len(values))
            parts = np.flatnonzero(np.diff(bounds))
            ranges = [slice(bounds[p], bounds[p + 1]) for p in parts]
            columns = ([packed(values[r]) for r in ranges], [keys[r].tobytes() for r in ranges], [many[r].tobytes() for r in ranges])
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "shingles", "keys", "many"])

    def meet(table: pa.Table) -> pa.Table:
        shingles = np.concatenate([unpacked(x.as_py()) for x in table["shingles"]]).view(np.uint64)
        keys, many = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[name]]) for name, kind in (("keys", np.int64), ("many", bool)))
        shingles, keys, many = least_keys(shingles, keys, many)
        return pa.table({"shingle": pa.array(shingles[many].view(np.int64)), "pivot": pa.array(keys[many])})

    sent = sketched.select("k", "prefix").mapInArrow(send, "part int, shingles binary, keys binary, many binary")
    return sent.groupBy("part").applyInArrow(meet, "shingle long, pivot long")


def prefix_rows(sketched: DataFrame, shared: DataFrame) -> DataFrame:
    """(k, shingle): the entries of the prefixes that a bit table of the shared shingles lets pass."""
    table = sketched.sparkSession.sparkContext.broadcast(bit_table(shared, "shingle"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shingles = prefix_entries(batch)
            kept = in_bit_table(table.value, shingles)
            yield pa.RecordBatch.from_arrays([pa.array(keys[kept], pa.int64()), pa.array(shingles[kept], pa.int64())], names=["k", "shingle"])

    return sketched.select("k", "prefix").mapInArrow(run, "k long, shingle long")


def promising(met: DataFrame, sketched: DataFrame) -> DataFrame:
    """The rows (k, pivot) of met whose set the signatures let link to another one of its region, and all rows of regions
    of more than REGION_BLOCK members. Regions are dealt to groups of some thousand rows."""
    counts = met.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    sized = cut_lineage(met.join(counts, "pivot"))
    small = sized.where(F.col("n") < REGION_BLOCK)
    deal = F.pmod(F.xxhash64("pivot"), F.lit(1 + small.count() // 5000)).alias("deal")
    wanted = small.select("k", "pivot").unionByName(small.select(F.col("pivot").alias("k"), "pivot").distinct())
    signed = sketched.where("signature is not null").groupBy("k").agg(F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pivot")
        pivot, k, n = (table[c].to_numpy() for c in ("pivot", "k", "n"))
        signatures = table["signature"].to_pylist()
        bounds = np.append(np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])), len(pivot)).tolist()
        kept = np.concatenate([may_link(n[a:z], signatures[a:z]) for a, z in zip(bounds[:-1], bounds[1:])]) & (k != pivot)
        return pa.table({"k": pa.array(k[kept]), "pivot": pa.array(pivot[kept])})

    near = wanted.join(signed, "k").select(deal, "pivot", "k", "n", "signature").groupBy("deal").applyInArrow(run, "k long, pivot long")
    return cut_lineage(near.unionByName(sized.where(F.col("n") >= REGION_BLOCK).select("k", "pivot")))


def members_with_sets(docs: DataFrame, text_col: str, wanted: DataFrame, n: int) -> DataFrame:
    """(k, shingles) of the wanted sets. A bit table of fixed size lets the tasks drop nearly all other texts early."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for _, texts in text_groups(batch.column(0)):
                grams, bounds = shingle_sets(texts, n)
                out = {}
                keys = [set_key(grams[a:z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                for k in np.flatnonzero(in_bit_table(bits, np.array(keys, np.int64)) & (np.diff(bounds) > 0)).tolist():
                    out[keys[k]] = grams[bounds[k] : bounds[k + 1]].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["k", "shingles"])

    found = docs.select(text_col).mapInArrow(run, "k long, shingles binary")
    return found.join(wanted, "k", "left_semi").groupBy("k").agg(F.first("shingles").alias("shingles"))


@F.pandas_udf(T.LongType())
def common_shingles(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted arrays of 64-bit numbers."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def linked(common, size_a, size_b):
    """100 * intersection >= 75 * union, for numbers, arrays and columns."""
    return 100 * common >= 75 * (size_a + size_b - common)


def join_region(keys: np.ndarray, sets: list[np.ndarray], component: np.ndarray, far: np.ndarray, probe: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that join what is still apart in a region. far: distance to the region's pivot. probe: the members to be
    compared with all others; None for a whole region, where those of the largest component need not be."""
    names, label = np.unique(component, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    flat, bounds = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))[:-1]
    links, untried = [], np.ones(len(keys), bool) if probe is None else probe.copy()
    while True:
        outside = np.flatnonzero(untried & (label != np.bincount(label, minlength=len(names)).argmax()) if probe is None else untried)
        if not len(outside):
            return links
        pivot = outside[0]
        untried[pivot] = False
        may = (label != label[pivot]) & (np.abs(far - far[pivot]) <= R + 1e-9) & (4 * np.minimum(sizes, sizes[pivot]) >= 3 * np.maximum(sizes, sizes[pivot]))
        if not may.any():
            continue
        at = np.minimum(np.searchsorted(sets[pivot], flat), sizes[pivot] - 1)
        common = np.add.reduceat((sets[pivot][at] == flat).astype(np.int64), bounds)
        for other in np.flatnonzero(may & linked(common, sizes, sizes[pivot])):
            links.append((int(keys[pivot]), int(keys[other])))
            if label[other] != label[pivot]:
                label[label == label[other]] = label[pivot]


def leaf(table: pa.Table) -> pa.Table:
    """One group of members; with a column `probe`, those to be compared with the others."""
    sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["shingles"]]
    probe = np.array(table["probe"].to_pylist(), bool) if "probe" in table.column_names else None
    found = join_region(table["k"].to_numpy(), sets, table["component"].to_numpy(), table["far"].to_numpy(), probe)
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def in_blocks(rows: DataFrame) -> DataFrame:
    """(a, b): links inside regions that pivots don't separate: REGION_BLOCK members outside the largest component
    against BASE_BLOCK of all members at a time."""
    sizes = rows.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("region").agg(F.sum("n").alias("n"), F.max_by("component", "n").alias("largest"), (F.sum("n") - F.max("n")).alias("n_probes"))
    at = lambda n, size: F.pmod(F.xxhash64("k", F.lit(size)), F.ceil(F.col(n) / size)).cast("int")
    spread = lambda n, size: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / size).cast("int") - 1))
    placed = rows.join(cut_lineage(sizes), "region")
    base = placed.withColumn("base", at("n", BASE_BLOCK)).withColumn("block", spread("n_probes", REGION_BLOCK)).withColumn("probe", F.lit(False))
    probes = placed.where("component <> largest").withColumn("block", at("n_probes", REGION_BLOCK)).withColumn("base", spread("n", BASE_BLOCK)).withColumn("probe", F.lit(True))
    return base.unionByName(probes).select("region", "block", "base", "probe", "k", "component", "far", "shingles").groupBy("region", "block", "base").applyInArrow(leaf, "a long, b long")


def voronoi(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links to the pivots, members of the Voronoi regions, members of the regions that pivots don't separate).
    rows: (region, k, component, far, shingles) of large regions."""
    drawn = rows.groupBy("region", F.pmod(F.xxhash64("component", "region"), F.lit(PIVOTS)).alias("at")).agg(F.min_by(F.struct("k", "component", "shingles"), F.xxhash64("k", "region")).alias("pivot"))
    pivots = cut_lineage(drawn.groupBy("region").agg(F.collect_list("pivot").alias("pivots")))  # PIVOTS a region at most

    @F.pandas_udf("array<struct<k: long, component: long, far: double, links: boolean>>")
    def measured(shingles: pd.Series, pivots: pd.Series) -> pd.Series:
        out = []
        for own, others in zip(shingles, pivots):
            own, row = np.frombuffer(own, np.uint64), []
            for p in others:
                other = np.frombuffer(p["shingles"], np.uint64)
                c = len(np.intersect1d(own, other, assume_unique=True))
                row.append({"k": p["k"], "component": p["component"], "far": 1 - c / (len(own) + len(other) - c), "links": bool(linked(c, len(own), len(other)))})
            out.append(row)
        return pd.Series(out)

    at_all = cut_lineage(rows.join(pivots, "region").withColumn("d", measured("shingles", "pivots")).drop("pivots", "far"))
    links = at_all.select("k", F.explode(F.filter("d", lambda p: p["links"])).alias("p")).select(F.col("k").alias("a"), F.col("p.k").alias("b")).where("a <> b")
    home = F.array_min(F.transform("d", lambda p: p["far"]))
    # a member that links to a pivot is in that pivot's component from here on
    joined = F.coalesce(F.get(F.filter("d", lambda p: p["links"]), 0)["component"], F.col("component"))
    moved = at_all.select("region", "k", joined.alias("component"), "shingles", F.explode(F.filter("d", lambda p: p["far"] <= home + 2 * R + 1e-9)).alias("p"))
    moved = moved.select("region", F.xxhash64("region", "p.k").alias("into"), "k", "component", F.col("p.far").alias("far"), "shingles")
    own = at_all.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    parts = moved.groupBy("region", "into").agg(F.count(F.lit(1)).alias("m")).groupBy("region").agg(F.sum("m").alias("m"), F.max("m").alias("most"))
    grown = cut_lineage(parts.join(own, "region").select("region", ((F.col("m") > GROWTH * F.col("n")) | (2 * F.col("most") > F.col("n"))).alias("whole")))
    apart = moved.join(grown.where("not whole"), "region", "left_semi").drop("region").withColumnRenamed("into", "region")
    whole = rows.join(grown.where("whole"), "region", "left_semi")
    return links, cut_lineage(still_open(apart)), whole


def still_open(rows: DataFrame) -> DataFrame:
    """Without the regions whose members are one component."""
    done = rows.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low = high")
    return rows.join(done, "region", "left_anti")


def recurse(rows: DataFrame) -> DataFrame:
    """(a, b): further links inside open regions. rows: (region, k, component, far, shingles)."""
    found = []
    while True:
        large = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REGION_BLOCK).select("region")
        found.append(rows.join(large, "region", "left_anti").groupBy("region").applyInArrow(leaf, "a long, b long"))
        if large.isEmpty():
            break
        links, rows, whole = voronoi(cut_lineage(rows.join(large, "region", "left_semi")))
        found += [links, in_blocks(whole)]
    return reduce(DataFrame.unionByName, found)


def near_links(docs: DataFrame, text_col: str, sketched: DataFrame, n: int = N) -> DataFrame:
    """(a, b): links between set keys whose components are those of all links."""
    shared = cut_lineage(shared_shingles(sketched))
    met = cut_lineage(prefix_rows(sketched, shared).join(shared, "shingle").where("k <> pivot").select("k", "pivot").distinct())
    met = promising(met, sketched)
    wanted = met.select("k").unionByName(met.select(F.col("pivot").alias("k"))).distinct()
    sets = cut_lineage(members_with_sets(docs, text_col, wanted, n))
    pairs = (
        met.join(sets, "k").join(sets.select(F.col("k").alias("pivot"), F.col("shingles").alias("_pivot_set")), "pivot")
        .select("k", "pivot", common_shingles("shingles", "_pivot_set").alias("c"), F.expr("octet_length(shingles) div 8").alias("na"), F.expr("octet_length(_pivot_set) div 8").alias("nb"))
        .select("k", "pivot", (1 - F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("far"), linked(F.col("c"), F.col("na"), F.col("nb")).alias("links"))
    )
    pairs = cut_lineage(pairs)
    links = pairs.where("links").select(F.col("k").alias("a"), F.col("pivot").alias("b"))
    labels = components(links).withColumnRenamed("node", "k")
    placed = pairs.join(labels, "k", "left").select(F.col("pivot").alias("region"), "k", F.coalesce("component", "k").alias("component"), "far")
    # the pivot itself needs no row: it was compared with every member
    rest = cut_lineage(still_open(placed).join(sets, "k"))
    return cut_lineage(links.unionByName(recurse(rest)))  # so that no task runs two Python steps at once


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """One row per row of docs: id, n_shingles long, component_id (smallest id reachable by links)."""
    docs = docs.select(id_col, text_col)
    sketched = cut_lineage(sketch(docs, id_col, text_col, frequency_levels(docs, text_col, n), n))
    labels = components(near_links(docs, text_col, sketched, n)).select(F.col("node").alias("k"), "component")
    placed = sketched.drop("prefix", "signature").join(labels, "k", "left").withColumn("component", F.coalesce("component", "k"))
    placed = cut_lineage(placed)
    least = cut_lineage(placed.where("n_shingles > 0").groupBy("component").agg(F.min(id_col).alias("component_id")))
    joined = placed.join(least, "component", "left")
    return joined.select(id_col, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
