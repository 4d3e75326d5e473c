"""Removal of repeated substrings with suffix arrays over shards.

Every byte is removed that a string of LENGTH bytes covers which also starts anywhere else in the corpus.

1. Anchors. Each window of LENGTH bytes has an anchor: of its GRAM-byte strings the one with the least hash, the
   leftmost of equal ones. Equal windows have equal anchors at the same place, so windows whose anchor string is
   unique in the corpus cannot repeat, and repeated windows meet in the shard of their anchor string.
2. Shards. The windows of an anchor form one piece of text. A text that holds a piece twice or more, as periodic
   text does at each period, repeats there: it gives the bytes these pieces cover, and the piece once to be held
   against other texts. Equal pieces are kept once; of the others the parts are cut off that agree with no other piece
   even in whole steps of STEP bytes from the anchor.
3. Suffix arrays. A shard's pieces are sorted by induced sorting; where the permuted common prefix of a suffix with
   either neighbour has LENGTH bytes, its window repeats.
4. Anchor strings with more than HOT pieces would fill one shard. They get longer anchors, first one around
   every RUN windows, then whole windows, which Spark counts like any keys: what stands nowhere else is dropped, and
   what is equal throughout repeats. Such windows reach no suffix array.
5. The repeated windows are joined back to their texts, merged and cut out.

Texts, and the windows of hot anchors, are told apart by 64-bit hashes. Texts that occur twice or more as a whole are removed whole if
they have LENGTH bytes.

Edge cases: an empty table gives an empty result; only the id and text columns are read, so others may have any name; null and empty texts have no bytes and lose none; texts shorter than LENGTH are kept; repeated rows
count as occurrences of their own; texts of any length are handled in slices that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posewright.llm.common import bit_table, cut_lineage, in_bit_table, read
from posewright.llm.hashing import mixed, powers
from posewright.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 400
GRAM = 32
STEP = 50
HOT = 1000
RUN = 48
SALTS = 64
SHARD_BYTES = 1_000_000
SLICE = 1_500_000
PIECE_SCHEMA = "fp long, tk long, begin long, end long, rel int, data binary"
SPAN_SCHEMA = "tk long, begin long, end long"


def gram_hashes(data: bytes, n: int) -> np.ndarray:
    """Hash of the n bytes from each position on."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    sums, down = prefix_sums(data)
    return mixed((sums[n:] - sums[:-n]) * down[: len(data) - n + 1])


def prefix_sums(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sums by which (sums[z] - sums[a]) * down[a] is a hash of data[a:z]."""
    size = len(data) + 1
    up, down = powers(2_000_000 if size <= 2_000_000 else 1 << size.bit_length())
    sums = np.zeros(size, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def anchors(texts: list[bytes], length: int) -> Iterator[tuple]:
    """For some slices of texts at a time: (number of the text and offset of each slice, bounds of the slices in the
    data, data, and of each anchor its string's hash, its place, its first and its last window and a hash of its piece),
    places in the data."""
    wide = length - GRAM + 1
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def emit():
        data = b"".join(p for *_, p in parts)
        sums, down = prefix_sums(data)
        hashes = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
        key = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.concatenate([key, np.full(-len(key) % wide + wide, np.uint64(2**64 - 1))]).reshape(-1, wide)
        ahead = np.minimum.accumulate(padded, 1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[: len(key)], ahead[wide - 1 : wide - 1 + len(key)])
        begins = np.cumsum([0, *(len(p) for *_, p in parts)])
        starts = np.concatenate([np.arange(a, z - length + 1) for a, z in zip(begins[:-1], begins[1:])])
        at = (least[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        first, last = starts[new], starts[np.append(new[1:], len(at)) - 1]
        content = mixed(((sums[last + length] - sums[first]) * down[first]) ^ (at[new] - first).astype(np.uint64))
        return [(k, o) for k, o, _ in parts], begins, data, hashes[at[new]].astype(np.int64), at[new], first, last, content

    for k, text in enumerate(texts):
        for offset in range(0, len(text) - length + 1, SLICE):
            part = text[offset : offset + SLICE + length - 1]
            if parts and size + len(part) > SLICE:
                yield emit()
                parts, size = [], 0
            parts.append((k, offset, part))
            size += len(part)
    if parts:
        yield emit()


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """(fp, tk, pos, last): anchor string, text, first and last place of every anchor, those of a slice with equal pieces
    in one row, equal texts of a batch once. docs: (tk, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, texts = fresh(batch, seen)
            for where, begins, _, fp, at, _, _, content in anchors(texts, length):
                part = np.searchsorted(begins, at, "right") - 1
                number, offset = np.array(where, np.int64).T
                order = np.lexsort((content, part, fp))
                same = np.all([x[order[1:]] == x[order[:-1]] for x in (content, part, fp)], 0)
                new = np.flatnonzero(np.append(True, ~same))
                one, end = order[new], order[np.append(new[1:], len(order)) - 1]
                shift = offset[part[one]] - begins[part[one]]
                columns = (fp[one], keys[number[part[one]]], at[one] + shift, at[end] + shift)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fp", "tk", "pos", "last"])

    return docs.mapInArrow(run, "fp long, tk long, pos long, last long")


def fresh(batch: pa.RecordBatch, seen: set[int]) -> tuple[np.ndarray, list[bytes]]:
    """Keys and bytes of the batch's texts that this task has not had yet."""
    keys, texts = [], []
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        if key not in seen:
            seen.add(key)
            keys.append(key)
            texts.append(text)
    return np.array(keys, np.int64), texts


def pieces(docs: DataFrame, table: np.ndarray, length: int) -> DataFrame:
    """Piece of text of each anchor whose string's bit is set: fp, tk, begin and end in the text, anchor's place in the
    piece, bytes. Of equal pieces in a slice only the first is given; what all of them cover is given in rows without bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, texts = fresh(batch, seen)
            for where, begins, data, fp, at, first, last, _ in anchors(texts, length):
                keep = np.flatnonzero(in_bit_table(shared.value, fp))
                fp, first, end, rel = fp[keep], first[keep], last[keep] + length, (at[keep] - first[keep]).astype(np.int32)
                part = np.searchsorted(begins, first, "right") - 1
                number, offset = np.array(where, np.int64).T
                shift = offset[part] - begins[part]
                ones: dict[tuple, int] = {}
                of = np.array([ones.setdefault((k, r, data[a:z]), i) for i, (k, r, a, z) in enumerate(zip(part.tolist(), rel.tolist(), first.tolist(), end.tolist()))], np.int64)
                cut, one = [d for *_, d in ones], np.fromiter(ones.values(), np.int64, len(ones))
                yield piece_rows(fp[one], keys[number[part[one]]], first[one] + shift[one], end[one] + shift[one], rel[one], cut)
                twice = np.flatnonzero(np.bincount(of, minlength=len(of))[of] > 1)
                low, high = covered(first[twice], end[twice])
                owner = twice[low]
                yield piece_rows(fp[owner], keys[number[part[owner]]], first[owner] + shift[owner], high + shift[owner], rel[owner], None)

    return docs.mapInArrow(run, PIECE_SCHEMA)


def piece_rows(fp: np.ndarray, tk: np.ndarray, begin: np.ndarray, end: np.ndarray, rel: np.ndarray, data: list[bytes] | None) -> pa.RecordBatch:
    last = pa.nulls(len(fp), pa.binary()) if data is None else pa.array(data, pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in (fp, tk, begin, end, rel)), last], names=["fp", "tk", "begin", "end", "rel", "data"])


def covered(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the union of intervals by begin: the number of the first interval of each, and its end. Intervals that
    only touch stay apart, as one text ends where the next begins."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, begin[1:] >= reach[:-1]))
    return new, reach[np.append(new[1:], len(end)) - 1]


def trimmed(fp: np.ndarray, rel: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): how many bytes on either side of its anchor a piece can share with another piece of the same
    anchor string, found in whole steps of STEP bytes by the hashes of ever longer sides."""
    flat = b"".join(data)
    sums, down = prefix_sums(flat)
    ends = np.cumsum([len(d) for d in data])
    begins = ends - [len(d) for d in data]
    anchor = begins + rel
    out = []
    for sign in (-1, 1):
        reach = np.zeros(len(data), np.int64)
        active, j = np.arange(len(data)), 1
        while len(active):
            a = np.minimum(anchor[active], anchor[active] + sign * STEP * j)
            z = np.maximum(anchor[active], anchor[active] + sign * STEP * j)
            inside = (a >= begins[active]) & (z <= ends[active])
            active, a, z = active[inside], a[inside], z[inside]
            side = mixed(((sums[z] - sums[a]) * down[a]) ^ mixed(fp[active].astype(np.uint64)))
            _, back, count = np.unique(side, return_inverse=True, return_counts=True)
            active = active[count[back] > 1]
            reach[active] = j
            j += 1
        out.append((reach + 1) * STEP - 1)
    return out[0], out[1]


def repeated_in_shard(fp: np.ndarray, tk: np.ndarray, begin: np.ndarray, rel: np.ndarray, data: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(tk, begin, end) of the runs of bytes that repeated windows of a shard cover."""
    spans: list[tuple[int, int, int]] = []
    equal: dict[tuple, list[int]] = {}
    seen = set()
    for k, d in enumerate(data):
        if (place := (int(tk[k]), int(begin[k]))) not in seen:
            seen.add(place)
            equal.setdefault((int(fp[k]), int(rel[k]), d), []).append(k)
    for members in equal.values():
        if len(members) > 1:
            spans += [(int(tk[k]), int(begin[k]), int(begin[k]) + len(data[k])) for k in members]
    single = np.array([m[0] for m in equal.values()], np.int64)
    many = np.array([len(m) > 1 for m in equal.values()], bool)
    if len(single) < 2:
        return spans
    left, right = trimmed(fp[single], rel[single], [data[k] for k in single])
    cut, owner = [], []
    for k, a, z, known in zip(single.tolist(), left.tolist(), right.tolist(), many.tolist()):
        low, high = max(0, int(rel[k]) - a), min(len(data[k]), int(rel[k]) + z)
        if high - low >= length:
            cut.append(data[k][low:high])
            owner.append((k, low, known))
    if len(cut) < 2 or all(known for *_, known in owner):
        return spans
    # symbol 0 ends every piece, so no window runs over into the next
    flat = np.frombuffer(b"".join(cut), np.uint8)
    lengths = np.array([len(c) for c in cut])
    t = np.zeros(len(flat) + len(cut), np.int64)
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(len(t), bool)
    inside[ends] = False
    t[inside] = flat.astype(np.int64) + 1
    sa = suffix_array(t)
    shared = permuted_common_prefixes(t, sa)[sa] >= length
    repeats = np.zeros(len(t), bool)
    repeats[sa] = shared | np.append(shared[1:], False)
    for (k, low, known), end, n in zip(owner, ends.tolist(), lengths.tolist()):
        if known:
            continue
        flags = repeats[end - n : end - length + 1]
        edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
        base = int(begin[k]) + low
        spans += [(int(tk[k]), base + a, base + z - 1 + length) for a, z in zip(edges[0::2].tolist(), edges[1::2].tolist())]
    return spans


def runs_of_windows(pieces: DataFrame, length: int) -> DataFrame:
    """(key, tk, begin, hashes): the windows of each piece in runs of RUN, by how many bytes they have before the anchor.
    key: hash of the string around the anchor that all windows of such a run have in common; begin: place of the first;
    hashes: 8 bytes for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, tk, begin, rel = (batch.column(k).to_numpy() for k in range(4))
            for low in range(0, batch.num_rows, 2000):
                data = batch.column(4).slice(low, 2000).to_pylist()
                sizes = np.array([len(d) for d in data])
                starts = np.cumsum(sizes) - sizes
                flat = b"".join(data)
                sums, down = prefix_sums(flat)
                hashes = gram_hashes(flat, length)
                n = sizes - length + 1
                k = np.repeat(np.arange(len(data)), n)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                before = rel[low + k] - within
                first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (before[1:] // RUN != before[:-1] // RUN)))
                ends = np.append(first[1:], len(k))
                own, least = k[first], before[first] // RUN * RUN
                anchor = starts[own] + rel[low + own]
                # the run's common string; a piece that lacks part of the run still holds all of it
                x, z = anchor - least, anchor + length - np.minimum(least + RUN - 1, length - GRAM)
                key = mixed(((sums[z] - sums[x]) * down[x]) ^ mixed(fp[low + own].astype(np.uint64) + least.astype(np.uint64)))
                every = hashes[starts[k] + within].tobytes()
                out = [every[8 * a : 8 * b] for a, b in zip(first.tolist(), ends.tolist())]
                # where a piece begins or ends inside a run, only equal parts of the run count as equal: their place is in the key
                shift = before[first] - least
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(tk[low + own]), pa.array(begin[low + own] + within[first]), pa.array(shift.astype(np.int32)), pa.array(out, pa.binary())], names=["key", "tk", "begin", "shift", "hashes"])

    return pieces.select("fp", "tk", "begin", "rel", "data").mapInArrow(run, "key long, tk long, begin long, shift int, hashes binary")


def hot_spans(hot: DataFrame, length: int) -> DataFrame:
    """Spans of the windows of hot anchors that stand at two places or more, found by ever longer anchors: runs of
    windows with a common string that stands nowhere else can't repeat, runs that are all equal do, and the windows of
    the others are counted each. Hot keys are only counted and joined, so Spark can combine and split their rows."""
    once = hot.dropDuplicates(["fp", "tk", "begin"])  # each task with a copy of a text has sent its pieces
    runs = cut_lineage(runs_of_windows(once, length))
    place, content = F.struct("tk", F.col("begin") + F.col("shift")), F.xxhash64("hashes", "shift")
    keys = runs.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.min(content).alias("low"), F.max(content).alias("high")).where("a <> z")
    kept = cut_lineage(runs.join(cut_lineage(keys.select("key", (F.col("low") == F.col("high")).alias("equal"))), "key"))
    equal = kept.where("equal").select("tk", "begin", (F.col("begin") + F.octet_length("hashes") / 8 + (length - 1)).cast("long").alias("end"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2).to_pylist()
            counts = np.array([len(h) // 8 for h in parts], np.int64)
            if len(counts):
                k = np.repeat(np.arange(len(counts)), counts)
                within = np.arange(len(k)) - np.repeat(np.cumsum(counts) - counts, counts)
                columns = (np.frombuffer(b"".join(parts), np.int64), batch.column(0).to_numpy()[k], batch.column(1).to_numpy()[k], within.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["window", "tk", "begin", "at"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tk, begin, mask = (batch.column(k).to_numpy() for k in range(3))
            edges = np.diff((mask[:, None] >> np.arange(RUN)) & 1, prepend=0, append=0)
            row, first = np.nonzero(edges == 1)
            last = np.nonzero(edges == -1)[1] - 1
            yield pa.RecordBatch.from_arrays([pa.array(tk[row]), pa.array(begin[row] + first), pa.array(begin[row] + last + length)], names=["tk", "begin", "end"])

    windows = kept.where("not equal").select("tk", "begin", "hashes").mapInArrow(single, "window long, tk long, begin long, at int")
    # rows of one window are dealt to SALTS groups; those of a group with two places repeat, and of each group one row
    # more is held against the other groups' rows, SALTS of a window at most
    here = F.struct("tk", F.col("begin") + F.col("at"))
    group = Window.partitionBy("window", "salt")
    dealt = windows.withColumn("salt", F.pmod(F.xxhash64("tk", "begin"), F.lit(SALTS))).withColumns({"low": F.min(here).over(group), "high": F.max(here).over(group), "i": F.row_number().over(group.orderBy("tk", "begin", "at"))})
    whole = Window.partitionBy("window")
    firsts = dealt.where("i = 1").withColumns({"low": F.min("low").over(whole), "high": F.max("high").over(whole)})
    repeated = dealt.where("i > 1").unionByName(firsts).where("low <> high")
    marked = repeated.groupBy("tk", "begin").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    return equal.unionByName(marked.mapInArrow(spans, SPAN_SCHEMA))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tk, begin, end): bytes of the texts that repeated windows cover, spans may overlap. docs: (tk, text), texts not null."""
    whole = docs.groupBy("tk").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("size")).where(f"n > 1 and size >= {length}")
    copies = whole.select("tk", F.lit(0).cast("long").alias("begin"), F.col("size").cast("long").alias("end"))
    long = docs.where(F.octet_length("text") >= length)
    low, high = F.min(F.struct("tk", "pos")), F.max(F.struct("tk", F.col("last").alias("pos")))
    counted = occurrences(long, length).groupBy("fp").agg(low.alias("low"), high.alias("high"), F.count(F.lit(1)).alias("n"))
    strings = cut_lineage(counted.where("low <> high").select("fp", "n"))
    found = cut_lineage(pieces(long, bit_table(strings, "fp"), length).join(strings, "fp"))
    sizes = strings.agg(F.sum(F.when(F.col("n") <= HOT, F.col("n"))).alias("cold"), F.sum(F.when(F.col("n") > HOT, F.col("n"))).alias("hot")).first()
    n_shards = max(1, (sizes["cold"] or 0) * 600 // SHARD_BYTES)

    def run(table: pa.Table) -> pa.Table:
        fp, tk, begin, rel = (table[c].to_numpy() for c in ("fp", "tk", "begin", "rel"))
        rows = repeated_in_shard(fp, tk, begin, rel, table["data"].to_pylist(), length)
        return pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("tk", "begin", "end"))})

    inside = found.where("data is null").select("tk", "begin", "end")
    cold = found.where("data is not null").where(F.col("n") <= HOT).withColumn("_shard", F.pmod(F.xxhash64("fp"), F.lit(n_shards))).groupBy("_shard").applyInArrow(run, SPAN_SCHEMA)
    spans = copies.unionByName(inside).unionByName(cold)
    return spans.unionByName(hot_spans(found.where("data is not null").where(F.col("n") > HOT), length)) if sizes["hot"] else spans


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        z = min(z, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        elif a < z:
            out.append([a, z])
    return [(a, z) for a, z in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans (maximal removed runs), kept bytes."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    kind = docs.schema[id_col].dataType
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))
    spans = repeated_spans(texts.select("tk", "text"), length)
    by_text = spans.groupBy("tk").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # as many as a text has windows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            texts, spans = batch.column(1).cast(pa.binary()), batch.column(2)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
            begin, end = (spans.flatten().field(k).to_numpy() for k in (0, 1))
            for k, (low, high) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                text = texts[k].as_py()
                runs = merged(list(zip(begin[low:high].tolist(), end[low:high].tolist())), len(text))
                kept, at = [], 0
                for a, z in runs:
                    kept.append(text[at:a])
                    at = z
                kept.append(text[at:])
                for column, value in zip(rows, (len(text), sum(z - a for a, z in runs), len(runs), b"".join(kept))):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(rows, types))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return texts.join(by_text, "tk", "left").select(id_col, "text", "spans").mapInArrow(run, schema)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
