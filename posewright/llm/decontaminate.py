"""Benchmark decontamination under edit distance.

Texts are lower-cased and cut into words of letters and digits. Characters of scripts without spaces (Han, kana,
Thai, Khmer and others) and symbols outside ASCII are words of their own; punctuation of any script separates. The CGK embedding walks over a word sequence: at
every step it emits the current word and a hash of word and step decides whether to move on, so that a few edits
change few emitted words: edit distance becomes Hamming distance. Item-sized windows of the documents and all
windows of the items are embedded by the same REPEATS walks; a key is the emitted words at SAMPLES sampled steps.
Windows whose key equals an item's are verified by the exact edit distance between the item and the best
matching substring around the window.

Windows start at every STRIDE-th word of a document and at every word of an item, so any copy of an item holds an
aligned window. A copy without edits is always found. Of copies within the limit, with one word in ten or in seven
replaced, inserted or dropped, nine in ten and more are found at every size (tests/llm/test_decontaminate.py measures it).
Windows are of the item's size up to the last of SIZES; an item of more words has that many more of them.

The benchmark is the stated query set. It is handled in blocks of at most BLOCK_WORDS words, so what is broadcast
is bounded whatever its size; documents are never shuffled.

Items of fewer than MIN_WORDS words match where exactly their words stand in a row in a document, at distance 0:
the hashes of as many words in a row are looked up and every hit is compared. An item of one common word
thereby matches every document that holds it.

Edge cases: null and empty texts and items, and items without a word, match nothing; repeated rows give equal
results; an empty table of documents or items gives an empty result, and drops nothing; documents of any length are
scanned whole; only the id and text columns are read, and dropping returns all columns as they are, so others may have
any name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posewright.llm.common import read
from posewright.llm.hashing import groups, mixed, word_hashes

REPEATS = 16
SAMPLES = 5
MIN_WORDS = 5
MAX_DISTANCE = 0.2  # of the item's length in characters
BLOCK_WORDS = 200_000
TABLE_BITS = 26
#: Window sizes in words: each 1.3 times the one before. Longer items have many windows of the last size: a walk over
#: more words loses its place among too many edits.
SIZES = [4, 5, 6, 8, 10, 13, 17, 22, 28, 36, 47]
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


#: First and last characters of the blocks of scripts that are written without spaces between words.
UNSPACED = ["\u0e00\u0eff", "\u0f00\u0fff", "\u1000\u109f", "\u1780\u17ff", "\u1950\u19ff", "\u1a20\u1aaf", "\u2e80\u2fdf", "\u3005\u3007", "\u3021\u3029", "\u3031\u3035", "\u3038\u303c", "\u3040\u312f", "\u31a0\u31bf", "\u31f0\u31ff", "\u3400\u4dbf", "\u4e00\u9fff", "\ua9e0\ua9ff", "\uaa60\uaadf", "\uf900\ufaff", "\uff66\uff9f", "\U0001b000\U0001b16f", "\U00020000\U0003ffff"]
SEPARATES, ALONE = 1, 2


@lru_cache(1)
def character_kinds() -> np.ndarray:
    """SEPARATES for punctuation, spaces and controls outside ASCII, ALONE for symbols and unspaced scripts, else 0."""
    kinds = np.zeros(0x110000, np.uint8)
    for first, last in UNSPACED:
        kinds[ord(first) : ord(last) + 1] = ALONE
    for c in range(0x80, 0x20000):
        category = unicodedata.category(chr(c))
        if category[0] in "PZ" or category == "Cc":
            kinds[c] = SEPARATES
        elif category[0] == "S":
            kinds[c] = ALONE
    return kinds


def spaced(text: str | None) -> str:
    """The text in lower case, its words apart."""
    text = (text or "").lower()
    if text.isascii():
        return text
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = character_kinds()[chars]
    if not kinds.any():
        return text
    chars = np.where(kinds == SEPARATES, np.uint32(32), chars)
    alone = np.flatnonzero(kinds == ALONE)
    return np.insert(chars, np.concatenate([alone, alone + 1]), np.uint32(32)).astype("<u4").tobytes().decode("utf-32-le")


class Item(NamedTuple):
    item_id: object
    text: bytes


class Words:
    """Hashed words of some texts in one sequence; each text is followed by a zero, where walks stay."""

    def __init__(self, texts: list[str | None]) -> None:
        parts = [spaced(t).encode("utf-8", "replace") for t in texts]
        self.data = b"\n".join(parts) + b"\n"
        starts, ends, hashes = word_hashes(self.data, IS_WORD)
        bounds = np.cumsum([len(p) + 1 for p in parts])
        text_of = np.searchsorted(bounds, starts, "right")
        place = np.arange(len(starts)) + text_of
        total = len(starts) + len(parts)
        self.hash = np.zeros(total, np.uint64)
        self.hash[place] = hashes
        self.start, self.end = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.start[place], self.end[place] = starts, ends
        counts = np.bincount(text_of, minlength=len(parts))
        self.first = np.cumsum(counts + 1) - counts - 1
        self.counts = counts

    def starts_at(self, stride: int) -> np.ndarray:
        """Positions of every stride-th word of every text."""
        per = -(-self.counts // stride)
        offset = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        return np.repeat(self.first, per) + offset * stride

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of n words in a row of one text and a hash of each such run."""
        at = np.arange(max(0, len(self.hash) - n + 1))
        key, whole = np.full(len(at), np.uint64(n)), np.ones(len(at), bool)
        for j in range(n):
            part = self.hash[j : j + len(at)]
            key, whole = mixed(key ^ part), whole & (part != 0)
        return at[whole], key[whole]

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1

    def joined(self, text: int, begin: int, end: int) -> bytes:
        """Words of a text from begin to end (positions in the sequence, cut to the text), a space between them."""
        low = int(self.first[text])
        begin, end = max(begin, low), min(end, low + int(self.counts[text]))
        return b" ".join(self.data[self.start[i] : self.end[i]] for i in range(begin, end))


def band_of(n_words: int) -> int:
    """The stride of the document windows that look for items of so many words."""
    return 2 if n_words < 16 else 4


def size_of(n_words: int) -> int:
    """The window size of an item: the largest of which any copy holds one that starts at a multiple of the stride."""
    return max([s for s in SIZES if s + band_of(n_words) - 1 <= n_words], default=SIZES[0])


@lru_cache(256)
def sampled_steps(repeat: int, stride: int, size: int) -> tuple[list[int], list[int]]:
    """Steps of the first two samples, common to all sizes of a stride, and of the others, over the item's size."""
    least = SIZES[0] if stride == 2 else 13
    cut = max(2, int(0.8 * least))
    first = np.random.default_rng([repeat, stride]).choice(cut, 2, replace=False)
    span = max(cut + SAMPLES - 2, int(1.6 * size))
    rest = cut + np.random.default_rng([repeat, stride, size]).choice(span - cut, SAMPLES - 2, replace=False)
    return sorted(map(int, first)), sorted(map(int, rest))


def walk(hashes: np.ndarray, moves: np.ndarray, at: np.ndarray, key: np.ndarray, step: int, until: int) -> tuple[np.ndarray, np.ndarray]:
    """Walks from `step` to `until` and adds the word there to the key."""
    for j in range(step, until):
        at = at + ((moves[at] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
    return at, mixed(key ^ hashes[at])


def moves_of(hashes: np.ndarray, repeat: int) -> np.ndarray:
    """Random bits of each word for one walk; a zero never moves."""
    return np.where(hashes == 0, np.uint64(0), mixed(hashes * np.uint64(2 * repeat + 3) + np.uint64(repeat)))


class Index:
    """Keys of a block of items, sorted, and a bit table of all key prefixes for early rejection."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        words = Words([i.text.decode() for i in items])
        self.lengths = words.counts
        self.table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
        groups: dict[tuple[int, int], list[int]] = {}
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, n in enumerate(words.counts.tolist()):
            if n >= MIN_WORDS:
                groups.setdefault((band_of(n), size_of(n)), []).append(k)
        for n in range(1, MIN_WORDS):
            members = np.flatnonzero(words.counts == n)
            if len(members):
                at, key = words.runs(n)
                own = np.isin(at, words.first[members])  # the words of such an item are its only run
                at, key = at[own], key[own]
                order = np.argsort(key, kind="stable")
                self.short[n] = key[order], words.text_of(at[order])
        self.sizes = {stride: sorted(size for s, size in groups if s == stride) for stride in {s for s, _ in groups}}
        keys, owners, offsets = [], [], []
        for (stride, size), members in groups.items():
            who = np.repeat(members, [max(1, int(words.counts[k]) - size + 1) for k in members])
            offset = np.concatenate([np.arange(max(1, int(words.counts[k]) - size + 1)) for k in members])
            begin = words.first[who] + offset
            for repeat in range(REPEATS):
                moves, (first, rest) = moves_of(words.hash, repeat), sampled_steps(repeat, stride, size)
                at, key, step = begin, np.full(len(begin), self.seed(repeat, stride), np.uint64), 0
                for until in first:
                    at, key = walk(words.hash, moves, at, key, step, until)
                    step = until
                    self.add(key)
                key = key ^ np.uint64(size * 977)
                for until in rest:
                    at, key = walk(words.hash, moves, at, key, step, until)
                    step = until
                    self.add(key)
                keys.append(key)
                owners.append(who)
                offsets.append(offset)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys = flat[order]
        self.owner = (np.concatenate(owners) if keys else np.zeros(0, np.int64))[order].astype(np.int32)
        self.offset = (np.concatenate(offsets) if keys else np.zeros(0, np.int64))[order].astype(np.int32)

    @staticmethod
    def seed(repeat: int, stride: int) -> np.uint64:
        return np.uint64(repeat * 1_000_003 + stride * 7_919 + 1)

    def add(self, key: np.ndarray) -> None:
        slot = key >> np.uint64(64 - TABLE_BITS)
        np.bitwise_or.at(self.table, (slot >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8)))

    def may_hold(self, key: np.ndarray) -> np.ndarray:
        slot = key >> np.uint64(64 - TABLE_BITS)
        return (self.table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1

    def candidates(self, words: Words) -> np.ndarray:
        """Distinct rows (text, item, position where the item would begin)."""
        found = []
        for stride, sizes in self.sizes.items():
            begin = words.starts_at(stride)
            for repeat in range(REPEATS):
                moves = moves_of(words.hash, repeat)
                start, at, key, step = begin, begin, np.full(len(begin), self.seed(repeat, stride), np.uint64), 0
                for until in sampled_steps(repeat, stride, sizes[0])[0]:
                    at, key = walk(words.hash, moves, at, key, step, until)
                    step = until
                    keep = self.may_hold(key)
                    start, at, key = start[keep], at[keep], key[keep]
                for size in sizes:
                    own_start, own_at, own_key, own_step = start, at, key ^ np.uint64(size * 977), step
                    for until in sampled_steps(repeat, stride, size)[1]:
                        own_at, own_key = walk(words.hash, moves, own_at, own_key, own_step, until)
                        own_step = until
                        keep = self.may_hold(own_key)
                        own_start, own_at, own_key = own_start[keep], own_at[keep], own_key[keep]
                    low, high = np.searchsorted(self.keys, own_key, "left"), np.searchsorted(self.keys, own_key, "right")
                    n = high - low
                    hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    own_start = np.repeat(own_start, n)
                    found.append(np.column_stack([words.text_of(own_start), self.owner[hit], own_start - self.offset[hit]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def short_matches(self, words: Words) -> set[tuple[int, int]]:
        """(text, item) of the items of fewer than MIN_WORDS words that stand word by word in a text."""
        found: set[tuple[int, int]] = set()
        for n, (keys, owner) in self.short.items():
            at, key = words.runs(n)
            low = np.searchsorted(keys, key, "left")
            hit = keys[np.minimum(low, len(keys) - 1)] == key
            at, low, high = at[hit], low[hit], np.searchsorted(keys, key[hit], "right")
            for text, begin, a, z in zip(words.text_of(at).tolist(), at.tolist(), low.tolist(), high.tolist()):
                for item in owner[a:z].tolist():
                    if (text, item) not in found and words.joined(text, begin, begin + n) == self.items[item].text:
                        found.add((text, item))
        return found

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(text, item, edit distance) of every verified match, the least distance seen of each pair."""
        words, best, last = Words(texts), {}, {}
        for text, item, begin in self.candidates(words).tolist():
            n, length = int(self.lengths[item]), len(self.items[item].text)
            limit = int(MAX_DISTANCE * length)
            # windows of one copy name almost the same place; in order, one of each stretch of `near` words is verified
            room, near = max(4, n // 4), n // 16
            seen = last.get((text, item))
            if best.get((text, item), limit + 1) == 0 or near and seen is not None and begin - seen < near:
                continue
            last[text, item] = begin
            distance = least_distance(self.items[item].text, words.joined(text, begin - room, begin + n + room + near), limit)
            if distance is not None:
                best[text, item] = min(distance, best.get((text, item), distance))
        best.update(dict.fromkeys(self.short_matches(words), 0))
        return [(t, i, d) for (t, i), d in best.items()]


def least_distance(pattern: bytes, text: bytes, limit: int) -> int | None:
    """Least edit distance between the pattern and any substring of the text, by bit-parallel columns; None over the limit."""
    m = len(pattern)
    if not m or pattern in text:
        return 0 if m else None
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return best if best <= limit else None


def normal(text: str | None) -> bytes:
    words = Words([text])
    return words.joined(0, 0, int(words.counts[0]))


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[list[Item]]:
    """Items in blocks of at most BLOCK_WORDS words, or one item; one block at a time is on the driver."""
    rows = benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).orderBy(item_col, text_col)
    block, size = [], 0
    for row in rows.toLocalIterator():
        item = Item(row[0], normal(row[1]))
        n = item.text.count(b" ") + 1
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(item)
        size += n
    if block:
        yield block


@lru_cache(2)
def index_of(items: tuple[Item, ...]) -> Index:
    return Index(list(items))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document id and item that it holds: id, item, distance int, item_chars int."""
    spark, out = docs.sparkSession, None
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType), T.StructField("distance", T.IntegerType()), T.StructField("item_chars", T.IntegerType())])
    arrow_item = pa.int64() if isinstance(benchmark.schema[item_col].dataType, T.LongType) else None
    for block in blocks(benchmark, item_col):
        shared = spark.sparkContext.broadcast(tuple(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for begin, end in groups(texts):
                    hits = index.matches(texts[begin:end])
                    if hits:
                        items = [index.items[i] for _, i, _ in hits]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([begin + t for t, _, _ in hits])), pa.array([i.item_id for i in items], arrow_item), pa.array([d for *_, d in hits], pa.int32()), pa.array([len(i.text) for i in items], pa.int32())],
                            names=[id_col, item_col, "distance", "item_chars"],
                        )

        found = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy(id_col, item_col).agg(F.min("distance").alias("distance"), F.max("item_chars").alias("item_chars"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that hold an item; one pass for each block of the benchmark, no shuffle."""
    at = docs.columns.index(text_col)
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                dirty = {begin + t for begin, end in groups(texts) for t, _, _ in index.matches(texts[begin:end])}
                yield batch.filter(pa.array([k not in dirty for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
