"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus' frequent words are compiled, with their token ids as outputs, into an automaton that shares suffixes
and is minimal; its arrays are one file in the shared folder, which Spark hands to the executors and tasks map
into memory. Words outside the lexicon are merged exactly by rank. The lexicon only saves work: its size changes
no result.

Edge cases: null and empty texts have no tokens; texts of any length are encoded whole; special-token strings in a
text become their ids, as the tokenizer's file says; repeated rows give equal results; an empty corpus has an
empty lexicon and an empty result; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posewright.llm.common import cut_lineage, ensure_checkpoint_dir, read
from posewright.llm.hashing import groups

LEXICON_WORDS = 150_000
MEMO_CHUNKS = 600_000
SLICE = 1_000_000
#: White space as the tokenizer's \s has it, and its pattern of words.
GAP = re.compile("[\t-\r \x85\xa0  -     　]+")
LONG_WORD = 200
PYTHON_ONLY_GAP = re.compile("[\x1c-\x1f]")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


class Merges:
    """The tokenizer's vocabulary and merge ranks; merges one word exactly."""

    def __init__(self, source: bytes) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.suffix = model.get("end_of_word_suffix") or ""
        self.bytes = byte_alphabet()
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: str) -> list[int]:
        """Ids of a word in lower case: always the lowest rank first, the leftmost of equal ones."""
        parts = [self.bytes[b] for b in word.encode()]
        if not parts:
            return []
        parts[-1] += self.suffix
        if len(parts) > LONG_WORD:
            parts = self.merge_long(parts)
            return [self.vocab[p] for p in parts if p in self.vocab]
        ranks = [self.ranks.get(p, 1 << 60) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = self.ranks.get((parts[i], parts[i + 1]), 1 << 60)
            if i:
                ranks[i - 1] = self.ranks.get((parts[i - 1], parts[i]), 1 << 60)
        return [self.vocab[p] for p in parts if p in self.vocab]


    def merge_long(self, parts: list[str]) -> list[str]:
        """The same merges over a linked list and a heap: n log n for a word of n bytes."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j == len(parts) or self.ranks.get((parts[i], parts[j])) != rank:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < len(parts) and (r := self.ranks.get((parts[x], parts[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x))
        return [p for p in parts if p]


def chunks_of(text: str) -> list[str]:
    """What stands between white space, in the tokenizer's normal form."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # no final sigma by context
    return [c for c in GAP.split(text) if c] if PYTHON_ONLY_GAP.search(text) else text.split()


def words_of_chunk(chunk: str) -> list[str]:
    if chunk.isalpha():
        return [chunk]
    if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    return WORDS.findall(chunk)


def slices_of(text: str) -> Iterator[str]:
    """A text of more than SLICE characters in pieces that end before a space: no chunk crosses one."""
    at = 0
    while len(text) - at > SLICE and (cut := text.find(" ", at + SLICE)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


class Transducer:
    """Minimal acyclic automaton over UTF-8 bytes. A word's output is its ordinal, summed along its arcs; the
    ordinal finds the word's ids. Arcs are sorted by state and label, so look-ups of many words go in step."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray, root: int, starts: np.ndarray, ids: np.ndarray) -> None:
        self.keys, self.targets, self.skips, self.final, self.root, self.starts, self.ids = keys, targets, skips, final, root, starts, ids

    @classmethod
    def compile(cls, entries: Iterable[tuple[bytes, list[int]]]) -> Transducer:
        """entries: distinct words with their ids, sorted by word."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        counts: list[int] = []

        def settle(node: list) -> int:
            """Number of the state equal to the node; states with equal futures are one."""
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                counts.append(node[0] + sum(counts[t] for _, t in node[1]))
            return register[key]

        path: list[list] = [[False, []]]
        labels: list[int] = []
        before, starts, ids = b"", [0], []

        def fold(depth: int) -> None:
            while len(path) - 1 > depth:
                number = settle(path.pop())
                path[-1][1].append((labels.pop(), number))

        for word, out in entries:
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            fold(same)
            for b in word[same:]:
                labels.append(b)
                path.append([False, []])
            path[-1][0] = True
            before = word
            ids += out
            starts.append(len(ids))
        fold(0)
        root = settle(path[0])
        keys, targets, skips = [], [], []
        for s, (is_final, arcs) in enumerate(states):
            passed = int(is_final)
            for label, t in arcs:
                keys.append(s * 256 + label)
                targets.append(t)
                skips.append(passed)
                passed += counts[t]
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), np.array([f for f, _ in states], np.uint8), root, np.array(starts, np.int32), np.array(ids, np.uint32))

    def dump(self) -> bytes:
        arrays = (self.keys, self.starts, self.ids, self.targets, self.skips, self.final)
        return np.array([self.root, *map(len, arrays)], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def map(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        root, *sizes = np.frombuffer(data, np.int64, 7).tolist()
        at, arrays = 56, []
        for n, kind in zip(sizes, (np.int64, np.int32, np.uint32, np.int32, np.int32, np.uint8)):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        keys, starts, ids, targets, skips, final = arrays
        return cls(keys, targets, skips, final, root, starts, ids)

    def look_up(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of each word as little-endian unsigned 32-bit integers; None where the lexicon lacks it."""
        if not len(self.keys) or not words:
            return [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat, begins = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum(lengths)[:-1]))
        state, ordinal, live = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        for step in range(int(lengths.max())):
            live = live[lengths[live] > step]
            key = state[live] * 256 + flat[begins[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            state[live[~found]] = -1
            live, arc = live[found], arc[found]
            state[live] = self.targets[arc]
            ordinal[live] += self.skips[arc]
        good = (state >= 0) & (self.final[np.maximum(state, 0)] == 1) & (lengths > 0)
        ordinal[~good] = 0
        low, high, ids = (4 * self.starts[ordinal]).tolist(), (4 * self.starts[ordinal + 1]).tolist(), self.ids.astype("<u4").tobytes()
        return [ids[a:z] if g else None for g, a, z in zip(good.tolist(), low, high)]


@lru_cache(1)
def merges_from(source: bytes) -> Merges:
    return Merges(source)


def source_of(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def transducer_at(path: str) -> Transducer:
    return Transducer.map(path)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, in the tokenizer's normal form; counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for chunk, n in seen.items():
                for w in words_of_chunk(chunk):
                    words[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for piece in slices_of(text.as_py() or ""):
                    seen.update(chunks_of(piece))
                if len(seen) > 600_000:
                    yield flush()
        yield flush()

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def share_file(spark: SparkSession, data: bytes, kind: str) -> str:
    """Writes bytes into the shared checkpoint folder and lets every executor fetch them; the file's name."""
    ensure_checkpoint_dir(spark)
    jvm, name = spark._jvm, f"{kind}-{uuid.uuid4().hex}"
    path = jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get(), name)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(data)
    stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def frequent_words(counts: DataFrame, most: int) -> list[str]:
    """The most frequent words, at most `most`: all down to the eighth of a power of two of n that still fits. Only a
    histogram and those words come to the driver."""
    counts = cut_lineage(counts.where("n > 1").withColumn("level", F.floor(8 * F.log2("n"))))
    room, cut = most, None
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        room -= row["count"]
        if room < 0:
            break
        cut = row["level"]
    return [] if cut is None else counts.where(F.col("level") >= cut).select("word").toArrow()["word"].to_pylist()


def build_lexicon(docs: DataFrame, path: str, n_words: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compiles the most frequent words, n_words at most; the name of the automaton's file for SparkFiles. The bound
    is on the driver's work alone: the counts are of the whole corpus, and rarer words are merged."""
    words = sorted(w.encode() for w in frequent_words(count_words(docs, text_col), n_words))
    merges = merges_from(source_of(path))
    return share_file(docs.sparkSession, Transducer.compile((w, merges.merge(w.decode())) for w in words).dump(), "lexicon")


class Encoder:
    """Encodes texts in a task. Distinct chunks are looked up once; the memo is emptied when it is full."""

    def __init__(self, merges: Merges, transducer: Transducer) -> None:
        self.merges, self.transducer, self.memo = merges, transducer, {}

    def learn(self, chunks: set[str]) -> None:
        """Puts chunks into the memo: words from the transducer, the others merged."""
        if len(self.memo) + len(chunks) > MEMO_CHUNKS:
            self.memo.clear()
        new = [c for c in chunks if c not in self.memo]
        split = [words_of_chunk(c) for c in new]
        words = list({w for ws in split for w in ws})
        found = {w: array("I", self.merges.merge(w)).tobytes() if ids is None else ids for w, ids in zip(words, self.transducer.look_up([w.encode("utf-8", "replace") for w in words]))}
        for c, ws in zip(new, split):
            self.memo[c] = found[ws[0]] if len(ws) == 1 else b"".join([found[w] for w in ws])

    def parts(self, text: str) -> Iterator[list[str] | int]:
        """Chunks of a text, and the ids of special tokens between them."""
        pattern = self.merges.special_pattern
        for k, part in enumerate(pattern.split(text) if pattern and "<" in text else [text]):
            if k % 2:
                yield self.merges.special[part]
            else:
                yield from map(chunks_of, slices_of(part))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for begin, end in groups(texts):
            distinct: set[str] = set()
            for text in texts[begin:end]:
                for part in self.parts(text):
                    if not isinstance(part, int):
                        distinct.update(part)
            self.learn(distinct)
            memo = self.memo
            for text in texts[begin:end]:
                out.append(b"".join([array("I", [part]).tobytes() if isinstance(part, int) else b"".join(map(memo.__getitem__, part)) for part in self.parts(text)]))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The tokens' own strings, joined by a space, as a tokenizer without a decoder does."""
        return " ".join(map(self.merges.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (little-endian unsigned 32-bit integers), decoded text."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.sparkSession.sparkContext.broadcast(source_of(path))  # the tokenizer's file: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges_from(source.value), transducer_at(SparkFiles.get(lexicon)))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in groups(texts):  # small pieces: decoded text is large
                part, ids = batch.slice(begin, end - begin), encoder.encode_all(texts[begin:end])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([encoder.decode(i) for i in ids], pa.string())], names=[id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, docs = public_tokenizers.path("word_bpe_49k.json"), read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path, build_lexicon(docs, path))
    return coded.select("doc_id", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
