"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary match of a text; dynamic programming keeps, for each end
position, the best score and the number of pieces on its path, never the pieces. Among equal scores the match that
starts first wins, as in the unigram tokenizer, which tries starts in order and replaces a path only for a better
one. A character without a piece of its own scores less than any piece by 10 and counts its UTF-8 bytes (byte
fallback). A space is written as U+2581, one is put before the text, and no piece has U+2581 behind another
character, so texts are cut there and equal chunks are searched once. Scores are summed exactly.

No unigram vocabulary is given. The query searches the pieces of piece_bpe_32k.model, a BPE model whose scores are
merge ranks, as if the ranks were unigram scores: n_tokens is the count of that search, not of the tokenizer whose
file it is.

Edge cases: null and empty texts have 0 tokens and score 0; texts of any length are counted whole; repeated rows
give equal results; an empty table gives an empty result; only the id and text columns are read, so other columns may
have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from posewright.llm.common import read

MEMO_CHUNKS = 250_000
SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def pieces_of(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the vocabulary file, without control, unknown and byte pieces and without those whose score
    is the placeholder -1e9: no best path holds them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > -1e8]


class Counter:
    """Counts the pieces of texts; equal chunks once, in a memo that is emptied when it is full."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - 10
        self.cut = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _ in pieces)
        self.memo: dict[str, tuple[int, float]] = {}

    def search(self, text: str) -> tuple[int, float]:
        """(number of pieces, score) of the best path over one text."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(text) if len(self.automaton) else ():
            ends[last + 1].append(match)  # longest first, so starts in order
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best, pieces = None, 0
            for length, value in ends[end]:
                total = score[end - length] + value
                if best is None or total > best:
                    best, pieces = total, count[end - length] + 1
            char = text[end - 1]
            if char not in self.singles:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, pieces = total, count[end - 1] + len(char.encode("utf-8", "surrogatepass"))
            score[end], count[end] = best, pieces
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = SPACE + text.replace(" ", SPACE)
        if not self.cut:
            return self.search(text)
        n, score, memo = 0, 0.0, self.memo
        for chunk in CHUNK.findall(text):
            found = memo.get(chunk)
            if found is None:
                if len(memo) >= MEMO_CHUNKS:
                    memo.clear()
                found = memo[chunk] = self.search(chunk)
            n += found[0]
            score += found[1]
        return n, score


@lru_cache(1)
def counter_of(pieces: tuple[tuple[str, float], ...]) -> Counter:
    return Counter(pieces)


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens long, best_score double."""
    kind = docs.schema[id_col].dataType.simpleString()
    vocabulary = docs.sparkSession.sparkContext.broadcast(tuple(pieces))  # of the vocabulary's fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary.value)
        for batch in batches:
            found = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=[id_col, "n_tokens", "best_score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, best_score double")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), pieces_of(public_tokenizers.path("piece_bpe_32k.model")))
