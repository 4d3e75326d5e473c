import hashlib
import random
import struct
import time

import public_tokenizers
import pytest

from posewright.llm import bpe, token_counts
from posewright.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = [
    "", " ", "a", "Don't we'll they'RE 'S x's", "<|endoftext|> a<|startoftext|>b <|endoftext", "ΟΔΟΣ ΣΑΣ Σ", "İstanbul ß ﬁ ŒUVRE", "é é Å 한국어 日本語",
    "a\x1cb\x85c\xa0d　e f​g﻿h", "12 345 ² ½ Ⅷ 五", "!!!??? ...---", "\U0001f600\U0001f468‍\U0001f469 ok", "x" * 3000, "tab\tnew\nline\r\n", "́alone  ́", "a\x00b",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encoder(words=()):
    m = bpe.merges_from(bpe.source_of(PATH))
    return bpe.Encoder(m, bpe.Transducer.compile((w, m.merge(w.decode())) for w in sorted(words)))


def test_encoder_equals_library(spark, sf, library):
    texts = ODD_TEXTS + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    own = encoder([b"the", b"then", b"of", b"x", "é".encode()])
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids, t[:80]
        assert own.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_query(spark, sf, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_slices(monkeypatch, library):
    monkeypatch.setattr(bpe, "SLICE", 7)
    text = "some longer words don't  break <|endoftext|> across slices, " * 3 + "x" * 30
    assert list(struct.unpack(f"<{len(encoder().encode(text)) // 4}I", encoder().encode(text))) == library.encode(text, add_special_tokens=False).ids


def test_transducer(tmp_path):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode() for _ in range(3000)})
    outs = {w: [rng.randrange(50000) for _ in range(rng.randint(0, 4))] for w in words}
    t = bpe.Transducer.compile((w, outs[w]) for w in words)
    file = tmp_path / "t"
    file.write_bytes(t.dump())
    for used in (t, bpe.Transducer.map(str(file))):
        for w, ids in zip(words, used.look_up(words)):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == outs[w]
        assert used.look_up([b"zz", b"", b"abcabcabcabc"]) == [None] * 3
    small = bpe.Transducer.compile((w, [1]) for w in sorted([b"taps", b"tops", b"maps", b"mops"]))
    assert len(small.final) == 5  # prefixes and suffixes are shared: the least number of states
    assert bpe.Transducer.compile([]).look_up([b"a"]) == [None]


def test_frequent_words(spark):
    counts = spark.createDataFrame([(f"w{k}", n) for k, n in enumerate([1, 1, 2, 2, 2, 9, 50, 50, 4000])], "word string, n long")
    assert sorted(bpe.frequent_words(counts, 4)) == ["w5", "w6", "w7", "w8"]
    assert sorted(bpe.frequent_words(counts, 6)) == ["w5", "w6", "w7", "w8"]
    assert sorted(bpe.frequent_words(counts, 2)) == ["w8"] and bpe.frequent_words(counts, 0) == []
    assert len(bpe.frequent_words(counts, 100)) == 7


def test_bpe_odd_rows(odd, empty):
    rows = bpe.encode(odd, PATH, bpe.build_lexicon(odd, PATH)).collect()
    assert len(rows) == odd.count() and sum(len(r["ids"]) == 0 for r in rows) == 4
    assert bpe.encode(empty, PATH, bpe.build_lexicon(empty, PATH)).count() == 0


def unigram_model():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        if piece.score <= -1e8:
            piece.type = 5  # unused
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


PIECES = tuple(token_counts.pieces_of(public_tokenizers.path("piece_bpe_32k.model")))


def test_counts_equal_library(spark, sf):
    """The library adds scores in single precision, which is exact for up to some 500 pieces; see test_counts_brute_force for longer texts."""
    library, own = unigram_model(), token_counts.Counter(PIECES)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        for i in range(0, len(t), 700):
            assert own.count(t[i : i + 700])[0] == len(library.encode(t[i : i + 700])), t[i : i + 700]
    for t in ("日本語 テスト", "ñandú", "a", "the", "a  b   c", "\U0001f600\U0001f600 x\n\ny", "\t\x01"):
        assert own.count(t)[0] == len(library.encode(t))


def brute(text, pieces, singles, unknown):
    text = "▁" + text.replace(" ", "▁")
    best = [(0.0, 0)] + [None] * len(text)
    for start in range(len(text)):
        for end in range(start + 1, min(len(text), start + 20) + 1):
            p = text[start:end]
            if p in pieces or (end == start + 1 and p not in singles):
                value, n = (pieces[p], 1) if p in pieces else (unknown, len(p.encode()))
                total = best[start][0] + value
                if best[end] is None or total > best[end][0]:
                    best[end] = (total, best[start][1] + n)
    return best[-1][1], best[-1][0]


def test_counts_brute_force():
    own, pieces = token_counts.Counter(PIECES), dict(PIECES)
    assert max(map(len, pieces)) <= 20
    for t in ("Hello  world\nnew line\t\x01 end", "   three", "ends ", "\n\n", "▁odd▁", "\U0001f600 smile", "x" * 400, "of.\nThe " * 300):
        assert own.count(t) == brute(t, pieces, own.singles, own.unknown)


def test_counts_ties_and_small_vocabularies():
    own = token_counts.Counter((("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)))
    assert own.count("ab") == (2, -3.0)  # equal scores: the match that starts first
    with_space_inside = token_counts.Counter((("a", -5.0), ("▁", -5.0), ("a▁a", -1.0)))
    assert with_space_inside.count("a a") == (2, -6.0)
    assert token_counts.Counter(()).count("é") == (5, -20.0)


def test_counts_query_and_odd_rows(spark, sf, odd, empty):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    own = token_counts.Counter(PIECES)
    for r in QUERIES["op10_token_counts"](spark, sf).collect():
        assert (r["n_tokens"], r["best_score"]) == own.count(docs[r["doc_id"]])
    rows = token_counts.count_tokens(odd, list(PIECES)).collect()
    assert len(rows) == odd.count() and sum(r["n_tokens"] == 0 for r in rows) == 3
    assert token_counts.count_tokens(empty, list(PIECES)).count() == 0


def test_counts_are_not_the_shipped_tokenizers():
    """The README and the docstring state this; the figures are of the first 400 documents of sf0.01, 700 characters each."""
    import pathlib

    import pyarrow.parquet as pq
    import sentencepiece

    shipped, own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), token_counts.Counter(PIECES)
    texts = [t[:700] for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()[:400]]
    pairs = [(len(shipped.encode(t)), own.count(t)[0]) for t in texts]
    figures = [f"{n:,}" for n in (*map(sum, zip(*pairs)), sum(a != b for a, b in pairs))]
    assert figures == ["103,552", "118,992", "400"]
    readme = (pathlib.Path(__file__).parents[2] / "README.md").read_text()
    assert all(f in readme for f in figures) and "not of the tokenizer whose" in token_counts.__doc__


def test_long_words_merge_alike_and_fast(library):
    merges = bpe.Merges(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    rng = random.Random(5)
    for n in (201, 400, 900):
        for letters in ("ab", "etaoin", "xyzé'"):
            word = "".join(rng.choice(letters) for _ in range(n))
            parts = [merges.bytes[b] for b in word.encode()]
            parts[-1] += merges.suffix
            long, merges_at = merges.merge(word), bpe.LONG_WORD
            bpe.LONG_WORD = 10**9
            try:
                assert merges.merge(word) == long
            finally:
                bpe.LONG_WORD = merges_at
    began = time.perf_counter()
    assert merges.merge("".join(rng.choice("etaoinshr") for _ in range(1_000_000)))
    assert time.perf_counter() - began < 60
