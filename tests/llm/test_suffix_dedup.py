import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from posewright.llm import suffix_array as sa
from posewright.llm import suffix_dedup as s
from posewright.llm.queries import QUERIES


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=50), st.integers(1, 3), st.booleans())
def test_suffix_array_brute_force(symbols, times, scans):
    symbols = symbols * times
    t = np.array(symbols, np.int64)
    buckets, sa.BUCKETS = sa.BUCKETS, sa.BUCKETS if scans else 0
    try:
        order = sa.suffix_array(t)
    finally:
        sa.BUCKETS = buckets
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    common = sa.permuted_common_prefixes(t, order)
    for a, b in zip(order[1:].tolist(), order[:-1].tolist()):
        n = 0
        while max(a, b) + n < len(symbols) and symbols[a + n] == symbols[b + n]:
            n += 1
        assert common[a] == n
    assert common[order[0]] == 0


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), bytes(b for b, g in zip(d, gone) if not g)))
    return out


def run(df, length):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in s.remove_repeats(df, length=length).collect()), key=str)


def test_query_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r["doc_id"]: w for r, w in zip(rows, brute([r["text"] for r in rows], 400))}
    got = QUERIES["op8_suffix_dedup"](spark, sf).collect()
    assert len(got) == len(rows) and sum(r["n_removed"] > 0 for r in got) > 5
    for r in got:
        n, removed, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("hot", [1500, 8, 2])
def test_overlaps_and_edges(spark, hot, monkeypatch):
    """Passages with different neighbours, repeats inside one text, periodic texts, exact copies; hot anchors get longer."""
    monkeypatch.setattr(s, "HOT", hot)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(n)) for n in (12, 20, 40, 80)]
    texts = ["ab" * 200, "x" * 90, "x" * 150, None, "", "short", passages[3] + " | " + passages[3]]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages)[rng.randint(0, 30) :], " ".join(word() for _ in range(rng.randint(0, 20)))]
        texts.append(rng.choice(["", "a", "b "]).join(parts))
    texts += texts[10:14]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(((k, *w) for k, w in enumerate(brute(texts, 60))), key=str)
    monkeypatch.setattr(s, "SHARD_BYTES", 3000)
    assert run(df, 60) == want


def test_periodic_texts_send_a_piece_once(spark, monkeypatch):
    """A text of n periods has n equal pieces around one anchor string, of which one is held against other texts."""
    sent = []
    runs_of_windows = s.runs_of_windows
    monkeypatch.setattr(s, "HOT", 2)
    monkeypatch.setattr(s, "SLICE", 2000)
    monkeypatch.setattr(s, "runs_of_windows", lambda pieces, length: sent.append(pieces.count()) or runs_of_windows(pieces, length))
    texts = [f"{k} " + "Is onhe. " * 300 + f" {k * k}" for k in range(6)] + ["x" * 5000, "Is onhe. " * 6, "Is onhe. " * 7, "é" * 80]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert run(df, 60) == sorted(((k, *w) for k, w in enumerate(brute(texts, 60))), key=str)
    assert 0 < sent[0] < 100


def test_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(s, "SLICE", 1000)
    rng = random.Random(3)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(1500))
    texts = [long + long[3000:3700], "y" + long[900:1200], long[5000:5090]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert run(df, 80) == sorted(((k, *w) for k, w in enumerate(brute(texts, 80))), key=str)


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows = [(i, t if t is None or len(t) < 9000 else t) for i, t in rows]
    got = s.remove_repeats(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] == 6:
            assert r["n_removed"] == r["n_bytes"] == 150000 and r["n_spans"] == 1
        else:
            assert r["n_removed"] == 0
    assert s.remove_repeats(empty).count() == 0
