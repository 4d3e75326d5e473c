import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from posewright.llm import decontaminate as d
from posewright.llm.queries import QUERIES


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), st.binary(max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_least_distance_brute_force(p, t):
    assert d.least_distance(p, t, len(p)) == brute_distance(p, t)


def test_query_finds_all_copies(spark, sf):
    docs = {r["doc_id"]: d.normal(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: d.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = QUERIES["op1_decontaminate"](spark, sf).collect()
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows}
    assert len(got) == len(rows)
    for i, text in items.items():
        for k, doc in docs.items():
            if text in doc:
                assert got[k, i] == 0
    for (k, i), distance in got.items():
        assert distance <= 0.2 * len(items[i])


def edited(rng, words, rate, vocabulary):
    out = []
    for w in words:
        if rng.random() < rate:
            out += rng.choice([[rng.choice(vocabulary)], [w, rng.choice(vocabulary)], []])
        else:
            out.append(w)
    return out


def test_recall_under_edits(spark):
    sf = "/root/testdata/sf0.01"
    rng = random.Random(4)
    benchmark = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    vocabulary = [w for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect() for w in r["text"].split()]
    index = d.Index([d.Item(k, d.normal(t)) for k, t in enumerate(benchmark)])
    n = hit = 0
    for k, text in enumerate(benchmark * 4):
        k %= len(benchmark)
        copy = " ".join(rng.choices(vocabulary, k=rng.randint(10, 50)) + edited(rng, text.split(), 0.1, vocabulary) + rng.choices(vocabulary, k=30))
        true = d.least_distance(d.normal(text), d.normal(copy), int(0.2 * len(d.normal(text))))
        if true is not None:
            n += 1
            hit += any(i == k for _, i, _ in index.matches([copy]))
    assert n > 100 and hit >= 0.9 * n


@pytest.mark.parametrize("rate", [0.1, 0.15])
@pytest.mark.parametrize(("least", "most"), [(5, 7), (8, 11), (12, 15), (16, 30), (31, 59), (60, 120), (300, 600)])
def test_recall_at_every_size(rate, least, most):
    rng = random.Random(least)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(least, most))) for _ in range(40)]
    index = d.Index([d.Item(k, d.normal(t)) for k, t in enumerate(items)])
    n = hit = 0
    for k, text in enumerate(items * (1 if least > 100 else 2)):
        k %= len(items)
        copy = " ".join(rng.choices(vocabulary, k=rng.randint(10, 50)) + edited(rng, text.split(), rate, vocabulary) + rng.choices(vocabulary, k=30))
        true = d.least_distance(d.normal(text), d.normal(copy), int(0.2 * len(d.normal(text))))
        if true is not None:
            found = [x for _, i, x in index.matches([copy]) if i == k]
            n, hit = n + 1, hit + bool(found)
            assert not found or true <= found[0] <= 0.2 * len(d.normal(text))
    assert n >= 20 and hit >= 0.9 * n


def test_blocks_and_odd_rows(spark, sf, odd, empty, monkeypatch):
    benchmark = spark.createDataFrame([(1, "a b c d e f a b c d e f"), (2, None), (3, ""), (4, "too short"), (5, "zz yy xx ww vv uu tt ss rr")], "item_id long, text string")
    whole = {(r[0], r[1], r[2]) for r in d.find_leaks(odd, benchmark).collect()}
    assert (5, 1, 0) in whole and all(k == 5 for k, *_ in whole)
    monkeypatch.setattr(d, "BLOCK_WORDS", 10)
    assert len(list(d.blocks(benchmark))) > 1
    assert {(r[0], r[1], r[2]) for r in d.find_leaks(odd, benchmark).collect()} == whole
    kept = d.drop_leaks(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert d.find_leaks(empty, benchmark).count() == 0 and d.drop_leaks(empty, benchmark).count() == 0
    assert d.find_leaks(odd, benchmark.where("false")).count() == 0
    assert d.drop_leaks(odd, benchmark.where("item_id = 4")).count() == odd.count()


def test_long_text():
    index = d.Index([d.Item(0, d.normal("one two three four five six seven eight nine ten eleven twelve"))])
    long = "filler words here " * 400_000
    assert index.matches([long, None, long + "One, two; three four five six seven eight nine ten eleven twelve", "", "b"]) == [(2, 0, 0)]


UNSPACED = ["日本の首都はどこですか。東京です。", "中国最长的河流是哪一条？长江。", "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"]


def test_texts_without_spaces():
    index = d.Index([d.Item(k, d.normal(t)) for k, t in enumerate(UNSPACED)])
    for k, t in enumerate(UNSPACED):
        assert len(d.normal(t).split()) >= d.MIN_WORDS
        assert index.matches([f"前文です、{t}後文です。", "ไม่มีอะไร", "别的东西，别的东西"]) == [(0, k, 0)]
        changed = t[:4] + "x" + t[5:]
        assert any((text, i) == (0, k) and 0 < distance <= 0.2 * len(d.normal(t)) for text, i, distance in index.matches([f"前文です、{changed}後文です。"]))
    assert d.normal("Well—“quoted” words… 5€ \U0001f600x ありがとう・ござい") == "well quoted words 5 € \U0001f600 x あ り が と う ご ざ い".encode()


def test_short_items():
    items = ["Paris", "too short", "Who wrote Hamlet?", "東京", "a b c d", "too short", "", "?!", "one two three four five six"]
    index = d.Index([d.Item(k, d.normal(t)) for k, t in enumerate(items)])
    texts = ["In PARIS, far too... short", "parish, too long short", None, "x who wrote: hamlet", "who wrote", "hamlet?", "今日は東京へ", "京東", "a b c", "d a b c d e", "", "one two three four five six"]
    found = set(index.matches(texts))
    assert found == {(0, 0, 0), (0, 1, 0), (0, 5, 0), (3, 2, 0), (6, 3, 0), (9, 4, 0), (11, 8, 0)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=5))
def test_short_items_brute_force(items, texts):
    index = d.Index([d.Item(k, " ".join(w).encode()) for k, w in enumerate(items)])
    brute = {(t, i, 0) for t, x in enumerate(texts) for i, w in enumerate(items) if any(x[a : a + len(w)] == w for a in range(len(x)))}
    assert set(index.matches([" ".join(x) for x in texts])) == brute


def test_short_and_unspaced_items_in_tables(spark):
    docs = spark.createDataFrame([(1, "It is too short."), (2, f"前文。{UNSPACED[0]}後文。"), (3, "clean"), (4, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "too short"), (8, UNSPACED[0])], "item_id long, text string")
    assert {tuple(r)[:3] for r in d.find_leaks(docs, benchmark).collect()} == {(1, 7, 0), (2, 8, 0)}
    assert sorted(r["doc_id"] for r in d.drop_leaks(docs, benchmark).collect()) == [3, 4]
