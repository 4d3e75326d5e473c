import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from posewright.llm import jaccard_join as j
from posewright.llm.common import cut_lineage
from posewright.llm.components import components
from posewright.llm.hashing import packed, unpacked
from posewright.llm.queries import QUERIES


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows):
    """{position: (size, component)} by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 3 * len(sets[a]) <= 4 * len(sets[b]) and 3 * len(sets[b]) <= 4 * len(sets[a]):
                c = len(sets[a] & sets[b])
                if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                    parent[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        ids[r] = i if r not in ids or ids[r] is None else (min(ids[r], i) if i is not None else ids[r])
    return sorted(((i, len(sets[k]), ids[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def run(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.jaccard_components(df).collect()), key=str)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in QUERIES["op3_jaccard_join"](spark, sf).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("block", [512, 7])
def test_chains_of_near_copies(spark, block, monkeypatch):
    """Copies drift, so that many lie outside their pivot's ball and regions must join recursively, in blocks too."""
    monkeypatch.setattr(j, "REGION_BLOCK", block)
    monkeypatch.setattr(j, "BASE_BLOCK", 20)
    rng, rows, i = random.Random(1), [], 0
    for size in (40, 60, 120):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(60):
            rows.append((i, " ".join(base)))
            i += 1
            if rng.random() < 0.8:
                base = list(base)
                for _ in range(rng.randint(1, 3)):
                    base[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
    common = " ".join(f"c{k}" for k in range(30))
    rows += [(i + k, common + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(20))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(df) == brute(rows)


def test_voronoi_regions(spark, monkeypatch):
    """Clusters under one common shingle: pivots separate them, windows replicate what lies between, links stay whole."""
    monkeypatch.setattr(j, "REGION_BLOCK", 6)
    rng, members = random.Random(3), []
    for c in range(8):
        base = {rng.getrandbits(60) for _ in range(40)}
        for _ in range(12):
            kept = sorted(base)[: 40 - rng.randrange(16)]
            members.append(sorted({1, *kept, *(rng.getrandbits(60) for _ in range(rng.randrange(6)))}))
    rows = [(7, k, k, 0.9, np.array(m, np.uint64).tobytes()) for k, m in enumerate(members)]
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in j.recurse(spark.createDataFrame(rows, "region long, k long, component long, far double, shingles binary")).collect()}
    assert got
    want = [(a, b) for a in range(len(members)) for b in range(a + 1, len(members)) if j.linked(len(set(members[a]) & set(members[b])), len(members[a]), len(members[b]))]

    def parts(edges):
        own = list(range(len(members)))
        for a, b in edges:
            a, b = own[a], own[b]
            own = [min(a, b) if x in (a, b) else x for x in own]
        return own

    assert parts(got) == parts(want) and got <= set(want)


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = [(i, n, c if n else i) for (i, n, c) in brute(rows)]
    assert run(odd) == sorted(want, key=str)
    assert run(empty) == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 300)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 301)} | {k: 1000 for k in range(1000, 1200)}


def test_signatures_lose_no_link():
    """Sets around the limit of a link, their signatures of the same or twice the slots."""
    rng = random.Random(5)
    for size in (1, 2, 7, 60, 64, 70, 128, 130, 900):
        base = [rng.getrandbits(64) for _ in range(size)]
        sets = [set(base)]
        for _ in range(20):
            kept = rng.sample(base, size - rng.randrange(size // 4 + 1))
            sets.append({*kept, *(rng.getrandbits(64) for _ in range(rng.randrange(size // 3 + 1)))})
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        for a in range(len(sets)):
            for b in range(a):
                if j.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])):
                    assert j.may_link(np.array([len(sets[a]), len(sets[b])]), [j.signature(arrays[a]), j.signature(arrays[b])]).all()
    strangers = [np.sort(np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)) for _ in range(40)]
    assert not j.may_link(np.full(40, 300), [j.signature(s) for s in strangers]).any()


def test_chance_meetings_reach_no_set(spark, monkeypatch):
    """With every slot of the level table taken, as on large inputs, texts meet under passages of a few words. Only sets
    that may link are fetched, and a hot shingle stays one entry a batch."""
    monkeypatch.setattr(j, "LEVEL_BITS", 6)
    fetched, members = [], j.members_with_sets
    monkeypatch.setattr(j, "members_with_sets", lambda docs, text_col, wanted, n: fetched.append(wanted.count()) or members(docs, text_col, wanted, n))
    rng, rows = random.Random(6), []
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(14)) for _ in range(60)]
    for i in range(240):
        rows.append((i, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(30)), passages[i % 60], *(f"v{rng.randrange(10**6)}" for _ in range(30))])))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(10)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
    assert len(fetched) == 1 and 20 <= fetched[0] <= 30  # the copies, and pivots under which they meet


def test_packed_numbers_take_the_bytes_of_their_steps():
    values = np.sort(np.array([(1 << 62) + k * 200 for k in range(1000)], np.uint64))
    data = packed(values)
    assert np.array_equal(unpacked(data).view(np.uint64), values) and len(data) < 1100
    assert unpacked(packed(values[:1])).tolist() == [1 << 62]


def test_shuffle_files_go_with_their_plan(spark):
    """A checkpoint's own shuffle files are no longer there after the next ones."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_")}

    before = shuffles()
    kept = cut_lineage(spark.range(1000).withColumn("x", F.xxhash64("id")).groupBy("x").agg(F.min("id").alias("id")))
    new = shuffles() - before
    for _ in range(20):
        cut_lineage(spark.range(3))
        if not new & shuffles():
            break
        time.sleep(0.2)
    assert new and not new & shuffles() and kept.count() == 1000
