"""Spelling variants, SimHash and periodic runs beside brute force."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
import xxhash

from posewright.llm import periodic_runs, simhash, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- op11


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 5}
    out, form = {}, {}
    for w, n in words.items():
        around = [v for v in words if v != w and near(v, w)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = [form[w], None, n, len(around), words[form[w]] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


def invented(seed, n_docs=130):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("etaoinsrléß") for _ in range(rng.randint(6, 9))) for _ in range(25)]

    def edit(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + rng.choice("etxü") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("etxü") + w[k + 1 :]])

    once = [(s, edit(s)) for s in stems]
    pool = [v for s, e in once for v in [s] * 60 + [e] * 8 + [edit(e)] + [edit(s)]]
    return [(k, " ".join(rng.choice(pool).title() + rng.choice(["", "", ".", " 中", "-"]) for _ in range(120))) for k in range(n_docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    rows = invented(seed) + [(1000, None), (1001, ""), (None, "nameless words " * 9), (3, "repeated rowset " * 3), (3, "repeated rowset " * 3)]
    got = {tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = variants(rows)
    assert got == want and sum(r[1] is not None for r in got) > 10 and any(r[1] and r[1] != r[2] for r in got)


def test_variants_of_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.op11_spelling_variants(spark, sf).collect()} == variants(rows)


def test_odd_rows_and_empty_table(odd, empty):
    assert spelling.spelling_variants(empty).count() == 0
    assert {r.word for r in spelling.spelling_variants(odd).collect()} <= {"repeated"}
    assert simhash.simhash_components(empty).count() == 0 and periodic_runs.find_runs(empty).count() == 0


def test_near_words_share_a_part():
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    mask = lambda w: np.bitwise_xor.reduce([1 << spelling.bit_of(ord(c)) for c in w])
    for _ in range(500):
        w = [rng.choice(letters) for _ in range(8)]
        v = w.copy()
        v[rng.randrange(8)] = rng.choice(letters)
        x = int(mask(w)) ^ int(mask(v))
        assert x.bit_count() <= 2 and any(x & p == 0 for p in spelling.parts())


# --- op12


def plain_fingerprint(text, n=4):
    words = WORD.findall(lower(text))
    grams = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    names = sorted(set(marks))
    label = {f: f for f in names}

    def top(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= 4:
                label[top(a)] = top(b)
    return [top(f) for f in marks]


def simhash_rows(rows):
    marks = [plain_fingerprint(t) for _, t in rows]
    tops = plain_components(marks)
    least = {t: min((r[0] for r, u in zip(rows, tops) if u == t and r[0] is not None), default=None) for t in set(tops)}
    return Counter((r[0], f"{f:016x}", least[t]) for r, f, t in zip(rows, marks, tops))


def test_fingerprint_of_a_long_text_in_blocks(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(500))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprints_equal_spark_hash(spark):
    got = spark.sql("SELECT lower(hex(xxhash64('one two three'))) AS h").first()[0]
    assert f"{simhash.fingerprint('One  two\tthree'):016x}" == f"{int(got, 16):016x}"


def test_given_table_equals_brute_force(spark, sf, odd):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).collect()]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == simhash_rows(rows)


@pytest.mark.parametrize(("count", "full"), [(2, 1000), (3, 5), (2, 5), (4, 3)])
def test_links_equal_brute_force(spark, count, full):
    """Invented fingerprints in tight and loose clusters, so that buckets are split again."""
    rng = random.Random(count * full)
    marks = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        loose = rng.sample(range(64), rng.choice([6, 12, 64]))
        for _ in range(25):
            marks.append(centre ^ sum(1 << b for b in rng.sample(loose, rng.randint(0, 5))))
    marks = sorted(set(marks))
    named = spark.createDataFrame([(simhash.signed(f), simhash.signed(f)) for f in marks], "f long, c long")
    far = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in simhash.far_links(named, count, full).select("a", "b").collect()}
    assert far == {(a, b) for i, b in enumerate(marks) for a in marks[:i] if (a ^ b).bit_count() <= 4}
    close = {tuple(r) for r in simhash.close_links(named.select("f")).collect()}
    assert all(((a ^ b) % 2**64).bit_count() <= 2 for a, b in close)


# --- op13


def plain_runs(words):
    """Every period in turn: stretches of words that equal the word one period on."""
    numbers, found = {}, {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    for p in range(1, len(ids) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids[:-p] == ids[p:], [False])).astype(np.int8)))
        for i, e in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            if e + p - i >= max(6, 4 * p):
                found.setdefault((i, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_given_table_equal_brute_force(spark, sf, odd):
    rows = [(r[0], r[1] if r[0] != 6 or not (r[1] or "").startswith("word word") else r[1][:3000]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).collect()]
    got = Counter(tuple(r) for r in periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(plain_row(*r) for r in rows)
    assert any(r[1] for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_invented_words_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        words = []
        while len(words) < rng.choice([0, 5, 30, 120]):
            part = [rng.randrange(3 + seed) for _ in range(rng.randint(1, 5))]
            part = part * rng.randint(1, 3) + [rng.randrange(3)] * rng.randint(0, 1)
            words += part * rng.randint(1, 6) + part[: rng.randint(0, len(part))]
        texts.append(words)
    for words, (start, end, period) in zip(texts, periodic_runs.periodic_runs([np.array(w, np.int64) for w in texts])):
        assert list(zip(start, end - start, period)) == plain_runs(words)


def test_long_texts_walk_their_grids(monkeypatch):
    rng = np.random.default_rng(7)
    words = np.concatenate([rng.integers(0, 50, 300), np.tile(rng.integers(0, 50, 70), 6), rng.integers(0, 50, 200), np.zeros(40, np.int64)])
    want = plain_runs(words.tolist())
    monkeypatch.setattr(periodic_runs, "KEPT_WORDS", 10)
    monkeypatch.setattr(periodic_runs, "POINTS", 100)
    start, end, period = periodic_runs.periodic_runs([words])[0]
    assert list(zip(start, end - start, period)) == want and len(want) >= 2


@pytest.mark.parametrize("n", [1, 15, 16, 17, 300, 5000])
def test_range_minima(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 1000, n)
    a, b = rng.integers(0, n, 300), rng.integers(0, n, 300)
    low, high = np.minimum(a, b), np.maximum(a, b)
    assert periodic_runs.RangeMinima(values).least(low, high).tolist() == [int(values[x : y + 1].min()) for x, y in zip(low, high)]
