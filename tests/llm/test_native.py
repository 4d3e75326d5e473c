import collections
import re

from pyspark.sql import functions as F

from posewright.llm import licenses, quality_rules, sharding
from posewright.llm.queries import QUERIES


def test_sharding_law_and_slots(spark, sf):
    rows = QUERIES["op5_sharding"](spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    for j in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == j) == list(range(sizes[j]))
    import zlib

    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode())


def test_matrix_sums_and_uniformity():
    import random

    m = sharding.communication_matrix([5, 0, 17, 100, 1], 8, 3)
    assert [sum(r) for r in m] == [5, 0, 17, 100, 1]
    cols = [sum(c) for c in zip(*m)]
    assert max(cols) - min(cols) <= 1
    rng = random.Random(5)
    draws = collections.Counter(sharding.hypergeometric(rng, 5, 5, 5) for _ in range(20000))
    from math import comb

    for k in range(6):
        assert abs(draws[k] / 20000 - comb(5, k) * comb(5, 5 - k) / comb(10, 5)) < 0.02
    assert sharding.hypergeometric(rng, 10**10, 10**10, 10**10) > 4 * 10**9


def test_sharding_odd_rows(odd, empty):
    rows = sharding.shuffle_into_shards(odd, ["doc_id"], 3).collect()
    assert len(rows) == odd.count()
    for j in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == j) == list(range(sum(r["shard"] == j for r in rows)))
    assert sharding.shuffle_into_shards(empty, ["doc_id"], 3).count() == 0


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_rules_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_quality_rules"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, dup, rep = brute_counts(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_odd_rows(odd, empty):
    rows = quality_rules.judge(quality_rules.document_counts(odd)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(r["text"])
    assert quality_rules.judge(quality_rules.document_counts(empty)).count() == 0


def test_host_verdict_shrinks(spark):
    rows = [(i, "bad", True) for i in range(90)] + [(i, "good", i < 3) for i in range(300)] + [(1, "tiny", True)]
    df = spark.createDataFrame(rows, "doc_id long, source string, base_failed boolean").withColumns({c: F.lit(0) for c in ("n_symbols", "n_dup_lines")} | {"word_chars": F.lit(9), "n_words": F.lit(9)})
    got = {r["host"]: r for r in quality_rules.host_verdicts(df).collect()}
    assert got["bad"]["host_failed"] and not got["good"]["host_failed"]
    assert got["tiny"]["shrunk_rate"] < 1


def test_licenses(spark, odd, empty):
    texts = [
        (1, "Some prose.\nReleased under the  MIT Licence!\nmore"), (2, "LICENSED UNDER CC BY NC 4 0"),
        (3, licenses.KNOWN_LICENSES[8][1].replace("Copyright (c) <year> <copyright holders>", "(c) 2024 Somebody, Inc.")), (4, None), (5, "nothing"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1]["line_licenses"] == "MIT" and got[1]["whole_license"] is None
    assert got[2]["whole_license"] == "CC-BY-NC-4.0" and got[3]["whole_license"] == "MIT"
    assert got[4]["whole_license"] is None and got[5]["n_license_lines"] == 0
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(empty).count() == 0


def rewrapped(text, width, mark=""):
    import textwrap

    return "\n".join(mark + x for part in re.split(r"\n\s*\n", text) for x in [*textwrap.wrap(" ".join(part.split()), width, break_on_hyphens=False), ""])


def test_known_texts_are_found_whole_and_inside(spark):
    """Each shipped text as a whole, and inside a file between other lines in three layouts."""
    import json

    known = [json.loads(x) for x in licenses.TEXTS.read_text().splitlines()]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0", "MIT", "ISC"} <= {k["license"] for k in known}
    rows = []
    for i, k in enumerate(known):
        text = k["text"]
        body = text[text.index(k["body"]) :] if k["body"] else text
        rows += [(10 * i, text), (10 * i + 1, body), (10 * i + 2, f"/* tool.c\n{body}\n*/\nint main() {{ return 0; }}\n"), (10 * i + 3, "# Readme\n\nSome words. " + " ".join(body.split()) + " And more."), (10 * i + 4, "x = 1\n" + body.rsplit(" ", 2)[0] + "\ny = 2\n")]
        if len(body) < 2000:
            rows += [(10 * i + 5, "head\n" + rewrapped(body, 50, " * ") + "code();")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, k in enumerate(known):
        for at in (0, 1):
            assert got[10 * i + at]["whole_license"] == k["license"], (k["license"], at)
        for at in (0, 1, 2, 3, 5):
            if 10 * i + at in got:
                assert k["license"] in got[10 * i + at]["text_licenses"].split(","), (k["license"], at)
        for at in (2, 3, 4):
            assert got[10 * i + at]["whole_license"] is None
        if not k["end"]:
            assert k["license"] not in got[10 * i + 4]["text_licenses"].split(","), k["license"]


def test_runs_of_any_table(spark):
    """Without a licence word in a known text, all documents are looked into; runs are found at both ends and overlapping."""
    known = spark.createDataFrame([("A", "one two three four five\nsix seven"), ("B", "five six seven\none two"), ("C", "short\ntext")], "license string, text string")
    docs = spark.createDataFrame([(1, "One, two three\nfour five six. Seven one two"), (2, "one two three four five six sevens"), (3, None), (None, "x one two three four five six seven"), (4, "x five six seven one two")], "doc_id long, text string")
    got = {r["doc_id"]: r["text_licenses"] for r in licenses.scan(docs, known).collect()}
    assert got == {1: "A,B", 2: "", 3: "", None: "A", 4: "B"}
    assert licenses.scan(docs, known.where("false")).where("text_licenses = ''").count() == 5


def test_sharding_helper_names_and_ties(spark):
    """Columns with any name, hot and null keys, rows equal in all columns: gapless slots, sizes one apart."""
    rows = [(k % 3 if k % 5 else None, k // 4, 1.0, "x") for k in range(200)] * 2
    df = spark.createDataFrame(rows, "doc_id long, _part long, _rank double, `a.b` string").repartition(5)
    got = sharding.shuffle_into_shards(df, ["doc_id"], 7).collect()
    assert len(got) == 400 and {"_part", "_rank", "a.b", "doc_id", "shard", "slot"} == set(got[0].asDict())
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in sorted(sizes) for k in range(sizes[s])]


def test_license_lines_of_repeated_rows(spark):
    line = licenses.KNOWN_LICENSES[0][1]
    rows = [(1, f"code\n{line}"), (1, f"code\n{line}"), (None, f"{line}\n{line}"), (None, "no licence here")]
    got = sorted((str(r["doc_id"]), r["n_license_lines"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 1), ("1", 1), ("None", 0), ("None", 2)]
