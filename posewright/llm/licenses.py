"""Licence scans by canonical digest.

A text is put into a canonical form (lower case, copyright lines dropped, equivalent spellings unified,
punctuation and white space folded) and its SHA-256 is hash-joined to the digests of known licences. Looked up are
the whole document, each of its lines, since notices are often one line of a page, and every run of words as long
as a known licence of several lines that begins with the licence's first ANCHOR words, so that a licence is found
inside other text however its lines are broken. Known are the whole texts in license_texts.jsonl, each also without
its title and without its appendix, and the notices below; other texts and changed ones match nothing.

Edge cases: null and empty texts have the digest of the empty text and match nothing; a licence listed twice
under equal canonical texts reports its smallest name; repeated rows give equal results; an empty table gives an
empty result; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posewright.llm.common import let, read

ANCHOR = 5
#: Whole licence texts, of fixed size: license, text, and where the part without title begins and the appendix begins.
TEXTS = Path(__file__).with_name("license_texts.jsonl")

#: Well-known licence texts and one-line notices, by licence name.
KNOWN_LICENSES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]

#: Spellings that count as equal, the left one replaced by the right one, whole words only.
SPELLINGS = [("licences?|licenses", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("noncommercial", "non commercial"), ("merchantability", "merchantability"), ("organisation", "organization"), ("favour", "favor"), ("whilst", "while"), ("wilful", "willful"), ("owner|owners", "holder"), ("holders", "holder"), ("https", "http"), ("v(?=[0-9])", "version ")]


#: A line of these is no copyright line but prose of a licence that was broken there.
PROSE = r"(?![ \t]+(?:holders?|owners?|notices?|licen[cs]es?|laws?|act|interests?|or|and|on|in|of|to|as|is|permission|treaty|protection|status|statements?|rights|disclaimer|you|the|a|an|any|all|if|for|under|that|such|no|each|subject|accompany|convey|use|rename|make|give|do|place|allow|preserve|provide|it|its|where)\b)"
WORDY = "licen[cs]e|warrant|permission"


#: A text stands for itself under two 64-bit hashes, so rows with one id, or with none, keep apart.
KEYS = ("_text_key", "_text_check")


def folded(text: Column) -> Column:
    """Text without copyright lines, case, punctuation and white space; empty for null."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.regexp_like(out, F.lit("copyright|©|all rights reserved")), F.regexp_replace(out, rf"(?m)^[ \t]*((?:copyright\b|\(c\)){PROSE}|©|all rights reserved)[^\n]*$", "")).otherwise(out)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def spelled(out: Column) -> Column:
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, rf"\b(?:{old})\b" if "(?=" not in old else rf"\b{old}", new)
    return out


def canonical(text: Column) -> Column:
    """Canonical form of a text; empty for null."""
    out = folded(text)
    # a spelling table only matters where a licence word stands; other texts skip its passes
    return F.when(F.regexp_like(out, F.lit(WORDY)), spelled(out)).otherwise(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of the notices and of the whole texts in all their forms."""
    out = list(KNOWN_LICENSES)
    for row in map(json.loads, TEXTS.read_text(encoding="utf-8").splitlines()):
        text = row["text"]
        begins = {0, text.index(row["body"]) if row["body"] else 0}
        ends = {len(text), text.index(row["end"], max(begins)) if row["end"] else len(text)}
        out += [(row["license"], text[a:z]) for a in sorted(begins) for z in sorted(ends)]
    return out


def known_table(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    return known if known is not None else spark.createDataFrame(known_texts(), "license string, text string")


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license) of the known licences, a row for each digest."""
    known = known_table(spark, known)
    return known.where(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def run_hash(words: Column, at: Column) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, at, ANCHOR), " "))


def long_texts(known: DataFrame) -> DataFrame:
    """Known texts of several lines and at least ANCHOR words: license, digest, n_words, anchor and whether a licence word is in it."""
    form = spelled(folded(F.col("text")))
    words = F.split(form, " ")
    several = known.where(F.regexp_like("text", F.lit(r"\S[^\n]*\n\s*\S")))
    return several.where(F.size(words) >= ANCHOR).select("license", F.sha2(form, 256).alias("digest"), F.size(words).alias("n_words"), run_hash(words, F.lit(1)).alias("anchor"), F.regexp_like(form, F.lit(WORDY)).alias("wordy"))


def run_digests(docs: DataFrame, lengths: dict[int, list[int]], wordy: bool) -> DataFrame:
    """(KEYS, digest) of the runs of words that begin with an anchor, of each length that it may have. A few documents
    hold a licence word; if every known text does, no other is cut into words."""
    if wordy:
        docs = docs.where(F.regexp_like(F.lower("_text"), F.lit(WORDY)))
    lengths_of = F.create_map(*[x for k, n in lengths.items() for x in (F.lit(k), F.array(*map(F.lit, n)))])

    def runs(words: Column) -> Column:
        starts = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (ANCHOR - 1))), lambda at: F.struct(at.alias("at"), run_hash(words, at).alias("anchor"))), lambda s: s["anchor"].isin(list(lengths)))
        return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.transform(F.element_at(lengths_of, s["anchor"]), lambda n: F.sha2(F.array_join(F.slice(words, s["at"], n), " "), 256)))))

    return docs.select(*KEYS, F.explode(let(F.split(spelled(folded(F.col("_text"))), " "), runs)).alias("digest"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, its canonical digest, the licence that its whole text is (or null), the licences of
    its lines in alphabetical order, how many lines matched, and the licences of several lines that stand anywhere in
    it. Spark broadcasts the known digests only while they are under its threshold; the anchors and lengths of the
    known texts are literals, so their table must be of bounded size."""
    spark, table = docs.sparkSession, known_table(docs.sparkSession, known)
    digests, longs = known_digests(spark, table), long_texts(table)
    forms = longs.select("anchor", "n_words", "wordy").distinct().collect()
    found = digests.select("digest", F.lit("line").alias("place"), "license").unionByName(longs.groupBy("digest").agg(F.min("license").alias("license")).withColumn("place", F.lit("run")))
    if known is None:  # of fixed size: put into canonical form once
        digests, found = (spark.createDataFrame(df.toArrow()) for df in (digests, found))
    lengths: dict[int, list[int]] = {}
    for row in forms:
        lengths.setdefault(row["anchor"], []).append(row["n_words"])
    body = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col), body.alias("_text"), F.xxhash64(body).alias(KEYS[0]), F.xxhash64(F.lit(9), body).alias(KEYS[1]))
    whole = docs.select(id_col, *KEYS, digest(F.col("_text")).alias("digest")).join(digests.withColumnRenamed("license", "whole_license"), "digest", "left")
    lines = F.posexplode(F.filter(F.split("_text", "\n"), lambda s: F.regexp_like(s, F.lit("\\S"))))
    parts = docs.select(*KEYS, lines.alias("_at", "_line")).select(*KEYS, "_at", digest(F.col("_line")).alias("digest"), F.lit("line").alias("place"))
    if lengths:
        parts = parts.unionByName(run_digests(docs, lengths, all(row["wordy"] for row in forms)).withColumns({"_at": F.lit(0), "place": F.lit("run")}))
    is_line = F.col("place") == "line"
    matched = (
        parts.join(found, ["digest", "place"])
        .groupBy(*KEYS)  # equal texts are one, so a line counts once by its place
        .agg(F.array_sort(F.collect_set(F.when(is_line, F.col("license")))).alias("line_licenses"), F.size(F.collect_set(F.when(is_line, F.col("_at")))).alias("n_license_lines"), F.array_sort(F.collect_set(F.when(~is_line, F.col("license")))).alias("text_licenses"))
    )
    joined = whole.join(matched, list(KEYS), "left")
    names = [F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("line_licenses", "text_licenses")]
    return joined.select(id_col, F.col("digest").alias("canonical_sha256"), "whole_license", names[0], F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"), names[1])


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
