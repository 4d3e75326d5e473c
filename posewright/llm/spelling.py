"""Spelling variants by letter-parity bitmasks.

A word's mask holds for each letter whether the word has an odd number of it. A replaced letter flips two bits of the
mask at most, an inserted or deleted one flips one.

1. Counting. Tasks count the words of their texts; Spark sums the counts.
2. Bands. The bits lie in three bands, letters dealt to them in turn by frequency. At most two bits differ, so two near
   words agree in one band whole; what is left of the mask is split into three parts again, and they agree in one of
   these too. So each word has nine keys, each of a band and a part of the rest.
3. Join. Words meet under equal keys and a length that is equal or one more; the join keeps a pair only under the first
   key that both share, with two differing bits at most, and with an edit distance of exactly one.
4. Forms and roots. A word's form is its near word of largest count, if that count is FACTOR times its own at least.
   Counts grow along forms, so forms have no circles; roots come by doubling the steps.

Pairs are found among distinct words only, so a frequent word costs no more than a rare one, and no list of a key's
words is ever built: a key with many words is rows of a join, which Spark splits.

Edge cases: null and empty texts have no words; a null id counts as the empty string in the hash that deletes letters;
repeated rows count once each; of words with equal counts the smallest in code-point order is the form; an empty table
gives an empty result; a text may have any length, one batch of texts is held at a time; only the id and text columns
are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewright.llm.common import cut_lineage, read

LEAST_LETTERS = 6
LEAST_COUNT = 5
FACTOR = 5
#: One word occurrence in so many loses a letter.
DAMAGE = 199
#: Counts that a task holds before it sends them on.
HELD_WORDS = 200_000
BANDS, BAND_BITS = 3, 21
#: English letters by frequency, so that each band tells about as many words apart as the others.
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
#: In Latin-1 a letter is one byte; any other character becomes a question mark, which is none.
RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LETTERS)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def damaged(run: bytes, seed: int) -> bytes:
    """The run, without one of its letters if its hash says so. seed: crc32 of what the hash begins with."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % DAMAGE:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least LEAST_LETTERS letters and LEAST_COUNT occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                name = name.as_py()
                seed = crc32(b":" if name is None else f"{name}:".encode())
                for found, n in Counter(RUN.findall((text.as_py() or "").encode("latin-1", "replace").translate(LOWER))).items():
                    word = damaged(found, seed)
                    if len(word) >= LEAST_LETTERS:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield sent()
        yield sent()

    counts = docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def bit_of(code: int) -> int:
    """The bit of a letter of Latin-1; a band holds every third letter."""
    k = BY_FREQUENCY.find(chr(code))
    k = k if k >= 0 else len(BY_FREQUENCY) + code % 37
    return k % BANDS * BAND_BITS + k // BANDS


def letter_parity(word: Column) -> Column:
    bits = F.array(*(F.lit(1 << bit_of(c)) for c in range(256)))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(F.when(c == "", F.lit(0).cast("long")).otherwise(F.get(bits, F.ascii(c)))))


def parts() -> list[int]:
    """Nine masks: a band, and a third of the bits of the other two."""
    out = []
    for band in range(BANDS):
        rest = [b for b in range(BANDS * BAND_BITS) if b // BAND_BITS != band]
        out += [sum(1 << b for b in range(BANDS * BAND_BITS) if b // BAND_BITS == band or b in rest[third::3]) for third in range(3)]
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of words at an edit distance of one once, with their counts."""
    words = words.withColumn("mask", letter_parity(F.col("word"))).withColumn("len", F.length("word"))
    part = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("mask").bitwiseAND(F.lit(p)).alias("value")) for k, p in enumerate(parts()))))
    keyed = words.withColumn("part", part).select("word", "n", "mask", "len", F.col("part.k").alias("k"), F.col("part.value").alias("value"))
    own = keyed.select(F.xxhash64("k", "value", "len").alias("key"), F.col("word").alias("a"), F.col("n").alias("na"), F.col("mask").alias("mask_a"), "k")
    other = keyed.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.xxhash64("k", "value", F.col("len") - F.col("longer")).alias("key"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("mask").alias("mask_b"), "longer")
    apart = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    first = reduce(lambda later, kp: F.when(apart.bitwiseAND(F.lit(kp[1])) == 0, kp[0]).otherwise(later), reversed(list(enumerate(parts()))), F.lit(-1))
    same = (own["key"] == other["key"]) & ((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & (F.bit_count(apart) <= 2) & (first == F.col("k")) & (F.levenshtein("a", "b", 1) == 1)
    return own.join(other, same).select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: forms followed to the last. Each round doubles the steps."""
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut_lineage(steps.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR) -> DataFrame:
    """word, form, root string; n, n_near, form_n long, one row a word."""
    words = cut_lineage(word_counts(docs, id_col, text_col))
    pairs = cut_lineage(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    right = -F.col("best.minus") >= factor * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(right, F.col("best.near")).alias("form"), F.when(right, -F.col("best.minus")).alias("form_n"))
    formed = cut_lineage(formed)
    out = formed.join(roots(formed.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))
