"""Quality rules with host-level verdicts.

Per document, native array functions count the words, symbols, repeated lines and words in repeated 5-word
windows. Rule failures are then summed by host, each host's failure rate is shrunk towards a beta prior that
is fitted to all hosts by moments, and the host's verdict is joined back to its documents.

Edge cases: a null or empty text has no words and fails the base rule; a null host is a host of its own;
columns of the input that are called like an output column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewright.llm.common import cut_lineage, let, read, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 30
HOST_RATE = 0.5


def repeat_words(words: Column, n: int = 5) -> Column:
    """Number of words inside windows of n words that occur twice or more in the same text."""

    def covered(grams: Column) -> Column:
        order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twin = lambda s: F.sort_array(F.filter(F.transform(s, lambda e, k: F.when((e["g"] == F.get(s, k - 1)["g"]) | (e["g"] == F.get(s, k + 1)["g"]), e["i"])), lambda i: i.isNotNull()))
        total = lambda at: F.aggregate(F.transform(at, lambda i, k: F.coalesce(F.least(F.get(at, k + 1) - i, F.lit(n)), F.lit(n)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(order, lambda s: let(twin(s), total))

    def of(hashes: Column) -> Column:
        grams = F.slice(F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, n)])), 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda s: F.regexp_like(s, F.lit(r"[^\x20\x09-\x0D]")))
    stats = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    out = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_stats")
    out = out.withColumn("_stats", stats)
    out = out.withColumns({
        "n_words": F.col("_stats.n_words"),
        "word_chars": F.col("_stats.word_chars"),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long")),
        "n_repeat_words": F.col("_stats.n_repeat_words"),
    }).drop("_stats")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(counted: DataFrame, host: str = "source", limit: float = HOST_RATE) -> DataFrame:
    """One row per host: n_docs, n_failed, shrunk failure rate, host_failed.

    The beta prior's mean is the pooled rate; its strength follows from the spread of the hosts' own rates.
    With one host, or no spread beyond chance, the prior is as strong as the pooled data allow (1e6 rows).
    """
    rules = F.col("base_failed") | (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_words"))
    hosts = counted.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(rules).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    pooled = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.sum(F.col("n_docs") * rate * rate).alias("q"), F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("k"),
    )
    m, n, k = F.col("m"), F.col("n"), F.col("k")
    chance = m * (1 - m)
    spread = F.greatest(F.col("q") / n - m * m - chance * k / n, F.lit(0.0))
    strength = F.when((chance <= 0) | (spread <= chance / 1e6), F.lit(1e6)).otherwise(F.greatest(F.try_divide(chance, spread) - 1, F.lit(1.0)))
    prior = pooled.select((m * strength).alias("alpha"), ((1 - m) * strength).alias("beta")).first()  # one row, two numbers
    alpha, beta = prior["alpha"] or 0.0, prior["beta"] or 0.0
    return hosts.withColumn("shrunk_rate", (F.col("n_failed") + alpha) / (F.col("n_docs") + (alpha + beta))).withColumn("host_failed", F.col("shrunk_rate") > limit)


def judge(counted: DataFrame, host: str = "source") -> DataFrame:
    """What document_counts returned, with shrunk_rate and kept. A hot host's rows are split by Spark's skew join."""
    counted = counted.drop("kept", "shrunk_rate", "host_failed", "_host")
    verdicts = host_verdicts(counted, host).select(F.col("host").alias("_host"), "shrunk_rate", "host_failed")
    joined = counted.join(verdicts, counted[host].eqNullSafe(verdicts["_host"]), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).drop("host_failed")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    counted = cut_lineage(document_counts(docs).drop("text"))  # a few numbers a document, read by the host counts and again by the join
    return judge(counted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("shrunk_rate", 9).alias("host_rate"))
