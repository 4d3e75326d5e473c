import pytest

#: doc_id, text: nulls, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"), (5, "a b c d e f a b c d e f"), (6, "word " * 30000),
    (7, "Line of text here\nLine of text here\nother\n\n"), (8, "Éé \U0001f600 #tag & 50% <b>"), (None, None),
]
COLUMNS = "doc_id long, text string"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with all columns of documents and columns that clash with what operators add."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, COLUMNS)
    return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.when(F.col("doc_id") > 4, F.lit("src0")), "n_chars": F.length("text").cast("long"), "n_words": F.lit("clash"), "kept": F.lit(7), "slot": F.lit("x"), "spans": F.lit(1), "digest": F.lit(2.5), "score": F.lit("s")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
