from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"

#: Nulls in every column, empty and white-space texts, ties, copies, repeated rows.
ODD = [
    (1, "one two three four five six", "en", "a", 27),
    (2, "one  two three\nfour five six", "en", "a", 28),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n", "en", "b", 3),
    (None, "one two three four five six", "en", "c", 27),
    (None, None, None, None, None),
    (7, "Ünïcode ☃ text with 😀 emoji words and more words here", "de", None, 50),
    (7, "Ünïcode ☃ text with 😀 emoji words and more words here", "de", None, 50),
    (8, "word " * 3000, "fr", "a", 15000),
    (9, "one two three four five siX", "en", "a", 27),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """df with more columns, named like the operators' own."""
    for name in ("sha", "fp", "size", "hash", "score", "source_size", "__sha", "__id", "__nth", "piece", "key", "shard"):
        df = df.withColumn(name, F.lit(1))
    return df


def rows(df):
    return [tuple(r) for r in df.collect()]
