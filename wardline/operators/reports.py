"""Counts, shares and other summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(c: Column, places: int) -> Column:
    """Half up on the double itself, the same in any engine."""
    return F.floor(c * 10**places + 0.5) / float(10**places)


def share(flag: Column, places: int = 1) -> Column:
    return rounded(F.avg(flag.cast("int")) * 100.0, places)


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def status_samples(df: DataFrame, status: str, sample: str, pos: str, good: str, most: int = 5) -> DataFrame:
    """Rows of each status, with the first few samples of all but the good one.

    A sample is kept through partial sums: each task hands on its first few only.
    """
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(status).orderBy(pos))
    first = df.filter(F.col(status) != good).select(status, pos, sample).withColumn("nth", nth).filter(F.col("nth") <= most)
    samples = first.groupBy(status).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, F.col(sample).cast("string").alias("s")))), lambda x: x["s"]), ",").alias("samples"))
    return counts(df, status).join(samples, status, "left").withColumn("samples", F.coalesce("samples", F.lit("")))


def quality(df: DataFrame, dimensions: list[str], ok: Column, review: Column) -> DataFrame:
    """Totals by each dimension and over all, in one pass of grouping sets."""
    rows = df.select(*dimensions, ok.cast("long").alias("_ok"), review.cast("long").alias("_review"))
    sets = rows.groupingSets([[F.col(d)] for d in dimensions] + [[]], *[F.col(d) for d in dimensions])
    return sets.agg(F.count("*").alias("total"), F.sum("_ok").alias("ok"), F.sum("_review").alias("review"), F.grouping_id().cast("long").alias("level"))


def mode_first(df: DataFrame, by: str, value: str, pos: str) -> DataFrame:
    """The most common value of each group, of equally common ones that met first."""
    each = df.groupBy(by, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return each.groupBy(by).agg(F.max_by(value, F.struct("n", F.negative("first"))).alias("mode"), F.sum("n").alias("total"))


def first_int_histogram(df: DataFrame, value: str, top: int = 15) -> DataFrame:
    token = F.coalesce(F.nullif(F.regexp_extract(value, r"(\d+)", 1), F.lit("")), F.lit("none"))
    each = df.groupBy(token.alias("token")).agg(F.count("*").alias("n"))
    return each.orderBy(F.desc("n"), "token").limit(top)
