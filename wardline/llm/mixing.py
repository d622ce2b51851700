"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each source has a word budget. Whole copies of the source fill as much of it as they
can; the rest goes to the documents whose hash lies under a threshold. The threshold is
found without sorting: words are summed by source and hash bucket, the bucket in which
the budget runs out is cut into finer buckets, and so on to single hash values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, settle

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
HASH_BITS, STEP_BITS = 60, 10
#: With more sources than this their thresholds are joined by a shuffle, not broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """The document's place in [0, 2^60), the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 64 - HASH_BITS)


def targets(totals: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """source, source_size -> also target: the budget of words.

    Budgets share the whole size by weight; one above max_repeat times its source's
    size stops there and the excess is shared anew, which ends at target =
    min(cap, level * weight) for a single level. A row for each source meets in one
    task here, never one for each document.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    ranked = (
        totals.withColumn("place", place)
        .withColumn("weight", weight)
        .withColumn("cap", max_repeat * F.col("source_size").cast("double"))
        .withColumn("all_words", F.sum("source_size").over(everything))
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (F.col("all_words") - before) / left)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))
    level = F.min(fits).over(everything)["level"]
    return levels.select("source", "source_size", F.coalesce(F.least("cap", level * F.col("weight")), "cap").alias("target"))


def _with_source(rows: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    right = per_source.withColumnRenamed("source", "_key")
    return rows.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_key"))).drop("_key")


def thresholds(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """From (source, size, hash): source, source_size, target, copies, cut.

    A document is taken `copies` times, and once more if its hash is below `cut`.
    """
    totals = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    small = totals.count() <= BROADCAST_SOURCES
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = settle(
        targets(totals, weights, max_repeat)
        .withColumn("copies", copies)
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("low", F.lit(0).cast("long"))
        .withColumn("open", F.col("rest") > 0)
    )
    rows = sized
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        bucket = F.shiftright(F.col("hash") - F.col("low"), shift)
        inside = F.col("open") & (F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + (1 << (shift + STEP_BITS)))
        boundary = _with_source(rows, state.select("source", "low", "open"), small).filter(inside)
        if shift < HASH_BITS - STEP_BITS:  # from here on only the boundary bucket's documents are looked at
            boundary = rows = settle(boundary.select("source", "size", "hash", "low", "open"))
            rows = rows.select("source", "size", "hash")
        sums = boundary.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        over = _with_source(sums.withColumn("upto", upto), state.select("source", "rest"), small).filter(F.col("upto") > F.col("rest"))
        first = over.groupBy("source").agg(F.min(F.struct("bucket", "words", "upto")).alias("hit"))
        hit, found = F.col("hit"), F.col("hit").isNotNull()
        before = hit["upto"] - hit["words"]
        low = F.when(F.col("open") & found, F.col("low") + F.shiftleft(hit["bucket"], shift)).when(F.col("open"), F.col("low") + (1 << (shift + STEP_BITS))).otherwise(F.col("low"))
        if shift == 0:  # a single hash value: take it if that comes closer to the budget
            low = low + F.when(F.col("open") & found & (hit["upto"] - F.col("rest") < F.col("rest") - before), 1).otherwise(0)
        rest = F.when(F.col("open") & found, F.col("rest") - before).otherwise(F.col("rest"))
        state = settle(
            state.join(first.withColumnRenamed("source", "_key"), F.col("source").eqNullSafe(F.col("_key")), "left").select(
                "source", "source_size", "target", "copies", rest.alias("rest"), low.alias("low"), (F.col("open") & found).alias("open")
            )
        )
    return state.select("source", "source_size", "target", "copies", F.col("low").alias("cut"))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text"), seed).alias("hash"))


def shares(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken: one row per row of docs.

    A null text has size 0; a null source is a source of its own, last in order. Rows
    alike in doc_id and text are taken or left together, and so are rows whose hashes tie.
    Words of whole texts are counted, however long; a text larger than its source's budget
    is taken or not by its hash like any other. An empty table gives an empty result. Other
    columns of docs are ignored.
    """
    rows = settle(sized(docs, seed))
    per_source = thresholds(rows, weights, max_repeat)
    small = per_source.count() <= BROADCAST_SOURCES
    repeats = F.col("copies") + (F.col("hash") < F.col("cut")).cast("long")
    return _with_source(rows, per_source, small).select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (0 to max_repeat times), columns unchanged."""
    per_source = thresholds(settle(sized(docs, seed).drop("doc_id")), weights, max_repeat)
    small = per_source.count() <= BROADCAST_SOURCES
    key, copies, cut, nth = fresh(docs, "source", "copies", "cut", "nth")
    right = per_source.select(F.col("source").alias(key), F.col("copies").alias(copies), F.col("cut").alias(cut))
    repeats = F.col(copies) + (row_hash(F.col("doc_id"), F.col("text"), seed) < F.col(cut)).cast("long")
    taken = docs.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col(key)))
    copies_of = F.explode(F.when(repeats > 0, F.sequence(F.lit(1).cast("long"), repeats)))
    return taken.withColumn(nth, copies_of).select(*docs.columns)
