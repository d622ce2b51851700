"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The n-grams of a text, of its characters in lower case with white space as one blank, are
hashed to a fixed number of features and count once for each text. A feature's value is
the log ratio of its naive Bayes rates in toxic and clean training texts; a logistic
regression with an L2 penalty weighs the values. It is fitted in one task on a sample of
labelled rows whose number and bytes are parameters; the weights that go to all tasks have
a fixed size. The share of toxic texts that scores assume is that of all training labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, fresh, settle

ORDERS = (3, 4, 5)
FEATURE_BITS = 19
#: Labelled rows that the classifier is fitted on: at most so many, half of each class.
FIT_ROWS = 8_000
#: Bytes of their texts, at most, half of them for each class: texts over a 64th of them come last in their class.
FIT_BYTES, LONG_SHARE = 64_000_000, 64
THRESHOLD = 0.7
#: Features are used that so many texts have, in numbers so many deviations off what chance would give.
LEAST_TEXTS, SURPRISE = 3, 3.2
SMOOTH, PENALTY, STEPS, RATE = 1.0, 1.0, 100, 0.05


def features(text: bytes | None, seen: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of a text; seen is a scratch array of False, left so."""
    plain = " ".join((text or b"").decode("utf-8", "replace").lower().split())
    raw = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32)
    for n in ORDERS:
        if len(raw) >= n:
            code = raw[: len(raw) - n + 1].copy()
            for i in range(1, n):
                code *= np.uint32(0x01000193)
                code ^= raw[i : len(raw) - n + 1 + i]
            code *= np.uint32(0x9E3779B1)
            seen[code >> np.uint32(32 - FEATURE_BITS)] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


def fit(texts: list[bytes | None], labels: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weight of each feature, and the bias, for texts with labels 0 and 1; prior: the share of 1 at large."""
    size, seen = 1 << FEATURE_BITS, np.zeros(1 << FEATURE_BITS, bool)
    weights, prior = np.zeros(size, np.float32), min(max(prior, 1e-6), 1 - 1e-6)
    if len(set(labels.tolist())) < 2:  # nothing to tell apart
        return weights, float(np.log(prior / (1 - prior)))
    often, toxic_often = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for t, y in zip(texts, labels):
        found = features(t, seen)
        often[found] += 1
        if y == 1:
            toxic_often[found] += 1
    here = labels.mean()
    surprise = (toxic_often - often * here) / np.sqrt(np.maximum(often, 1) * here * (1 - here) * np.maximum(1 - often / len(texts), 1e-3))
    kept = np.flatnonzero((often >= LEAST_TEXTS) & (np.abs(surprise) >= SURPRISE))
    place = np.full(size, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    rows = []
    for t in texts:  # looked at once more, so that only what is kept is held
        found = place[features(t, seen)]
        rows.append(found[found >= 0])
    lengths, flat = np.array([len(r) for r in rows]), np.concatenate(rows)
    del rows
    ends = np.append(0, np.cumsum(lengths))
    blocks = [(i, min(i + 250, len(texts))) for i in range(0, len(texts), 250)]  # what is derived from flat is held for one of them
    toxic_rate, clean_rate = toxic_often[kept] + SMOOTH, (often - toxic_often)[kept] + SMOOTH
    ratio = np.log(toxic_rate / toxic_rate.sum()) - np.log(clean_rate / clean_rate.sum())
    w, bias, moment, speed = np.zeros(len(kept)), 0.0, np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, STEPS + 1):
        slope = np.append(PENALTY * w, 0.0)
        for low, high in blocks:
            found, owner = flat[ends[low] : ends[high]], np.repeat(np.arange(high - low), lengths[low:high])
            margin = np.bincount(owner, weights=(ratio * w)[found], minlength=high - low) + bias
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[low:high]
            slope[:-1] += ratio * np.bincount(found, weights=error[owner], minlength=len(kept))
            slope[-1] += error.sum()
        slope /= len(texts)
        moment = 0.9 * moment + 0.1 * slope
        speed = 0.999 * speed + 0.001 * slope * slope
        change = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.999**step)) + 1e-8)
        w, bias = w - change[:-1], bias - change[-1]
    weights[kept] = ratio * w
    return weights, float(bias + np.log(prior / (1 - prior)) - np.log(here / (1 - here)))


def _fit(prior: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
        weights, bias = fit(texts, np.array(labels, float), prior)
        yield pa.record_batch([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    return run


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> tuple[np.ndarray, float]:
    """Fit on labelled rows of docs outside the held-out fold (crc32 of the id mod 3 is 1).

    Of each class the fit_rows / 2 rows that come first by a hash of the id are used, as
    far as their texts hold no more than half of fit_bytes. Texts longer than a 64th of
    fit_bytes come after all others, so they keep none out; one row of each class is
    used in any case. Null labels don't count; an id labelled both ways is toxic. With one class
    only, every text gets the same score.
    """
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.filter(crc_of_id(F.col("doc_id")) % 3 != 1)
    known = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).join(marked, "doc_id", "left_semi").distinct()
    known = settle(known.join(marked, "doc_id"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    half = fit_rows // 2
    order = [F.xxhash64(F.lit(3), F.col("doc_id")), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(half).union(known.filter("toxic = 0").orderBy(*order).limit(half))
    picked = F.broadcast(picked)  # fit_rows rows at most
    wanted = docs.join(picked, "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    # the lengths of so many rows, without the texts, show where the bytes run out
    sizes = wanted.select("doc_id", "toxic", "hash", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).orderBy(*order, "hash").limit(fit_rows)
    shortest_first = Window.partitionBy("toxic").orderBy((F.col("size") > fit_bytes // LONG_SHARE).cast("int"), *order, "hash")
    marked_sizes = sizes.withColumns({"upto": F.sum("size").over(shortest_first.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(shortest_first)})
    within = marked_sizes.filter((F.col("upto") <= fit_bytes // 2) | (F.col("nth") == 1)).select("doc_id", "hash").distinct()
    sample = wanted.join(F.broadcast(within), ["doc_id", "hash"]).orderBy(*order, "hash").limit(fit_rows).select("text", "toxic").coalesce(1)
    row = sample.mapInArrow(_fit(prior), "weights binary, bias double").collect()
    if not row:
        return np.zeros(1 << FEATURE_BITS, np.float32), 0.0
    return np.frombuffer(row[0]["weights"], np.float32), row[0]["bias"]


def scorer(model: tuple[np.ndarray, float], spark) -> Column:
    """Score of the column text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)  # 4 bytes for each of 2**FEATURE_BITS features

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        seen = np.zeros(1 << FEATURE_BITS, bool)
        for part in texts:
            margin = np.array([bias + weights[features(t, seen)].sum(dtype=np.float64) for t in part])
            yield pd.Series(1 / (1 + np.exp(-np.clip(margin, -30, 30))), dtype="float64")

    return score(F.col("text").cast("binary"))


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs.

    Null and empty texts get the score of a text of no words. A null doc_id is never
    trained on and hashes as the empty string. Repeated rows get the same score each, and
    are trained on together; texts of any length are scored whole; an empty table gives an empty result, and without labels
    every text gets the same score. Other columns are ignored.
    """
    score = scorer(train(docs, labels, fit_rows), docs.sparkSession)
    rows = docs.select("doc_id", (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs whose score stays under the threshold, columns unchanged.

    Rows are looked at one by one, so nulls, ties and repeated rows have the fate that
    their scores() give them; an empty table stays empty.
    """
    (name,) = fresh(docs, "score")
    scored = docs.withColumn(name, scorer(train(docs, labels, fit_rows), docs.sparkSession))
    return scored.filter(F.col(name) < THRESHOLD).select(*docs.columns)
