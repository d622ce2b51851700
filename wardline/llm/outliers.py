"""Quality rules by robust multivariate outliers (DataFrame functions only).

Of each text five statistics are counted and transformed. For each language and source, a
minimum-covariance-determinant estimate of their centre and covariance is taken from the
texts that pass two plain rules: from two starts (medians with absolute deviations; mean with
standard deviations) the 75 % of the texts nearest by Mahalanobis distance are taken again
and again, and the start that ends in the smaller determinant counts. Texts farther from
the centre than all but one in 100,000 normal ones are rejected. The nearest are told by
histograms of distances, so nothing is sorted, and groups are only ever summed up: what is
joined back to the texts is a row a group. A source with few texts is judged by the estimate
of its language, and a language with few texts by that of all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Folder

WINDOW, LEAST_WORDS, MOST_REPEATED = 3, 50, 50
SYMBOLS = "[#*$%&|<>]"
#: Fewer texts than this give no estimate of their own, and of all texts none at all.
LEAST_ROWS = 100
#: Share of the texts that an estimate rests on, refinements, tail of a normal distribution that is rejected.
SHARE, STEPS, TAIL = 0.75, 4, 1e-5
#: Transformed statistics and the least deviation that each is taken to have: log of words and
#: of the mean word's length, of symbols a hundred words, of repeated lines, and the share of repeated words.
STATISTICS = {"words": 1.0, "word_length": 0.06, "symbols": 0.3, "lines": 0.4, "repeats": 0.1}
NAMES, FLOORS = list(STATISTICS), list(STATISTICS.values())
N = len(NAMES)
PAIRS = [(i, j) for i in range(N) for j in range(i + 1)]
#: Steps of the histograms: a deviation's share for statistics; of distances, doublings.
FINE, DOUBLINGS = 16, 32


def chi_square(x: float, k: int) -> float:
    """Distribution function of the chi-square law of k (odd) degrees of freedom."""
    p = math.erf(math.sqrt(x / 2))
    for d in range(1, k, 2):
        p -= (x / 2) ** (d / 2) * math.exp(-x / 2) / math.gamma(d / 2 + 1)
    return p


def quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < p else (low, middle)
    return low


#: What makes the covariance of the nearest SHARE of normal rows that of all of them.
CONSISTENCY = SHARE / chi_square(quantile(SHARE, N), N + 2)
CUTOFF = quantile(1 - TAIL, N)


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of three words found twice or more in the array."""
    hashes = F.filter(F.transform(words, lambda w, i: F.when(F.get(words, i + (WINDOW - 1)).isNotNull(), F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))), lambda h: h.isNotNull())
    return F.transform(F.array(hashes), _covered)[0]


def _covered(hashes: Column) -> Column:
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = lambda s: F.filter(s, lambda e, i: (e["h"] == F.get(s, i + 1)["h"]) | (i > 0) & (e["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"]))
    starts = F.sort_array(F.transform(F.transform(F.array(placed), again)[0], lambda e: e["i"]))
    reach = lambda s: F.aggregate(F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.transform(F.array(starts), reach)[0]).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of each text, base_failed, and the transformed statistics."""
    text = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    words = text.withColumn("ws", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    with_word = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    repeated_lines = F.transform(F.array(with_word), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))[0]
    counted = words.select(
        "doc_id", "lang", "source",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_lines.cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
    )
    n = F.col("n_words")
    failed = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)
    return counted.withColumns(
        {
            "base_failed": failed,
            "words": F.log1p(n),
            "word_length": F.log((F.col("word_chars") + 1) / (n + 1)),
            "symbols": F.log1p(100 * F.col("n_symbols") / F.greatest(n, F.lit(1))),
            "lines": F.log1p("n_dup_lines"),
            "repeats": F.col("n_repeat_words") / F.greatest(n, F.lit(1)),
        }
    )


def groups(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """source_key: lang, source -> key (of the estimate that judges it), keys (of those it is part of).

    rows: one for each text that can be estimated from; every (lang, source) has a row.
    """
    key = lambda level, lang, source: F.to_json(F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source")))
    none, lang, source = F.lit(None).cast("string"), F.col("lang"), F.col("source")
    by_source = rows.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    by_lang = by_source.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("n_lang"), F.min("n").alias("fewest"))
    fewest_of_lang = by_lang.filter(F.col("fewest") < least).agg(F.min("n_lang")).first()[0]
    needs_all = fewest_of_lang is not None and fewest_of_lang < least
    joined = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("of")))
    own, of_lang, of_all = F.col("n") >= least, F.col("n_lang") >= least, key(0, none, none)
    judged = F.when(own, key(2, lang, source)).when(of_lang, key(1, lang, none)).otherwise(of_all)
    part = F.array(F.when(own, key(2, lang, source)), F.when(of_lang & (F.col("fewest") < least), key(1, lang, none)), of_all if needs_all else none)
    return joined.select(lang, source, judged.alias("key"), F.array_compact(part).alias("keys"))


def _with(rows: DataFrame, per_group: DataFrame, *on: str) -> DataFrame:
    """rows with what belongs to their group; nulls are a value."""
    right, same = per_group, F.lit(True)
    for c in on:
        right = right.withColumnRenamed(c, f"_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(right, same, "left").drop(*[f"_{c}" for c in on])


def _middle(values: DataFrame) -> DataFrame:
    """key, at, value (in whole steps) -> key, at, middle: the median's step."""
    counts = values.groupBy("key", "at", "value").agg(F.count("*").alias("n"))
    group = Window.partitionBy("key", "at")
    upto = counts.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("all", F.sum("n").over(group))
    return upto.filter(2 * F.col("upto") >= F.col("all")).groupBy("key", "at").agg(F.min("value").alias("middle"))


def _wide(steps: DataFrame, name: str) -> DataFrame:
    cells = [F.max(F.when(F.col("at") == i, F.col("middle"))) * (FLOORS[i] / FINE) for i in range(N)]
    return steps.groupBy("key").agg(F.array(*cells).alias(name))


def medians(fits: DataFrame, folder: Folder) -> DataFrame:
    """key, centre, spread: medians of the statistics and 1.4826 times the median absolute deviations."""
    steps = lambda c, i: F.round(c / (FLOORS[i] / FINE)).cast("long")
    tall = lambda df, of: df.select("key", F.posexplode(F.array(*[steps(of(i), i) for i in range(N)])).alias("at", "value"))
    centre = folder.write(_wide(_middle(tall(fits, lambda i: F.col(NAMES[i]))), "centre"), "centres")
    near = tall(_with(fits, centre, "key"), lambda i: F.abs(F.col(NAMES[i]) - F.col("centre")[i]))
    return _with(centre, _wide(_middle(near), "off"), "key").select("key", "centre", F.transform("off", lambda x: x * 1.4826).alias("spread"))


def distance() -> Column:
    """Squared Mahalanobis distance of a row to the centre of the columns centre and inverse."""
    d = [F.col(NAMES[i]) - F.col("centre")[i] for i in range(N)]
    terms = [d[i] * d[j] * F.col("inverse")[at] * (1 if i == j else 2) for at, (i, j) in enumerate(PAIRS)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def inverted(moments: DataFrame) -> DataFrame:
    """moments: covariance (the entries of PAIRS) -> also inverse (the same entries) and log_det.

    Variances are raised to the squared least deviations, so that statistics that never
    change leave the matrix regular. By Cholesky's method, column for column.
    """
    cov = dict(zip(PAIRS, range(len(PAIRS))))
    entry = lambda i, j: F.col("covariance")[cov[i, j]]
    df = moments
    for j in range(N):
        raised = F.greatest(entry(j, j), F.lit(FLOORS[j] ** 2)) * (1 + 1e-9)
        rest = raised - sum([F.col(f"l{j}{k}") ** 2 for k in range(j)], F.lit(0.0))
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6 * FLOORS[j] ** 2))))
        df = df.withColumns({f"l{i}{j}": (entry(i, j) - sum([F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, N)})
    for i in range(N):  # the inverse of the lower triangle
        df = df.withColumns({f"m{i}{j}": (F.lit(1.0) if i == j else -sum([F.col(f"l{i}{k}") * F.col(f"m{k}{j}") for k in range(j, i)], F.lit(0.0))) / F.col(f"l{i}{i}") for j in range(i + 1)})
    inverse = F.array(*[sum([F.col(f"m{k}{i}") * F.col(f"m{k}{j}") for k in range(i, N)], F.lit(0.0)) for i, j in PAIRS])
    return df.select(*moments.columns, inverse.alias("inverse"), sum([2 * F.log(F.col(f"l{i}{i}")) for i in range(N)], F.lit(0.0)).alias("log_det"))


def moments(near: DataFrame) -> DataFrame:
    """key, start, centre, covariance of rows, which have an old centre to take differences from."""
    d = [F.col(NAMES[i]) - F.col("centre")[i] for i in range(N)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(d)] + [F.sum(d[i] * d[j]).alias(f"q{i}{j}") for i, j in PAIRS]
    summed = near.groupBy("key", "start").agg(F.count("*").alias("n"), F.first("centre").alias("old"), *sums)
    mean = [F.col(f"s{i}") / F.col("n") for i in range(N)]
    cov = [F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j] for i, j in PAIRS]
    return summed.select("key", "start", F.array(*[F.col("old")[i] + mean[i] for i in range(N)]).alias("centre"), F.array(*cov).alias("covariance"))


def refined(fits: DataFrame, model: DataFrame, folder: Folder, name: str) -> DataFrame:
    """The estimate from the SHARE of each group nearest by the model, whole steps of the histogram at a time."""
    step = F.ceil(F.log2(distance() + 2.0**-20) * DOUBLINGS).cast("long")
    model = model.select("key", "start", "centre", "inverse")
    starts = fits.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    counts = _with(starts, model, "key", "start").groupBy("key", "start", step.alias("step")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("key", "start")
    upto = counts.withColumn("upto", F.sum("n").over(group.orderBy("step"))).withColumn("all", F.sum("n").over(group))
    limits = upto.filter(F.col("upto") >= SHARE * F.col("all")).groupBy("key", "start").agg(F.min("step").alias("limit"))
    limited = folder.write(_with(model, limits, "key", "start"), f"{name}-limits")  # a small table of its own, so that rows needn't be dealt by group
    return inverted(moments(_with(starts, limited, "key", "start").filter(step <= F.col("limit"))))


def estimates(fits: DataFrame, folder: Folder, steps: int = STEPS) -> DataFrame:
    """key, centre, inverse: the minimum-covariance-determinant estimate of each group."""
    robust = folder.write(medians(fits, folder), "medians")
    diagonal = F.array(*[F.pow(F.col("spread")[i], 2) if i == j else F.lit(0.0) for i, j in PAIRS])
    first = robust.select("key", F.lit(0).alias("start"), "centre", diagonal.alias("covariance"))
    whole = moments(_with(fits, robust, "key").withColumn("start", F.lit(1)))
    spread = F.transform("covariance", lambda c, at: F.when(at.isin([PAIRS.index((i, i)) for i in range(N)]), c).otherwise(0.0))
    model = folder.write(inverted(first.union(whole.withColumn("covariance", spread))), "model0")
    for i in range(steps):
        model = folder.write(refined(fits, model, folder, f"model{i + 1}"), f"model{i + 1}")
    best = model.groupBy("key").agg(F.min_by(F.struct("centre", "inverse"), F.struct("log_det", "start")).alias("best"))
    return best.select("key", "best.centre", F.transform("best.inverse", lambda x: x / CONSISTENCY).alias("inverse"))


def judged(docs: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    One row per row of docs. A null text has no words. Texts under 50 words, or more than
    half of whose words lie in repeated windows, are not kept and no estimate rests on
    them; distance (squared, null where nothing was estimated) may be given for them. Null
    languages and sources are values like any other. Where fewer than LEAST_ROWS texts pass
    the rules, nothing is estimated and those that pass are kept. Repeated rows count as often as they
    are there and have the same fate, as have ties; a null doc_id is passed on. Texts of any
    length are read whole; an empty table gives an empty result. Other columns are ignored.
    """
    folder = Folder(docs.sparkSession, "outliers")
    rows = folder.write(statistics(docs), "rows")
    sources = folder.write(groups(rows, least), "groups")
    fits = _with(rows.filter(~F.col("base_failed")), sources, "lang", "source").select(F.explode("keys").alias("key"), *NAMES)
    model = folder.write(estimates(folder.write(fits, "fits"), folder), "estimates")
    enough = rows.filter(~F.col("base_failed")).limit(least).count() >= least
    known = _with(_with(rows, sources.select("lang", "source", "key"), "lang", "source"), model, "key")
    far = distance() if enough else F.lit(None).cast("double")
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return known.withColumn("distance", far).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), "distance")
