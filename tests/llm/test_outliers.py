"""Robust outliers against brute force: counts by plain Python, estimates by numpy."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from wardline.llm import outliers
from wardline.llm.outliers import CONSISTENCY, CUTOFF, DOUBLINGS, FINE, FLOORS, SHARE, STEPS

from .helpers import DATA, DOCS, ODD, clashing, empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def transformed(n, chars, symbols, lines, repeats):
    return [math.log1p(n), math.log((chars + 1) / (n + 1)), math.log1p(100 * symbols / max(n, 1)), math.log1p(lines), repeats / max(n, 1)]


def lower_median(steps):
    return sorted(steps)[(len(steps) + 1) // 2 - 1]


def raised(cov):
    cov = np.array(cov)
    for i, f in enumerate(FLOORS):
        cov[i, i] = max(cov[i, i], f * f) * (1 + 1e-9)
    return cov


def estimate(x):
    size = np.array(FLOORS) / FINE
    rounded = lambda v: np.floor(v / size + 0.5)
    centre = np.array([lower_median(c) for c in rounded(x).T]) * size
    spread = np.array([lower_median(c) for c in rounded(np.abs(x - centre)).T]) * size * 1.4826
    ends = []
    for c, cov in ((centre, np.diag(spread**2)), (x.mean(axis=0), np.diag(x.var(axis=0)))):
        cov = raised(cov)
        for _ in range(STEPS):
            d = x - c
            far = np.maximum(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), 0)
            step = np.ceil(np.log2(far + 2.0**-20) * DOUBLINGS)
            near = x[step <= np.sort(step)[math.ceil(SHARE * len(x)) - 1]]
            c, cov = near.mean(axis=0), raised(np.cov(near.T, bias=True))
        ends.append((np.linalg.slogdet(cov)[1], c, cov))
    return min(ends, key=lambda e: e[0])[1:]


def brute(table, least):
    rows = []
    for doc_id, text, lang, source, *_ in table:
        c = counts(text)
        rows.append((doc_id, lang, source, c, c[0] < 50 or 100 * c[4] > 50 * c[0], transformed(*c)))
    passed = [r for r in rows if not r[4]]
    by = {level: defaultdict(list) for level in range(3)}
    for r in passed:
        for level, key in ((2, (r[1], r[2])), (1, r[1]), (0, None)):
            by[level][key].append(r[5])
    fits, out = {}, []
    for doc_id, lang, source, c, failed, x in rows:
        level, key = next(((le, k) for le, k in ((2, (lang, source)), (1, lang), (0, None)) if len(by[le][k]) >= least), (0, None))
        far = None
        if len(passed) >= least and by[level][key]:
            if (level, key) not in fits:
                fits[level, key] = estimate(np.array(by[level][key]))
            centre, cov = fits[level, key]
            d = np.array(x) - centre
            far = float(d @ np.linalg.inv(cov) @ d) * 1 / CONSISTENCY
        out.append((doc_id, *c, failed, not failed and (far is None or far <= CUTOFF), far))
    return out


def same(df, want):
    assert df.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    got = sorted(map(tuple, df.collect()), key=str)
    want = sorted(want, key=str)
    assert [g[:8] for g in got] == [w[:8] for w in want]
    by_got, by_want = sorted(got, key=lambda r: (str(r[:8]), r[8] or 0)), sorted(want, key=lambda r: (str(r[:8]), r[8] or 0))
    for g, w in zip(by_got, by_want):
        assert (g[8] is None) == (w[8] is None) and (g[8] is None or math.isclose(g[8], w[8], rel_tol=1e-6, abs_tol=1e-6))


def invented(n, seed, lang, source):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 8))) for _ in range(int(draw.lognormvariate(5.2, 0.6)) + 50)]
        if i % 10 == 0:
            words = [w + "###" for w in words]
        if i % 13 == 0:
            words[10:30] = words[40:60] = ["again"] * 20
        text = "".join(w + ("\n" if j % 17 == 16 else " ") for j, w in enumerate(words))
        out.append((seed * 10_000 + i, text + ("\nsame line\nsame line" if i % 9 == 0 else ""), lang, source, len(text)))
    return out


def test_outliers_against_brute_force(spark):
    """A large source, two small ones judged by their language, a language judged by all, nulls."""
    table = invented(150, 1, "en", "a") + invented(30, 2, "en", "b") + invented(25, 3, None, None) + invented(20, 4, "de", "b") + list(ODD)
    want = brute(table, 60)
    assert {r[7] for r in want if not r[6]} == {True, False}
    assert all(not r[7] for r in want if r[3] > r[1])  # texts full of symbols go
    docs = clashing(spark.createDataFrame(table, DOCS)).withColumn("words", outliers.F.lit("x"))
    same(outliers.judged(docs, 60), want)


def test_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    same(outliers.judged(docs), brute([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()], outliers.LEAST_ROWS))


def test_long_odd_and_no_texts(spark):
    long = [(1, "ab cd ef\n" * 100_000, "en", "a", 1), (2, " ".join(f"w{i}" for i in range(300_000)), "en", "a", 1), (3, "x" * 500_000, "en", "a", 1)]
    same(outliers.judged(spark.createDataFrame(long, DOCS)), brute(long, outliers.LEAST_ROWS))
    same(outliers.judged(odd(spark)), brute(ODD, outliers.LEAST_ROWS))
    assert outliers.judged(empty(spark)).collect() == []


def test_equal_texts_leave_a_regular_matrix(spark):
    """Statistics that never change, and one text unlike all others."""
    plain = " ".join(f"word{i % 60:02d}{i}" for i in range(100))
    table = [(i, plain, "en", "a", 1) for i in range(150)] + [(999, plain.replace(" ", "|| "), "en", "a", 1)]
    got = {r.doc_id: r.kept for r in outliers.judged(spark.createDataFrame(table, DOCS)).collect()}
    assert not got.pop(999) and all(got.values())


def test_chi_square():
    assert math.isclose(outliers.quantile(0.95, 5), 11.0705, abs_tol=1e-3)
    assert math.isclose(outliers.chi_square(6.626, 5), 0.75, abs_tol=1e-3)
