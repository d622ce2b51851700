"""Prediction by partial matching against a trie of dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardline.llm import ppm
from .helpers import DATA, clashing, empty, odd, rows


class Trie:
    """Counts of every context up to ppm.ORDER bytes, symbol by symbol."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for text in texts:
            raw = bytes([10]) * ppm.ORDER + text + b"\n"
            for i in range(ppm.ORDER, len(raw)):
                for k in range(ppm.ORDER + 1):
                    self.after[raw[i - k : i]][raw[i]] += 1

    def probability(self, context, symbol):
        p, out = 1.0, set()
        for k in range(len(context), -1, -1):
            seen = {s: n for s, n in self.after.get(context[len(context) - k :], {}).items() if s not in out}
            if seen:
                room = sum(seen.values()) + len(seen)
                if symbol in seen:
                    return p * seen[symbol] / room
                p *= len(seen) / room
                out |= set(seen)
        return p / (256 - len(out))

    def score(self, text):
        raw = bytes([10]) * ppm.ORDER + text + b"\n"
        return sum(math.log10(self.probability(raw[i - ppm.ORDER : i], raw[i])) for i in range(ppm.ORDER, len(raw)))


def brute(table):
    held = {i: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for i, r in enumerate(table)}
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) + [None] for r in table]
    counts = Counter(w for i, ws in enumerate(words) if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    texts = [" ".join(ws[:-1]).encode() for ws in words]
    trie = Trie([t for i, t in enumerate(texts) if not held[i]])
    for i, ws in enumerate(words):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        yield table[i][0], held[i], len(ws), sum(counts[w] > 0 for w in ws), n, base, trie.score(texts[i])


def compare(table, got):
    want = sorted(brute(table), key=lambda r: (str(r[0]), r[5]))
    got = sorted(map(tuple, got), key=lambda r: (str(r[0]), r[5]))
    assert [r[:5] for r in want] == [r[:5] for r in got]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("block_bytes", [1 << 25, 700])
def test_scores(spark, block_bytes):
    docs = odd(spark)
    compare(rows(docs.select("doc_id", "text")), rows(ppm.scores(clashing(docs), block_bytes)))


def test_scores_of_data(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 60")
    compare(rows(docs.select("doc_id", "text")), rows(ppm.scores(docs, 20_000)))


def test_scores_of_nothing_and_without_training(spark):
    assert ppm.scores(empty(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    table = [(held, "ab c")]
    got = rows(ppm.scores(spark.createDataFrame(table, "doc_id long, text string")))
    compare(table, got)
    assert got[0][6] == pytest.approx(-5 * math.log10(256))


def test_probabilities_sum_to_one():
    trie = Trie([b"abracadabra", b"abra cab", b"xyz"])
    for context in (b"cabra", b"qqqqq", b"racab", b"\n\n\nxy"):
        assert sum(trie.probability(context, s) for s in range(256)) == pytest.approx(1)


def test_better_than_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = [r for r in ppm.scores(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
