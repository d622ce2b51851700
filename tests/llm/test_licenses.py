"""License scans against a plain search and planted notices."""

import random

import numpy as np

from wardline.llm import licenses
from .helpers import DATA, clashing, empty, odd, rows


def plain(text, template):
    clean = lambda t: " ".join(t.encode().translate(licenses._WORDS).decode().split())
    return f" {clean(template)} " in f" {clean(text)} "


def test_exact_notices_of_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(r.doc_id, r.license) for r in licenses.matches(docs).collect() if r.coverage == 1}
    want = {(i, name) for i, text in rows(docs.select("doc_id", "text")) for name, t in licenses.TEMPLATES.items() if plain(text, t)}
    assert want and found == want
    texts = dict(rows(docs.select("doc_id", "text")))
    for r in licenses.matches(docs).collect():
        assert plain(texts[r.doc_id][r.span_start : r.span_end], licenses.TEMPLATES[r.license].split()[0] if r.coverage < 1 else licenses.TEMPLATES[r.license])


def test_edited_notice_is_covered_in_part():
    draw = random.Random(3)
    words = licenses.TEMPLATES["mit-text"].split()
    for _ in range(30):
        edited = list(words)
        for _ in range(5):
            at = draw.randrange(len(edited))
            edited[at : at + 1] = draw.choice([[], ["changed"], [edited[at], "added"]])
        text = "Ünï 😀 " * draw.randint(0, 9) + " ".join(edited) + " and the rest" * draw.randint(0, 9)
        index = licenses.Index(licenses.TEMPLATES)
        hit = [m for m in licenses.scan(text.encode(), index) if m[0] == "mit-text"]
        assert len(hit) == 1 and hit[0][2] > 0.88


def test_alignment_counts_words_in_order():
    draw = random.Random(4)
    for _ in range(100):
        template = np.array([draw.randrange(50) for _ in range(30)], np.uint64)
        words = list(template)
        for _ in range(3):
            words.pop(draw.randrange(len(words)))
        body = np.array([99] * 10 + words + [98] * 10, np.uint64)
        matched, first, last = licenses.align(template, body, 10, 10)
        assert matched >= 24 and 10 <= first and last < 10 + len(words)


def test_repeats_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "All rights reserved. x All rights reserved."), (2, None), (3, "all RIGHTS\n\nreserved"), (None, "All rights reserved")], "doc_id long, text string")
    assert sorted(map(str, rows(licenses.matches(clashing(docs)).select("doc_id", "span_start", "span_end")))) == sorted(map(str, [(1, 0, 19), (1, 23, 42), (3, 0, 20), (None, 0, 19)]))
    assert licenses.matches(odd(spark)).count() == licenses.matches(empty(spark)).count() == 0
    long = "lorem ipsum " * 50_000 + "Released under the MIT License. " * 300
    assert licenses.matches(spark.createDataFrame([(1, long)], "doc_id long, text string")).count() == 300


def full_alignment(template, words):
    """The same local alignment over the whole table, with the same choice among equals."""
    m, n = len(template), len(words)
    h = np.zeros((m + 1, n + 1), int)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if template[i - 1] == words[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    best = h.max()
    i, j = min(((i, j) for i, j in np.argwhere(h == best)), key=lambda p: (p[0], p[1]))
    matched, first, last = 0, j - 1, j - 1
    while h[i, j] > 0:
        equal = template[i - 1] == words[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (2 if equal else -1):
            matched, first, i, j = matched + equal, j - 1 if equal else first, i - 1, j - 1
        elif h[i, j] == h[i, j - 1] - 1:
            j -= 1
        else:
            i -= 1
    return matched, first, last


def test_coverage_and_spans_against_full_alignment():
    draw = random.Random(6)
    index = licenses.Index({"notice": " ".join(f"t{i}" for i in range(60))})
    for _ in range(60):
        words = [f"t{i}" for i in range(60)]
        for _ in range(draw.randint(0, 5)):  # spread edits, each within the band
            at = draw.randrange(len(words))
            words[at : at + 1] = draw.choice([[], ["new"], [words[at], "more"]])
        before, after = ([f"{c}{i}" for i in range(draw.randint(0, 20))] for c in "xy")
        text = " ".join(before + words + after)
        (hit,) = licenses.scan(text.encode(), index, 0.5)
        matched, first, last = full_alignment([f"t{i}" for i in range(60)], before + words + after)
        spans = np.cumsum([0, *(len(w) + 1 for w in before + words + after)])
        assert hit == ("notice", matched, matched / 60, spans[first], spans[last + 1] - 1)
