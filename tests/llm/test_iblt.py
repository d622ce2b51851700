"""Sketches against plain sets."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from wardline.llm import iblt
from .helpers import DATA, clashing, empty, odd, rows


def paragraphs(text):
    return {p for line in text.split("\n") for p in (re.split("(?<=[a-mA-M][.!?]) +", line) if len(line) > 300 else [line])}


def brute(table):
    """doc_id, text rows, without rows alike."""
    order = sorted(table, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (doc_id, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        own, new, far = (paragraphs(t) for t in (text, edited, other))
        yield doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(own & new) / len(own | new), len(own & far) / len(own | far)


def test_fingerprints_of_data(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = iblt.fingerprints(clashing(docs)).collect()
    want = {r[0]: r for r in brute(rows(docs.select("doc_id", "text")))}
    assert len(got) == len(want)
    for r in got:
        assert (r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == pytest.approx(want[r.doc_id])
    prints = dict((r.doc_id, r.fingerprint) for r in got)
    by_text = {}
    for doc_id, text in rows(docs.select("doc_id", "text")):
        assert by_text.setdefault(text, prints[doc_id]) == prints[doc_id]


def test_odd_rows(spark):
    docs = odd(spark).filter("doc_id IS NOT NULL")
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in iblt.fingerprints(docs).collect())
    want = sorted(brute(sorted(set(rows(docs.select("doc_id", "text"))), key=str)))
    want.insert([w[0] for w in want].index(7), next(w for w in want if w[0] == 7))  # a row that is there twice
    assert got == [pytest.approx(w) for w in want]
    assert iblt.fingerprints(odd(spark)).count() == odd(spark).count()
    assert iblt.fingerprints(empty(spark)).count() == 0
    (one,) = iblt.fingerprints(docs.filter("doc_id = 8")).collect()
    assert one.near_next == 1


@pytest.mark.parametrize("a,b", [(5, 0), (40, 40), (300, 10), (3000, 2990)])
def test_peeling_retries_until_it_recovers_all(spark, a, b):
    rows_ = spark.range(1).select(F.expr(f"transform(sequence(1, {a}), i -> xxhash64(i))").alias("a"), F.expr(f"transform(sequence(2, {b + 1}), i -> xxhash64(i))" if b else "array(1L)").alias("b"))
    rows_ = rows_.withColumns({"ca": F.expr(iblt._sketch("a", "0")), "cb": F.expr(iblt._sketch("b", "0"))})
    (r,) = rows_.select("a", "b", iblt.difference("a", "b", "ca", "cb").alias("d")).collect()
    assert sorted(r.d.mine) == sorted(set(r.a) - set(r.b)) and sorted(r.d.others) == sorted(set(r.b) - set(r.a))


def test_recovered_digests_are_those_that_differ(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter("doc_id IS NOT NULL")
    got = {r.doc_id: (r.only_here, r.only_edited) for r in iblt.fingerprints(docs).collect()}
    order = sorted(rows(docs), key=lambda r: -r[0])
    pairs = []
    for i, (doc_id, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        pairs.append((doc_id, text, text[: len(text) - len(text) // 3] + other[: len(text) // 3]))
    sets = spark.createDataFrame(pairs, "doc_id long, a string, b string").select("doc_id", iblt.digests("a").alias("a"), iblt.digests("b").alias("b")).collect()
    for r in sets:
        assert got[r.doc_id] == (sorted(set(r.a) - set(r.b)), sorted(set(r.b) - set(r.a)))
