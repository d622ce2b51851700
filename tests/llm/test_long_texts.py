"""Operators on texts of millions of characters beside short ones: they are read whole and change no other row's result."""

import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardline.llm import exact, iblt, mixing, packing, ppm, simhash, toxicity

LONG = " ".join(f"word{i * i % 9973}" for i in range(250_000))  # 2.2 million characters
ONE_WORD = "x" * 1_500_000
TABLE = [(1, LONG), (2, LONG + " more"), (3, ONE_WORD), (4, "a short text of few words"), (5, ONE_WORD + " "), (6, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None) for i, t in TABLE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mixing(docs):
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in TABLE}
    got = {r.doc_id: r for r in mixing.shares(docs).collect()}
    assert {i: r["size"] for i, r in got.items()} == sizes and all(r.source_size == sum(sizes.values()) for r in got.values())
    assert abs(sum(r.taken for r in got.values()) - got[1].target) <= max(sizes.values())


def test_fingerprints(docs):
    got = {r.doc_id: r for r in iblt.fingerprints(docs).collect()}
    order = sorted(TABLE, key=lambda r: -r[0])
    for k, (i, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256((text[: len(text) - cut] + other[:cut]).encode()).hexdigest()


def test_exact_groups(docs):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.groups(docs).collect()}
    assert got == {1: (1, 1, True), 2: (2, 1, True), 3: (5, 2, False), 4: (4, 1, True), 5: (5, 2, True), 6: (6, 1, True)}


def test_simhash(docs):
    got = {r.doc_id: r for r in simhash.clusters(docs).collect()}
    assert got[2].component_id == 1 and got[5].component_id == 3 and got[3].fingerprint == got[5].fingerprint
    assert {r.doc_id for r in simhash.dedup(docs).collect()} == {1, 3, 4, 6}


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scores(docs, labels).collect()}
    assert len(got) == 6 and all(0 <= s <= 1 for s in got.values())


def test_packing(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in TABLE}
    pieces = packing.pack(docs).collect()
    got: dict = {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and all(r.length == 2048 for r in pieces if (r.doc_id, r.start + r.length) not in want.items())


def test_scores(docs):
    got = {r.doc_id: r for r in ppm.scores(docs, 100_000).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len((t or "").split()) + 1 for i, t in TABLE}
    assert got[3].score == pytest.approx(got[5].score) and abs(got[2].score - got[1].score) < 50 and got[1].score < -1e5
