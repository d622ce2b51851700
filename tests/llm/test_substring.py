"""Substring dedup against a dictionary of windows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wardline.llm import substring
from .helpers import DATA, clashing, empty, odd, rows


def brute(table, size=20):
    """A window goes if a smaller doc_id has it (none comes last), or the same text at an earlier start."""
    pages = [(i if i is not None else substring.LAST, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in table]
    first = {}
    for place, _, words in pages:
        for s in range(len(words) - size + 1):
            key = tuple(words[s : s + size])
            first[key] = min(first.get(key, place), place)
    out = []
    for place, doc_id, words in pages:
        gone, own = set(), set()
        for s in range(len(words) - size + 1):
            key = tuple(words[s : s + size])
            if first[key] < place or key in own:
                gone.update(range(s, s + size))
            own.add(key)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def made(seed):
    """Copies, passages, insertions and periodic texts over a small vocabulary."""
    draw = random.Random(seed)
    words = [f"w{i}" * draw.randint(1, 4) for i in range(400)]
    base = [[draw.choice(words) for _ in range(draw.randint(0, 300))] for _ in range(12)]
    passage = [draw.choice(words) for _ in range(70)]
    out = []
    for i in range(50):
        text = list(draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(text))
            text[at:at] = draw.choice([passage, passage[5:40], ["new"], words[:3] * 15, ["x"] * 45])
        if draw.random() < 0.3 and text:
            del text[draw.randrange(len(text))]
        out.append((i * 3, draw.choice([" ", "\n", "  "]).join(text)))
    out += [(1000 + i, " ".join(base[0][:20] + ["y"] * (i // 3)) if len(base[0]) >= 20 else "z " * 20) for i in range(9)]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("batches,filtered", [(1, True), (2, True), (7, True), (3, False)])
def test_made_texts(spark, batches, filtered):
    table = made(batches)
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert sorted(map(str, rows(substring.dedup(docs, batches, filtered)))) == sorted(map(str, brute(table)))


def test_whole_table_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert sorted(map(str, rows(substring.dedup(docs)))) == sorted(map(str, brute(rows(docs))))
    docs = odd(spark).select("doc_id", "text")
    assert sorted(map(str, rows(substring.dedup(clashing(docs))))) == sorted(map(str, brute(rows(docs))))
    assert substring.dedup(empty(spark)).count() == 0


def test_rows_that_share_their_place(spark):
    earlier, own, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    table = [(1, earlier), (None, earlier), (None, own), (None, other), (None, "b " + own), (None, own), (5, earlier), (5, other)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    for batches in (1, 2):
        assert sorted(map(str, rows(substring.dedup(docs, batches)))) == sorted(map(str, brute(table)))


def test_texts_of_one_id_take_nothing_from_each_other(spark):
    a, b, x = ([f"{c}{i}" for i in range(n)] for c, n in (("a", 40), ("b", 50), ("x", 7)))
    twice = a + x + a  # repeats itself
    table = [(1, " ".join(t)) for t in (a, x + a, a + x, twice, b + a[:30], b)] + [(None, " ".join(t)) for t in (b, x + b, b + b)] + [(1, " ".join(twice))]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    want = sorted(map(str, brute(table)))
    assert [r for r in brute(table) if r[0] == 1][1][2] == 0
    for batches, filtered in ((1, True), (2, True), (2, False)):
        assert sorted(map(str, rows(substring.dedup(docs, batches, filtered)))) == want


def test_a_failed_call_leaves_no_tables(spark, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(substring, "_recurring", lambda batches: 1 / 0)
    with pytest.raises(Exception, match="division|ZeroDivision"):
        substring.dedup(spark.createDataFrame(made(2), "doc_id long, text string"))
    assert {t.name for t in spark.catalog.listTables()} == before


def test_index_compacts_and_keeps_its_keys(spark, tmp_path):
    index = substring.FingerprintIndex(spark, str(tmp_path / "index"), most_runs=2)
    found = []
    for i in range(5):
        part = spark.range(10 * i, 10 * i + 20).selectExpr("id AS k1", "id * 7 AS k2", f"{i}L AS place", f"{i}L AS doc", "int(id) AS at", "1 AS span", "false AS again", "array(1L) AS cells")
        found.append(index.merge(part)[0].count())
    assert found == [0, 10, 10, 10, 10]
    assert len(index.runs) <= 2 and index.history().count() == 60
    again = substring.FingerprintIndex(spark, str(tmp_path / "index"))
    assert len(again.runs) == len(index.runs) and sorted(rows(again.history())) == sorted(rows(index.history()))
    index.close()
    again.close()


def test_runs_are_merged_where_they_lie(spark, tmp_path):
    index = substring.FingerprintIndex(spark, str(tmp_path / "index"))
    part = spark.range(1000).selectExpr("id AS k1", "id AS k2", "id AS place", "id AS doc", "1 AS at", "1 AS span", "false AS again", "array(1L) AS cells")
    index.merge(part)
    past = index.history().withColumnsRenamed({"k1": "past", "k2": "past2"})
    joined = part.repartition(index.buckets, "k1").join(past.hint("merge"), F.col("k1") == F.col("past"), "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan  # the batch is dealt, the run is not
    index.close()


def test_an_index_is_opened_again(spark, tmp_path):
    table = sorted(made(5))
    early, late = table[:25], table[25:]
    docs = [spark.createDataFrame(t, "doc_id long, text string") for t in (early, late)]
    got = []
    for part in docs:  # each call opens the folder anew
        index = substring.FingerprintIndex(spark, str(tmp_path / "index"))
        got += rows(substring.dedup(part, 2, index=index))
        index.close()
    assert sorted(map(str, got)) == sorted(map(str, brute(table)))
