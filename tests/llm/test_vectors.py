"""Product codes and hard negatives against brute force in whole numbers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from wardline.llm import codes, negatives
from wardline.llm.vectors import MOST

SCHEMA = "vec_id long, embedding array<float>, label int, score int, v string, rid int"


def whole(vector, scale):
    """The integers of a vector, or None if it takes no part."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [max(-MOST, min(MOST, math.floor(float(np.float32(x)) * scale))) for x in vector]


def drawn(n, width, seed, labels=4):
    """Clustered vectors with ties, copies, nulls, odd lengths and huge components among them."""
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = draw.randrange(labels)
        out.append((i, [c + draw.gauss(0, 0.4) for c in centres[label]], label))
    same = [0.5] * width
    out += [(n + i, same, i % 3) for i in range(40)]  # many equal vectors
    out += [(100, same, 1), (100, same, 2), (200, *out[min(200, n - 1)][1:])]  # shared ids, an anchor that is there twice
    out += [(None, same, 1), (None, same, None), (n + 50, None, 1), (n + 51, [1.0, None], 2), (n + 52, [float("nan")] * width, 3), (n + 53, [float("inf")] * width, 3)]
    out += [(n + 54, same, None), (n + 55, [1.0] * (width - 3), 0), (n + 56, [], 0), (n + 57, [-1e30] + [0.0] * (width - 1), 0), (700, [0.0] * width, 1), (n + 58, [-0.01] * width, 2)]
    return out


def table(spark, data):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in data], SCHEMA)


def padded(data, scale, multiple=1):
    kept = [(i, v, label) for i, x, label in data if (v := whole(x, scale)) is not None]
    width = -(-max(len(v) for _, v, _ in kept) // multiple) * multiple
    return [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]


def brute_codes(data, rounds):
    rows = padded(data, 1024, 4)
    part = len(rows[0][1]) // 4
    raw = lambda v: np.array(v, "<i4").tobytes()
    first = sorted(((i is None, i or 0, raw(whole_v)), v) for (i, v, _), whole_v in zip(rows, [whole(x, 1024) for _, x, _ in data if whole(x, 1024) is not None]))[:256]
    books = [np.array([v[p * part : (p + 1) * part] for _, v in first], object) for p in range(4)]
    xs = [np.array([v[p * part : (p + 1) * part] for _, v, _ in rows], object) for p in range(4)]
    for step in range(rounds + 1):
        found, errors = [], [0] * len(rows)
        for p in range(4):
            best = []
            for n, x in enumerate(xs[p]):
                distance = ((books[p] - x) ** 2).sum(axis=1)
                best.append(min(range(len(distance)), key=lambda j: (distance[j], j)))
                errors[n] += distance[best[-1]]
            found.append(best)
        if step < rounds:
            for p in range(4):
                members = defaultdict(list)
                for n, j in enumerate(found[p]):
                    members[j].append(xs[p][n])
                for j, m in members.items():
                    books[p][j] = [int(sum(c)) // len(m) for c in zip(*m)]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(rows, errors):
        by_label[label] += e
    text = ",".join(str(c) for b in books for e in b for c in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted((str(i), "".join(f"{found[p][n]:02x}" for p in range(4)), int(errors[n]), int(by_label[label]), digest) for n, (i, _, label) in enumerate(rows))


def got_codes(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())


def test_codes_against_brute_force(spark):
    data = [r for r in drawn(500, 8, 3) if not (r[1] and len(r[1]) and abs(r[1][0] or 0) > 1e9)]
    assert got_codes(codes.compress(table(spark, data))) == brute_codes(data, codes.ROUNDS)


def test_codes_of_huge_components_and_few_rows(spark):
    data = [(i, [x * 1e5 for x in v], label) for i, v, label in drawn(30, 6, 4) if v and None not in v and math.isfinite(v[0])]
    assert got_codes(codes.compress(table(spark, data), rounds=2)) == brute_codes(data, 2)
    one = [(5, [0.25, -0.25, 1.0, 2.0, 3.0], None)]
    assert got_codes(codes.compress(table(spark, one))) == brute_codes(one, 4)


def test_codes_of_nothing(spark):
    assert codes.compress(table(spark, [])).collect() == []
    assert codes.compress(table(spark, [(1, None, 1), (2, [None], 1)])).collect() == []
    assert [tuple(r)[:4] for r in codes.compress(table(spark, [(1, [], 1)])).collect()] == [(1, "00000000", 0, 0)]


def test_exponion_scan_looks_at_few_entries_and_is_exact():
    draw = np.random.default_rng(5)
    entries = np.concatenate([draw.integers(-5, 5, (64, 8)) + 400 * draw.integers(-9, 9, 8) for _ in range(4)])
    book = codes.Codebook(entries)
    x = entries[draw.integers(0, 256, 3000)] + draw.integers(-4, 4, (3000, 8))
    want = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    for before in (np.zeros(3000, np.uint8), draw.integers(0, 256, 3000).astype(np.uint8), want.argmin(axis=1).astype(np.uint8)):
        found, least = book.search(x, before)
        assert (found == want.argmin(axis=1)).all() and (least == want.min(axis=1)).all()


def brute_negatives(data, every):
    rows = []
    for i, v, label in padded([r for r in data if r[2] is not None], 256):
        rows.append((i, v, int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label))
    out, last = [], lambda i: (i is None, i or 0)
    x = np.array([r[1] for r in rows], np.int64)
    for n, (anchor, _, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scores = x @ x[n]
        by_score = sorted(range(len(rows)), key=lambda m: (-scores[m], last(rows[m][0])))
        for p in [m for m in by_score if m != n and rows[m][2] == label][:5]:
            fit = [m for m in by_score if rows[m][2] != label and 80 * int(scores[p]) <= 100 * int(scores[m]) <= 100 * int(scores[p])][:5]
            out += [(anchor, rows[p][0], k, rows[m][0], int(scores[p]), int(scores[m])) for k, m in enumerate(fit, 1)]
    return sorted(out, key=str)


def got_negatives(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_negatives_against_brute_force(spark, monkeypatch):
    data = drawn(900, 12, 7)
    want = brute_negatives(data, 20)
    assert len(want) > 100 and got_negatives(negatives.mine(table(spark, data), 20)) == want
    # blocks of few anchors and rows, several to a task's stream
    monkeypatch.setattr(negatives, "ANCHORS_EACH", 7)
    monkeypatch.setattr(negatives, "LEAST_EACH", 150)
    assert got_negatives(negatives.mine(table(spark, data), 20)) == want


def test_negatives_of_ties_and_nothing(spark):
    same = [(i, [0.5, 0.5], i % 2) for i in range(1, 400)]
    assert got_negatives(negatives.mine(table(spark, same))) == brute_negatives(same, 100)
    for data in ([], [(100, None, 1)], [(100, [1.0], None)], [(1, [1.0], 1)], [(100, [], 1), (101, [], 2)], [(100, [1.0], 1)]):
        assert negatives.mine(table(spark, data)).collect() == []


def test_bounds_hold_and_most_rows_are_never_scored():
    draw = np.random.default_rng(2)
    x = np.floor(256 * draw.normal(0, 0.125, (4000, 32))).astype(np.int32)
    low, high = x.min(axis=0)[:, None], x.max(axis=0)[:, None]
    inner = np.floor(low + (high - low) * np.arange(1, negatives.CELLS) / negatives.CELLS)
    lows, highs = np.concatenate([low, inner + 1], axis=1).astype(np.int64), np.concatenate([inner, high], axis=1).astype(np.int64)
    codes_of = negatives.approximate(x, highs)
    lower, upper = negatives.bounds(codes_of, negatives.tables(x[:50].astype(np.int64), lows, highs))
    exact = x.astype(np.int64) @ x[:50].T.astype(np.int64)
    assert (lower <= exact).all() and (exact <= upper).all()
    fifth = np.sort(exact, axis=0)[-6]
    assert (upper >= fifth).mean() < 0.02
