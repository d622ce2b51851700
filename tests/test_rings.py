"""Quadtrees, overlay and repair of rings against ray casting, strips and exact areas."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.functions import geo
from wardline.operators import joins, quality, rings

RING = "area_id int, ring array<struct<x:double,y:double>>"


def corners(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def star(n, seed, x=0.0, y=0.0, size=1.0):
    """A ring of n corners around a point, rough, without crossings."""
    draw = np.random.default_rng(seed)
    at = np.sort(draw.uniform(0, 2 * np.pi, n))
    r = size * draw.uniform(0.4, 1.0, n)
    return [(x + a, y + b) for a, b in zip(r * np.cos(at), r * np.sin(at))]


def inside(points, ring):
    """Ray casting."""
    e = rings.edges_of(corners(ring))
    x, y = np.array(points).T
    out = np.zeros(len(points), bool)
    for x1, y1, x2, y2 in e.tolist():
        if y1 != y2:
            spans = (y1 > y) != (y2 > y)
            out ^= spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


@pytest.mark.parametrize("most", [32, 2])
def test_points_in_rings_as_by_ray_casting(spark, monkeypatch, most):
    monkeypatch.setattr(rings, "MOST_EDGES", most)
    draw = random.Random(6)
    shapes = [star(400, 1, 37, 55, 2), star(60, 2, 38, 55, 1), star(3, 3, 37, 56, 1), [(36, 54), (38, 54), (38, 56), (36, 56)], [(36, 54), (38, 56), (38, 54), (36, 56)], [(179, -1), (180, -1), (180, 1), (179, 1)], [(37, 55)] * 5]
    points = [(draw.uniform(34, 40), draw.uniform(52, 58)) for _ in range(600)] + [(36, 54), (37, 55), (38, 55), (37, 54), (36, 55), (179.5, 0.0)] + [(36 + i / 4, 54 + j / 4) for i in range(9) for j in range(9)]
    p = spark.createDataFrame([(i, y, float(x)) for i, (x, y) in enumerate((a, float(b)) for a, b in points)] + [(9999, None, 1.0), (9998, 99.0, 1.0)], "point_id int, lat double, lon double")
    a = spark.createDataFrame([(i, corners(s)) for i, s in enumerate(shapes)] + [(97, None), (98, corners([(1, 1)]))], RING).withColumn("name", F.lit("n"))
    want = {(i, k) for k, s in enumerate(shapes) for i in np.flatnonzero(inside(points, s)).tolist()}
    out = joins.points_in_rings(p, a)
    assert "ring" not in out.columns and "name" in out.columns
    rows = out.collect()
    assert {(r.point_id, r.area_id) for r in rows} == want and len(rows) == len(want) > 300
    exact = p.join(a, F.lit(True)).select("point_id", "area_id", geo.border_metres(F.col("ring"), F.col("lon"), F.col("lat")).alias("m"))
    metres = {(r.point_id, r.area_id): r.m for r in exact.collect()}
    assert all(math.isclose(r.border_m, metres[r.point_id, r.area_id], abs_tol=1e-6) for r in rows)


def test_a_ring_of_many_corners_has_small_leaves(spark):
    draw = np.random.default_rng(9)
    at = 2 * np.pi * np.linspace(0, 1, 100_000, endpoint=False) ** 1.5  # a coast, dense at one end
    r = 3 + np.sin(5 * at) + draw.uniform(0, 0.00002, len(at))
    ring = [(40 + a, 50 + b) for a, b in zip(r * np.cos(at), r * np.sin(at))]
    made = list(rings.leaves(rings.edges_of(corners(ring))))
    assert max(len(m[4]) for m in made) <= rings.MOST_EDGES and len(made) < 60_000
    levels = {m[0] for m in made}
    assert max(levels) - min(levels) > 5  # dense parts are cut finer
    points = draw.uniform([34, 44], [46, 56], (3000, 2))
    p = spark.createDataFrame([(i, float(y), float(x)) for i, (x, y) in enumerate(points)], "point_id int, lat double, lon double")
    a = spark.createDataFrame([(1, corners(ring))], RING)
    assert {r.point_id for r in joins.points_in_rings(p, a, border=False).collect()} == set(np.flatnonzero(inside(points, ring)).tolist())


def test_smallest_zone(spark):
    zones = spark.createDataFrame([(1, corners([(0, 0), (10, 0), (10, 10), (0, 10)])), (2, corners([(1, 1), (3, 1), (3, 3), (1, 3)])), (3, corners([(1, 1), (3, 1), (3, 3), (1, 3)]))], RING)
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 50.0, 5.0)], "point_id int, lat double, lon double")
    assert {r.point_id: r.area_id for r in joins.smallest_zone(points, zones).collect()} == {1: 2, 2: 1}


def by_grid(a, b=None, n=700):
    """Shared area by counting points."""
    both = np.array(a + (b or []))
    low, high = both.min(axis=0), both.max(axis=0)
    steps = [(np.arange(n) + 0.5) / n * (high[i] - low[i]) + low[i] for i in (0, 1)]
    points = np.stack(np.meshgrid(*steps), axis=-1).reshape(-1, 2)
    hit = inside(points, a) & (inside(points, b) if b else True)
    return hit.mean() * np.prod(high - low)


def area_of(a, b=None):
    return rings.shared_area(rings.edges_of(corners(a)), rings.edges_of(corners(b)) if b else None)


def test_overlay_of_rough_rings():
    for seed in range(6):
        a, b = star(40, seed), star(30, seed + 50, 0.4, 0.2)
        shared = area_of(a, b)
        assert math.isclose(shared, by_grid(a, b), abs_tol=0.02) and math.isclose(shared, area_of(b, a), rel_tol=1e-9)
        assert math.isclose(area_of(a, a), area_of(a), rel_tol=1e-9)
    square, beside = [(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 0), (2, 0), (2, 1), (1, 1)]
    assert area_of(square, beside) == 0 and area_of(square, square) == 1
    bow = [(0, 0), (2, 2), (2, 0), (0, 2)]
    assert area_of(bow) == 2 and area_of(bow, square) == 0.5


def test_overlay_of_ten_thousand_corners_takes_seconds():
    def coast(seed, x):
        at = 2 * np.pi * np.arange(10_000) / 10_000
        r = 1 + 0.3 * np.sin((5 + seed) * at) + np.random.default_rng(seed).uniform(0, 0.01, len(at))
        return list(zip((x + r * np.cos(at)).tolist(), (r * np.sin(at)).tolist()))

    a, b = coast(1, 0.0), coast(2, 0.3)
    began = time.time()
    shared = area_of(a, b)
    assert time.time() - began < 20
    assert math.isclose(shared, by_grid(a, b, 300), abs_tol=0.03)


def ring_area(r):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1])) / 2


def test_repair_keeps_the_even_odd_area_and_leaves_no_crossing():
    draw = random.Random(7)
    shapes = [[(draw.uniform(0, 1), draw.uniform(0, 1)) for _ in range(draw.randint(3, 25))] for _ in range(60)]
    shapes += [[(draw.randint(0, 4), draw.randint(0, 4)) for _ in range(draw.randint(3, 12))] for _ in range(200)]  # corners on sides, sides on sides
    for shape in shapes:
        e = rings.edges_of(corners(shape))
        made = rings.repaired(e)
        assert math.isclose(sum(map(ring_area, made)), rings.shared_area(e), abs_tol=1e-9), shape
        for r in made:
            assert not rings.crosses_itself(rings.edges_of(corners(r))) and len(set(r)) == len(r)


def test_repaired_areas(spark):
    square = [(0, 0), (0, 2), (2, 2), (2, 0)]
    shapes = [[(0, 0), (2, 2), (2, 0), (0, 2)], square, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (3, 1), (3, 3), (1, 3), (1, 1)], [(0, 0), (1, 1), (2, 2)]]
    df = spark.createDataFrame([(i, corners(s)) for i, s in enumerate(shapes)] + [(9, None)], RING)
    got = {r.area_id: (len(r.rings or []), r.area, r.changed) for r in quality.repaired(df).collect()}
    assert got == {0: (2, 2.0, True), 1: (1, 4.0, False), 2: (2, 12.0, False), 3: (0, 0.0, False), 9: (0, 0.0, False)}


def test_rings_of_one_file_are_repaired_by_many_tasks(spark):
    square = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0))]
    rows = [(i, square) for i in range(200)] + [(900, [*square, None]), (901, [*square, {"x": None, "y": 1.0}])]
    made = quality.repaired(spark.createDataFrame(rows, RING).coalesce(1)).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in made}) > 1
    assert {(r.area_id >= 900, len(r.rings), r.area, r.changed) for r in made} == {(False, 1, 4.0, False), (True, 0, 0.0, False)}


def test_points_at_one_position_are_looked_at_once(spark, monkeypatch):
    times = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def held(*_):
        times.add(1)
        return True

    monkeypatch.setattr(rings, "inside", lambda x, y: held.asNondeterministic()(x, y))
    points = spark.range(500).select(F.col("id").alias("point_id"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"))
    zone = spark.createDataFrame([(1, corners([(0, 0), (0, 2), (2, 2), (2, 0)]))], RING)
    assert joins.smallest_zone(points, zone).count() == 500 and times.value <= 3
