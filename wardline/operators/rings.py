"""Work on single rings inside tasks: quadtree leaves, border cells, overlay by strips, repair.

A ring is a row; a plane is only ever cut as finely as its own edges ask for. Functions on
arrays stand first, what applies them to columns last.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The square that quadtrees halve, a little off whole numbers, so that borders of cells miss corners given in round figures.
WEST, SOUTH, WIDE = -180.0137218, -180.0091743, 360.0371429
MOST_EDGES, DEEPEST = 32, 30
#: Side of the cells by which a border is found that is no farther than it.
NEAR = 0.1


def edges_of(ring: list[dict]) -> np.ndarray:
    """x1, y1, x2, y2 of each side; the ring is closed."""
    p = np.array([(c["x"], c["y"]) for c in ring], float).reshape(len(ring), 2)
    return np.concatenate([p, np.roll(p, -1, axis=0)], axis=1)


def side(level: int) -> float:
    return WIDE / (1 << level)


def touching(e: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Which edges meet a box, its border included."""
    boxes = (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y0)
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    sides = np.stack([dx * (y - e[:, 1]) - dy * (x - e[:, 0]) for x in (x0, x1) for y in (y0, y1)])
    slack = 1e-12 * (np.abs(dx) + np.abs(dy)) * (abs(x1 - x0) + 1e-6)
    return boxes & ~((sides > slack).all(axis=0) | (sides < -slack).all(axis=0))


def across(e: np.ndarray, x: float, low: float, high: float) -> int:
    """Edges that cross the vertical at x between low and high."""
    e = e[(e[:, 0] > x) != (e[:, 2] > x)]
    y = (e[:, 3] - e[:, 1]) * (x - e[:, 0]) / (e[:, 2] - e[:, 0]) + e[:, 1]
    return int(((y > low) & (y < high)).sum())


def along(e: np.ndarray, y: float, low: float, high: float) -> int:
    """Edges that cross the horizontal at y between low and high."""
    return across(e[:, [1, 0, 3, 2]], y, low, high)


def leaves(e: np.ndarray) -> Iterator[tuple]:
    """level, cx, cy, odd, edges: the cells of a ring's quadtree that are inside it or hold edges, MOST_EDGES at most.

    odd tells whether the lower right corner of the cell is inside.
    """
    low, high = np.minimum(e[:, :2], e[:, 2:]).min(axis=0), np.maximum(e[:, :2], e[:, 2:]).max(axis=0)
    level = DEEPEST
    at = lambda v, k: (int((v[0] - WEST) // side(k)), int((v[1] - SOUTH) // side(k)))
    while level and at(low, level) != at(high, level):
        level -= 1
    stack = [(level, *at(low, level), False, e)]
    while stack:
        level, cx, cy, odd, own = stack.pop()
        if len(own) <= MOST_EDGES or level == DEEPEST:
            if len(own) or odd:
                yield level, cx, cy, odd, own
            continue
        half = side(level + 1)
        x = [WEST + half * (2 * cx + i) for i in range(3)]
        y = [SOUTH + half * (2 * cy + i) for i in range(3)]
        lower_left = odd ^ bool(along(own, y[0], x[1], x[2]) & 1)
        corners = {(1, 0): odd, (0, 0): lower_left, (1, 1): odd ^ bool(across(own, x[2], y[0], y[1]) & 1), (0, 1): lower_left ^ bool(across(own, x[1], y[0], y[1]) & 1)}
        for (i, j), odd_there in corners.items():
            stack.append((level + 1, 2 * cx + i, 2 * cy + j, odd_there, own[touching(own, x[i], y[j], x[i + 1], y[j + 1])]))


def border_cells(e: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """Cells of NEAR degrees with the edges that may be no farther than NEAR from a point in them."""
    out = defaultdict(list)
    for n, (x1, y1, x2, y2) in enumerate(e.tolist()):
        if y1 > y2:
            x1, y1, x2, y2 = x2, y2, x1, y1
        for cy in range(int((y1 - NEAR) // NEAR), int((y2 + NEAR) // NEAR) + 1):
            # where the edge is within NEAR of this row's heights
            ends = [x1, x2] if y2 == y1 else [x1 + (x2 - x1) * min(1.0, max(0.0, (y - y1) / (y2 - y1))) for y in (cy * NEAR - NEAR, (cy + 2) * NEAR)]
            for cx in range(int((min(ends) - NEAR) // NEAR), int((max(ends) + NEAR) // NEAR) + 1):
                out[cx, cy].append(n)
    return out


def slabs(e: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges with the corners between which they are looked at together: of edges and strips between corners, most at a time."""
    cuts = np.unique(e[:, [0, 2]])
    change = np.zeros(len(cuts), np.int64)
    np.add.at(change, np.searchsorted(cuts, np.minimum(e[:, 0], e[:, 2])), 1)
    np.subtract.at(change, np.searchsorted(cuts, np.maximum(e[:, 0], e[:, 2])), 1)
    upto = np.cumsum(np.cumsum(change))
    begin = 0
    while begin < len(cuts) - 1:
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most)))
        part = cuts[begin : end + 1]
        yield e[(np.minimum(e[:, 0], e[:, 2]) < part[-1]) & (np.maximum(e[:, 0], e[:, 2]) > part[0])], part
        begin = min(end, len(cuts) - 1)


def strips(e: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cuts, strip, edge, y at the left, y at the right: edges in vertical strips inside which none cross, in the order of height.

    Where neighbours in the order of their middles have another order at one end of a strip
    they cross, and the strip is cut there, until no two do.
    """
    turned = e[:, 0] > e[:, 2]
    e = np.where(turned[:, None], e[:, [2, 3, 0, 1]], e)
    eps = 1e-13 * max(np.abs(e).max(initial=0.0), 1e-300)
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0]) if len(e) else np.zeros(0)
    while True:
        first, last = np.searchsorted(cuts, e[:, 0]), np.minimum(np.searchsorted(cuts, e[:, 2]), len(cuts) - 1)
        n = last - first
        edge = np.repeat(np.arange(len(e)), n)
        strip = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        left, right = cuts[strip], cuts[strip + 1]
        yl, yr = (e[edge, 1] + slope[edge] * (x - e[edge, 0]) for x in (left, right))
        yl, yr = np.where(left == e[edge, 0], e[edge, 1], yl), np.where(right == e[edge, 2], e[edge, 3], yr)
        order = np.lexsort((yl + yr, strip))
        edge, strip, yl, yr = edge[order], strip[order], yl[order], yr[order]
        # neighbours by their middles, in another order at one of the ends
        dl, dr = yl[1:] - yl[:-1], yr[1:] - yr[:-1]
        at = np.flatnonzero((strip[1:] == strip[:-1]) & ((dl < -eps) & (dr > eps) | (dl > eps) & (dr < -eps)))
        share = dl[at] / (dl[at] - dr[at])
        low, high = cuts[strip[at]], cuts[strip[at] + 1]
        new = low + share * (high - low)
        grown = np.union1d(cuts, new[(new - low > eps) & (high - new > eps)])
        if len(grown) == len(cuts):
            return cuts, strip, edge, yl, yr
        cuts = grown


def shared_area(a: np.ndarray, b: np.ndarray | None = None) -> float:
    """Area that two rings share, or that a single one holds, an even-odd count of its sides telling what is inside."""
    both = a if b is None else np.concatenate([a, b])
    if b is not None:
        low, high = np.max([r[:, :2].min(axis=0) for r in (a, b)], axis=0), np.min([r[:, :2].max(axis=0) for r in (a, b)], axis=0)
        if (low >= high).any():
            return 0.0
    numbered = np.column_stack([both, np.repeat([0, 1], [len(a), len(both) - len(a)])])
    total = 0.0
    for e, part in slabs(numbered[both[:, 0] != both[:, 2]]):
        cuts, strip, edge, yl, yr = strips(e[:, :4], part)
        middle, owner = (yl + yr) / 2, e[edge, 4]
        # each strip holds an even number of sides of each ring, so counts over all strips have the parity of the strip's own
        inside = (np.cumsum(owner == 0) % 2 == 1) & ((np.cumsum(owner == 1) % 2 == 1) if b is not None else True)
        heights = np.where(inside[:-1] & (strip[1:] == strip[:-1]), middle[1:] - middle[:-1], 0.0)
        total += float((heights * (cuts[strip[:-1] + 1] - cuts[strip[:-1]])).sum())
    return total


def crossings(e: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of edges whose boxes meet; swept from left to right."""
    x1, x2 = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    y1, y2 = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    active: np.ndarray = np.zeros(0, int)
    for i in np.argsort(x1, kind="stable"):
        active = active[x2[active] >= x1[i]]
        for j in active[(y1[active] <= y2[i]) & (y2[active] >= y1[i])]:
            yield int(j), int(i)
        active = np.append(active, i)


def crosses_itself(e: np.ndarray) -> bool:
    """Whether two sides that don't follow each other cross properly."""

    for i, j in crossings(e):
        (a, b), (c, d) = (((r[0], r[1]), (r[2], r[3])) for r in (e[i].tolist(), e[j].tolist()))
        if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
            return True
    return False


def turn(p: tuple, q: tuple, r: tuple) -> float | Fraction:
    """Above 0 if p, q, r turn left, 0 if they lie on a line; exact where rounding could tell otherwise."""
    left, right = (q[0] - p[0]) * (r[1] - p[1]), (q[1] - p[1]) * (r[0] - p[0])
    if abs(left - right) > 1e-14 * (abs(left) + abs(right)):
        return left - right
    (px, py), (qx, qy), (rx, ry) = ((Fraction(x), Fraction(y)) for x, y in (p, q, r))
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def pieces(e: np.ndarray) -> list[tuple]:
    """The sides of a ring cut where they meet: (p, q) once for each piece that an odd number of sides cover.

    Where sides meet is worked out in fractions, so sides through one point are cut in one.
    """
    sides = [((x1, y1), (x2, y2)) for x1, y1, x2, y2 in e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])].tolist()]
    on: list[set] = [set(s) for s in sides]
    within = lambda p, s: min(s[0][0], s[1][0]) <= p[0] <= max(s[0][0], s[1][0]) and min(s[0][1], s[1][1]) <= p[1] <= max(s[0][1], s[1][1])
    for i, j in crossings(np.array([(*p, *q) for p, q in sides]).reshape(-1, 4)):
        (a, b), (c, d) = sides[i], sides[j]
        at_a, at_b, at_c, at_d = turn(c, d, a), turn(c, d, b), turn(a, b, c), turn(a, b, d)
        for value, p, k in ((at_c, c, i), (at_d, d, i), (at_a, a, j), (at_b, b, j)):
            if value == 0 and within(p, sides[k]):
                on[k].add(p)
        if (at_a > 0) != (at_b > 0) and (at_c > 0) != (at_d > 0) and 0 not in (at_a, at_b, at_c, at_d):
            (ax, ay), (bx, by), (cx, cy), (dx, dy) = ((Fraction(x), Fraction(y)) for x, y in (a, b, c, d))
            u, v = (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx), (dx - cx) * (by - cy) - (dy - cy) * (bx - cx)
            met = (ax + u / (u - v) * (bx - ax), ay + u / (u - v) * (by - ay))
            on[i].add(met)
            on[j].add(met)
    count: dict[tuple, int] = defaultdict(int)
    for ((x1, y1), (x2, y2)), points in zip(sides, on):
        dx, dy = Fraction(x2) - Fraction(x1), Fraction(y2) - Fraction(y1)
        in_order = sorted(points, key=lambda p: Fraction(p[0]) * dx + Fraction(p[1]) * dy)
        for p, q in zip(in_order, in_order[1:]):
            count[min(p, q), max(p, q)] += 1
    floats = {p: (float(p[0]), float(p[1])) for points in on for p in points}
    return [(floats[p], floats[q]) for (p, q), n in count.items() if n % 2 and floats[p] != floats[q]]


def repaired(e: np.ndarray) -> list[list[tuple[float, float]]]:
    """Rings of the even-odd area of a ring that may cross itself: outer ones turn left, holes right, none crosses itself.

    The pieces between crossings are turned so that the inside is at their left and walked
    around face by face.
    """
    cut = pieces(e)
    if not cut:
        return []
    s = np.array([(*p, *q) for p, q in cut])
    turned = []
    for k, (x1, y1, x2, y2) in enumerate(s.tolist()):
        flat = abs(y2 - y1) < abs(x2 - x1)
        t, (u1, v1, u2, v2) = (s[:, [1, 0, 3, 2]], (y1, x1, y2, x2)) if flat else (s, (x1, y1, x2, y2))
        v = (v1 + v2) / 2
        hit = (t[:, 1] > v) != (t[:, 3] > v)
        hit[k] = False
        h = t[hit]
        u = (h[:, 2] - h[:, 0]) * (v - h[:, 1]) / (h[:, 3] - h[:, 1]) + h[:, 0]
        beyond = int((u > (u1 + u2) / 2).sum()) % 2 == 1  # inside at the larger u
        # going up in v the larger u is at the right; in turned axes at the left
        up = (v2 > v1) == (beyond == flat)
        turned.append(cut[k] if up else cut[k][::-1])
    leaving = defaultdict(list)
    for p, q in turned:
        leaving[p].append(q)
    angle = lambda p, q: np.arctan2(q[1] - p[1], q[0] - p[0])
    out = []
    for start in turned:
        p, q = start
        if q not in leaving[p]:
            continue
        leaving[p].remove(q)
        ring = [p]
        while q != ring[0] and leaving[q]:
            back = angle(q, p)
            # the face at the left goes on with the first piece clockwise of the way back
            nxt = min(leaving[q], key=lambda r: (back - angle(q, r)) % (2 * np.pi) or 2 * np.pi)
            leaving[q].remove(nxt)
            ring.append(q)
            p, q = q, nxt
        if len(ring) > 2:
            out.append(ring)
    return [r for part in out for r in untangled(part)]


def untangled(ring: list[tuple]) -> list[list[tuple]]:
    """A ring that passes a corner twice, as rings that pass each once."""
    out, path, at = [], [], {}
    for p in ring:
        if p in at:
            k = at[p]
            out.append(path[k:])
            for gone in path[k + 1 :]:
                del at[gone]
            path = path[: k + 1]
        else:
            at[p] = len(path)
            path.append(p)
    return [r for r in [*out, path] if len(r) > 2]


_RING = pa.list_(pa.struct([(c, pa.float64()) for c in ("x", "y")]))
_EDGES = pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]))
EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _rows(edges: Iterable[np.ndarray]) -> pa.Array:
    parts = [np.asarray(e, float).reshape(-1, 4) for e in edges]
    flat = np.concatenate(parts) if parts else np.zeros((0, 4))
    ends = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(4)], ["x1", "y1", "x2", "y2"]))


def _each(batches: Iterable[pa.RecordBatch], most: int = 2000) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            ring = b.column("ring")[i].as_py()
            if ring and len(ring) > 2 and all(p and p["x"] is not None and p["y"] is not None for p in ring):
                yield b.column("area_id").slice(i, 1), edges_of(ring)


def _leaf_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for area, e in _each(batches):
        made = list(leaves(e))
        for at in range(0, len(made), 4000):
            level, cx, cy, odd, edges = zip(*made[at : at + 4000])
            ids = area.take(pa.array(np.zeros(len(level), int)))
            yield pa.record_batch([ids, pa.array(level, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(odd), _rows(edges)], names=["area_id", "level", "cx", "cy", "odd", "edges"])


def _border_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for area, e in _each(batches):
        made = list(border_cells(e).items())
        for at in range(0, len(made), 4000):
            keys, edges = zip(*made[at : at + 4000])
            ids = area.take(pa.array(np.zeros(len(keys), int)))
            yield pa.record_batch([ids, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), _rows(e[i] for i in edges)], names=["area_id", "bx", "by", "near"])


def _rebuilt_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = b.column("ring")
        x, y = (column.values.field(c).cast(pa.float64()) for c in ("x", "y"))
        corners = np.column_stack([v.to_numpy(zero_copy_only=False) for v in (x, y)])
        whole = np.logical_and.reduce([v.is_valid().to_numpy(zero_copy_only=False) for v in (column.values, x, y)])
        ends, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
        # many areas may have one ring; each ring of a batch is worked on once
        nth: dict[bytes, int] = {}
        made, changed, of = [], [], np.zeros(b.num_rows, np.int64)
        for i, (begin, end) in enumerate(zip(ends[:-1], ends[1:])):
            p = corners[begin:end] if there[i] and end - begin > 2 and whole[begin:end].all() else corners[:0]
            of[i] = nth.setdefault(p.tobytes(), len(made))
            if of[i] == len(made):
                e = np.concatenate([p, np.roll(p, -1, axis=0)], axis=1)
                made.append([[{"x": u, "y": v} for u, v in r] for r in repaired(e)] if len(p) else [])
                changed.append(len(p) > 3 and crosses_itself(e))
        rows = pa.array(of)
        yield pa.record_batch([b.column("area_id"), pa.array(made, pa.list_(_RING)).take(rows), pa.array(changed, pa.bool_()).take(rows)], names=["area_id", "rings", "changed"])


def rebuilt(areas: DataFrame) -> DataFrame:
    """area_id, rings, changed: each ring as rings that don't cross themselves, and whether it crossed itself."""
    kind = areas.schema["area_id"].dataType.simpleString()
    return areas.select("area_id", "ring").mapInArrow(_rebuilt_rows, f"area_id {kind}, rings array<array<struct<x:double,y:double>>>, changed boolean")


def quadtrees(areas: DataFrame) -> DataFrame:
    """area_id, level, cx, cy, odd, edges of areas (area_id, ring); rings that are null or have null corners have none."""
    kind = areas.schema["area_id"].dataType.simpleString()
    return areas.select("area_id", "ring").mapInArrow(_leaf_rows, f"area_id {kind}, level int, cx long, cy long, odd boolean, edges {EDGES}")


def borders(areas: DataFrame) -> DataFrame:
    """area_id, bx, by, near: by cells of NEAR degrees the edges near them."""
    kind = areas.schema["area_id"].dataType.simpleString()
    return areas.select("area_id", "ring").mapInArrow(_border_rows, f"area_id {kind}, bx long, by long, near {EDGES}")


def cell_of(v: Column, level: Column, begin: float) -> Column:
    return F.floor((v - begin) / (F.lit(WIDE) / F.pow(F.lit(2.0), level))).cast("long")


def inside(x: Column, y: Column) -> Column:
    """Whether a point is inside, from its leaf: a walk from the cell's corner up its right border, then left to the point."""
    wide = F.lit(WIDE) / F.pow(F.lit(2.0), F.col("level"))
    right, low = F.lit(WEST) + wide * (F.col("cx") + 1), F.lit(SOUTH) + wide * F.col("cy")

    def met(e: Column) -> Column:
        beside = F.when((e["y1"] > y) != (e["y2"] > y), (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
        up = F.when((e["x1"] > right) != (e["x2"] > right), (e["y2"] - e["y1"]) * (right - e["x1"]) / (e["x2"] - e["x1"]) + e["y1"])
        return F.coalesce((x < beside) & (beside < right), F.lit(False)) != F.coalesce((low < up) & (up <= y), F.lit(False))

    return F.aggregate("edges", F.col("odd"), lambda odd, e: odd != met(e))


def distance(x: Column, y: Column) -> Column:
    """Degrees to the nearest of the edges near, NEAR at most."""

    def away(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / long))).otherwise(0.0)
        return F.sqrt(F.pow(x - e["x1"] - t * dx, 2) + F.pow(y - e["y1"] - t * dy, 2))

    return F.least(F.coalesce(F.array_min(F.transform("near", away)), F.lit(NEAR)), F.lit(NEAR))
