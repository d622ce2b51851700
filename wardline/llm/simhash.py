"""SimHash near-dedup with vantage-point trees.

Two fingerprints within 4 of 64 bits agree, to 1 bit, in at least one of four bands of
16 bits. So each band is searched for neighbours within 1, which keeps the triangle
bounds tight: a band's values are partitioned by their Hamming distance to vantage
points into shells two wide, a value at a shell's lower border also goes to the shell
below, and any two values within 1 then meet in the shard of their lower shells. A
shard's pairs are dealt to tasks by blocks of its rows, and inside a block a vantage-point tree over the band's values prunes by the same bounds, and the
full fingerprints of what is left are compared. A shard returns a spanning forest of
its links, never all pairs of a group.

Deduplication looks further: texts of similarity 0.8 differ in some 10 of 64 bits, so
fingerprints within 15 bits (within 3 in one of the bands) are candidates, and three more
fingerprints of the same shingles, 256 bits in all, tell the likeness of a pair closely
enough to confirm it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import combine, kept_rows, pieces, settle

SHINGLE, SEED, RADIUS = 4, 42, 4
#: For deduplication: words of a shingle, bits of 64 that candidates differ in, and bits of 256 that copies differ in.
#: At a similarity (Jaccard) of 0.8 texts differ in 39 of 256 bits on average, with a deviation of 6; at 0.75 in 44, at 0.7 in 49.
COPY_SHINGLE, COPY_RADIUS, COPY_BITS = 5, 15, 48
#: By these the further fingerprints' hashes differ from the first one's.
FURTHER = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
BANDS, BAND_BITS = 4, 16
#: Vantage points: each halves the bits anew, so their distances tell different things.
VANTAGE = (0x5555, 0x3333, 0x0F0F, 0x00FF, 0x6666, 0x5A5A, 0x55AA, 0x3C3C)
LEAF_PAIRS = 1 << 16
#: Distinct fingerprints that a shard should hold at most, as far as the vantage points part them, and its blocks.
SHARD_ROWS, BLOCK_ROWS = 1_000_000, 250_000
#: Vantage points and blocks of a shard where there are few fingerprints, so that there are many tasks then too.
LEAST_LEVELS, LEAST_BLOCKS = 2, 4


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 50_000 + 1):
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: bytes | None, shingle: int = SHINGLE, further: int = 0) -> list[int]:
    """SimHash of the whole text as a signed 64-bit number, and further ones of the same shingles; without words 0."""
    words = (text or b"").lower().split()
    if not words:
        return [0] * (1 + further)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[shingle - 1 :] or ends[-1:]
    hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, last)], np.uint64)
    return [_majority(hashes), *(_majority(combine(hashes, mark)) for mark in FURTHER[:further])]


def fingerprint(text: bytes | None) -> int:
    return fingerprints(text)[0]


def _fingerprints(shingle: int, further: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            each = [fingerprints(t, shingle, further) for t in batch.column(2).to_pylist()]
            columns = [pa.array([f[i] for f in each], pa.int64()) for i in range(1 + further)]
            yield pa.record_batch([*batch.columns[:2], *columns], names=["doc_id", "text_hash", "fp", *(f"fp{i}" for i in range(1, 1 + further))])

    return run


def near(values: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, radius: int, found: Callable, all_linked: Callable | None = None) -> None:
    """Report index pairs of a x b (a x a, each once, if same) whose values lie within radius.

    A dual vantage-point tree: a vantage point deals both sides into shells by distance;
    shells further apart than radius can hold no pair. Where two distances sum to at most
    radius every pair is one, which goes to all_linked as a whole.
    """
    stack, rng = [(a, b, same, 0)], np.random.default_rng(1)
    while stack:
        a, b, same, stuck = stack.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= LEAF_PAIRS or stuck > 3:
            step = max(1, LEAF_PAIRS // len(b))
            for at in range(0, len(a), step):
                i, j = np.nonzero(np.bitwise_count(values[a[at : at + step], None] ^ values[b][None, :]) <= radius)
                i, j = a[at : at + step][i], b[j]
                keep = i < j if same else slice(None)
                found(i[keep], j[keep])
            continue
        vantage = values[a[rng.integers(len(a))]]
        da = np.bitwise_count(values[a] ^ vantage)
        order = np.argsort(da, kind="stable")
        a, da = a[order], da[order]
        if same:
            b, db = a, da
        else:
            db = np.bitwise_count(values[b] ^ vantage)
            order = np.argsort(db, kind="stable")
            b, db = b[order], db[order]
        shells = np.unique(da)
        size = len(a) * len(b)
        for s in shells.astype(int):
            part = a[np.searchsorted(da, s) : np.searchsorted(da, s, "right")]
            inner = max(radius - s, -1)
            if all_linked and inner >= (s if same else 0):
                rest = b[(s if same else 0) and np.searchsorted(db, s) : np.searchsorted(db, inner, "right")]
                if len(rest):
                    all_linked(part, rest)
            low = max(s + 1 if same else s - radius, inner + 1 if all_linked else 0)
            other = b[np.searchsorted(db, low) : np.searchsorted(db, s + radius, "right")]
            stack.append((part, other, False, stuck + 1 if len(part) * len(other) > 0.9 * size else 0))
            if same and not (all_linked and inner >= s):
                stack.append((part, part, True, stuck + 1 if len(part) ** 2 > 0.9 * size else 0))


class Forest:
    """Union of links over 0..n-1, in batches; a root is its tree's smallest index."""

    def __init__(self, n: int):
        self.root, self.waiting, self.held = np.arange(n), [], 0

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.waiting.append((i, j))
            self.held += len(i)
            if self.held > 500_000:
                self.settle()

    def link_all(self, a: np.ndarray, b: np.ndarray) -> None:
        both = np.concatenate([a, b])
        self.link(np.full(len(both), both[0]), both)

    def settle(self) -> np.ndarray:
        if self.waiting:
            i, j = (np.concatenate(x) for x in zip(*self.waiting))
            self.waiting, self.held, root = [], 0, self.root
            while True:
                a, b = root[i], root[j]
                open_ = a != b
                if not open_.any():
                    break
                i, j, a, b = i[open_], j[open_], a[open_], b[open_]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(root, up := root[root]):
                    root = up
            self.root = root
        return self.root


def links(fps: np.ndarray, band: int, radius: int = RADIUS, further: np.ndarray | None = None, bits: int = 0, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fp, other fp) of the pairs within radius whose values in the band lie within radius // BANDS.

    fps: each once. With further fingerprints, a row for each fp, only pairs count that
    differ in no more than so many bits of all of them; with side (0 or 1), only pairs of
    both sides. Candidates are looked at some at a time.
    """
    if len(fps) < 2:
        return fps[:0], fps[:0]
    part = (fps >> np.uint64(band * BAND_BITS)) & np.uint64((1 << BAND_BITS) - 1)
    sides = np.zeros(len(fps), np.uint64) if side is None else side.astype(np.uint64)
    order = np.lexsort((fps, part, sides))
    fps, part = fps[order], part[order] | sides[order] << np.uint64(BAND_BITS)
    further = None if further is None else further[order]
    values, start, count = np.unique(part, return_index=True, return_counts=True)
    forest, every = Forest(len(fps)), np.arange(len(fps))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def confirmed(x: np.ndarray, y: np.ndarray) -> None:
        if further is not None:
            apart = np.bitwise_count(fps[x] ^ fps[y]).astype(np.int64) + np.bitwise_count(further[x] ^ further[y]).sum(axis=1, dtype=np.int64)
            x, y = x[apart <= bits], y[apart <= bits]
        forest.link(x, y)

    def compare() -> None:
        """Compare the fingerprints under the pairs of values that wait."""
        nonlocal held
        if not waiting:
            return
        left, right = (np.concatenate(z) for z in zip(*waiting))
        waiting.clear()
        held = 0
        many = count[left] * count[right]
        for i, j in zip(left[many > LEAF_PAIRS], right[many > LEAF_PAIRS]):
            a, b = (every[start[v] : start[v] + count[v]] for v in (i, j))
            near(fps, a, b, i == j, radius, confirmed, forest.link_all if further is None else None)
        left, right, many = (x[many <= LEAF_PAIRS] for x in (left, right, many))
        for cut in np.split(np.arange(len(many)), np.unique(np.searchsorted(np.cumsum(many), np.arange(1 << 20, many.sum() + 1, 1 << 20)))):
            if len(cut):
                i, j, n = left[cut], right[cut], many[cut]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                width = np.repeat(count[j], n)
                x, y = np.repeat(start[i], n) + at // width, np.repeat(start[j], n) + at % width
                hit = (x != y) & (np.bitwise_count(fps[x] ^ fps[y]) <= radius)
                confirmed(x[hit], y[hit])

    def wait(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held
        waiting.append((i, j))
        held += len(i)
        if held > 1 << 20:
            compare()

    alone = np.arange(len(values))
    if side is None:
        wait(alone, alone)
        near(values, alone, alone, True, radius // BANDS, wait)
    else:
        first = np.searchsorted(values, 1 << BAND_BITS)
        near(values & np.uint64((1 << BAND_BITS) - 1), alone[:first], alone[first:], False, radius // BANDS, wait)
    compare()
    root = forest.settle()
    moved = root != every
    return fps[moved], fps[root[moved]]


def _linked(radius: int, bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not columns:
            return
        shard, band, side, *fps = (np.concatenate(x) for x in zip(*columns))
        order = np.argsort(shard, kind="stable")
        shard, band, side, fps = shard[order], band[order], side[order], [f[order].view(np.uint64) for f in fps]
        further = np.stack(fps[1:], axis=1) if len(fps) > 1 else None
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for low, high in zip(cuts, cuts[1:]):
            if high - low > 1:
                two = None if side[low] < 0 else side[low:high]
                a, b = links(fps[0][low:high], int(band[low]), radius, None if further is None else further[low:high], bits, two)
                if len(a):
                    yield pa.record_batch([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def shards(fps: DataFrame, levels: int, blocks: int, radius: int = RADIUS) -> DataFrame:
    """shard, band, side and the columns of fps: each fingerprint in each band's shards, near a shell's lower border in two.

    Shells are one wider than the band's radius. A shard is cut into blocks by a hash, and
    its pairs into those of each block (side -1) and of each two blocks (sides 0 and 1).
    """
    near_by = radius // BANDS
    rows = fps.withColumn("band", F.explode(F.array(*[F.lit(b) for b in range(BANDS)])))
    rows = rows.withColumn("value", F.expr(f"shiftrightunsigned(fp, band * {BAND_BITS}) & {(1 << BAND_BITS) - 1}")).withColumn("shells", F.lit(0).cast("long"))
    for level in range(levels):
        away = F.bit_count(F.col("value").bitwiseXOR(F.lit(VANTAGE[level])))
        shell = F.floor(away / (near_by + 1)).cast("int")
        rows = rows.withColumn("shell", F.explode(F.when(away % (near_by + 1) < near_by, F.array(shell, shell - 1)).otherwise(F.array(shell))))
        rows = rows.withColumn("shells", F.col("shells") + (F.col("shell") + 1).cast("long") * 16**level)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    mine, other = F.col("block"), F.col("other")
    side = F.when(mine == other, -1).when(mine < other, 0).otherwise(1)
    return rows.select(F.xxhash64("band", "shells", F.least(mine, other), F.greatest(mine, other)).alias("shard"), "band", side.alias("side"), *fps.columns)


def dealt_by(n: int, radius: int) -> tuple[int, int]:
    """Vantage points and blocks for n distinct fingerprints.

    Each vantage point halves the largest shard and makes the rows 1.5 times as many where
    shells are two wide; wider shells overlap so much that they would make more pairs, not
    fewer, so there blocks alone part the work, as many as hold about BLOCK_ROWS each.
    """
    levels = 0
    if radius // BANDS <= 1:
        levels = min(len(VANTAGE), max(LEAST_LEVELS, math.ceil(math.log2(max(n, 1) / SHARD_ROWS))))
    return levels, max(LEAST_BLOCKS, math.ceil(n / 2**levels / BLOCK_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """node, root: nodes that have links, with the smallest node reachable; by alternating large and small stars."""
    pair = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, before = settle(pair), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a").filter("b > a")
        large = large.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        state = settle(small.filter("a != b").distinct())


def linked(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bits: int = 0) -> DataFrame:
    """doc_id, text_hash, fp, least: each row of docs with the first (no_id, doc_id, text_hash) of its component.

    With bits, links are confirmed by all fingerprints.
    """
    more = [f"fp{i + 1}" for i in range(len(FURTHER))] if bits else []
    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = settle(read.mapInArrow(_fingerprints(shingle, len(more)), ", ".join(f"{c} long" for c in ("doc_id", "text_hash", "fp", *more))))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    each = settle(rows.groupBy("fp").agg(F.min(first).alias("least"), *([F.min(F.struct(*more)).alias("more")] if more else [])))
    nodes = each.select("fp", *[F.col(f"more.{c}").alias(c) for c in more])
    edges = shards(nodes, *dealt_by(each.count(), radius), radius).repartition("shard").mapInArrow(_linked(radius, bits), "a long, b long")
    roots = components(edges)
    whole = each.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = whole.groupBy("root").agg(F.min("least").alias("least"))
    return rows.select("doc_id", "text_hash", "fp").join(whole.drop("least").join(firsts, "root").select("fp", "least"), "fp")


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of docs.

    Null and wordless texts have fingerprint zero and link like any other. Rows with
    equal fingerprints are always linked. A null doc_id gets its component's smallest id,
    null if there is none. A bit set in exactly half of the shingles is 0. Texts of any length
    are read whole, one at a time. An empty table gives an empty result.
    """
    return linked(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def dedup(docs: DataFrame, shingle: int = COPY_SHINGLE, radius: int = COPY_RADIUS, bits: int = COPY_BITS) -> DataFrame:
    """docs with one row of each group of near copies, columns unchanged.

    Copies are texts of a similarity of 0.8 or more by their shingles of five words, as
    far as 256 bits tell, and what is linked through them.

    It is that of the smallest doc_id; of rows that share it, and in components without
    any id, that with the least hash of its text; of rows repeated in both, one. Null
    texts count as empty ones. Texts of any length are read whole. An empty table stays empty.
    """
    rows = linked(docs, shingle, radius, bits)
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return kept_rows(docs, settle(rows.select("doc_id", "text_hash", kept.alias("kept"))))
