"""Hard negatives by a vector-approximation file: bounds from tables first, exact scores for few.

Each dimension is cut into cells and a row is approximated by a byte a dimension. For an
anchor, a table holds the least and the largest product of each cell with the anchor's
component; sums of looked-up values bound a row's score from below and above. Only rows
whose bounds reach into what is searched (a window, above the fifth best score met so far)
are scored exactly. Anchors are met with all rows in blocks: a grid of blocks of anchors and
of rows is dealt to tasks, and each task reads its rows as a stream, so neither anchors nor
rows are ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Folder
from .vectors import ROWS, matrix, whole_rows

SCALE, ANCHOR_EVERY, NEAREST = 256, 100, 5
#: The least score of a negative: 4 fifths (80 / 100) of the positive's.
LEAST, WHOLE = 4, 5
CELLS = 64
#: Anchors that one task holds, rows that it reads, at most about; fewer where there are few.
ANCHORS_EACH, ROWS_EACH, LEAST_EACH = 8192, 500_000, 512
#: Anchors and rows looked at together, and the rows of a first look, which finds what to beat.
TOGETHER, CHUNK, FIRST = 64, 2048, 256
FLOOR = np.iinfo(np.int64).min
FOUND = "anchor long, place int, id long, score long"


def relabelled(rows: DataFrame) -> DataFrame:
    """Rows with a label; where vec_id is divisible by 7, the label becomes (label + 1) % 10."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.filter(F.col("label").isNotNull()).withColumn("label", shifted)


def _spread(width: int) -> Callable:
    """Of each task: rows, sums, sums of squares, least and largest of each dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares, low, high = 0, np.zeros(width), np.zeros(width), np.full(width, np.inf), np.full(width, -np.inf)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"), width).astype(float)
                n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            at = pa.array(np.arange(width), pa.int32())
            yield pa.record_batch([at, pa.array([float(n)] * width), *map(pa.array, (total, squares, low, high))], names=["at", "n", "total", "squares", "low", "high"])

    return run


def cells(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole number of each cell of each dimension, (width, CELLS) each.

    Inner cells are equally wide within 3.5 deviations of the mean; the outer ones reach
    to the least and the largest value.
    """
    parts = rows.select("v").mapInArrow(_spread(width), "at int, n double, total double, squares double, low double, high double")
    found = parts.groupBy("at").agg(F.sum("n"), F.sum("total"), F.sum("squares"), F.min("low"), F.max("high")).orderBy("at").collect()
    n, total, squares, low, high = np.array([r[1:] for r in found]).T
    mean = total / n
    deviation = np.sqrt(np.maximum(squares / n - mean * mean, 0))
    begin, end = np.maximum(low, mean - 3.5 * deviation), np.minimum(high, mean + 3.5 * deviation)
    inner = np.floor(begin[:, None] + (end - begin)[:, None] * np.arange(1, CELLS) / CELLS)
    inner = np.clip(inner, low[:, None], high[:, None])
    lows = np.concatenate([low[:, None], inner + 1], axis=1)
    highs = np.concatenate([inner, high[:, None]], axis=1)
    return np.minimum(lows, highs).astype(np.int64), highs.astype(np.int64)  # a cell without numbers is never looked up


def approximate(x: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """The cell of each component, one byte each: the first whose largest number reaches it."""
    out = np.empty((x.shape[1], len(x)), np.uint8)
    for d in range(x.shape[1]):
        out[d] = np.searchsorted(highs[d, :-1], x[:, d], side="left")
    return out


def tables(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """(width, CELLS, 2 * anchors): least products with the anchors' components, then largest."""
    a, b = lows[:, :, None] * anchors.T[:, None, :], highs[:, :, None] * anchors.T[:, None, :]
    out = np.concatenate([np.minimum(a, b), np.maximum(a, b)], axis=2)
    most = np.abs(out).max(axis=(1, 2), initial=0).sum() if out.size else 0
    return out.astype(np.int32) if most < 1 << 31 else out


def bounds(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, (rows, anchors) each."""
    total = table[0].take(codes[0], axis=0)
    part = np.empty_like(total)
    for d in range(1, len(codes)):
        table[d].take(codes[d], axis=0, out=part, mode="clip")
        total += part
    half = total.shape[1] // 2
    return total[:, :half], total[:, half:]


class Search:
    """The anchors of one block and what has been found for them so far.

    Of each anchor, each of its places (windows of scores, least and largest included)
    keeps the NEAREST rows with the highest scores, ties by smaller id, no id last.
    """

    def __init__(self, batch: pa.RecordBatch, lows: np.ndarray, highs: np.ndarray, alike: bool):
        self.alike, self.lows, self.highs = alike, lows, highs
        self.rid, self.label = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rid", "label"))
        self.v = matrix(batch.column("v"), len(lows)).astype(np.int64)
        given = batch.column("windows").to_pylist()
        self.places = max((len(w) for w in given), default=0)
        self.least, self.most = np.full((len(given), self.places), 1, np.int64), np.full((len(given), self.places), 0, np.int64)
        for i, w in enumerate(given):
            for k, window in enumerate(w):
                self.least[i, k], self.most[i, k] = window["least"], window["most"]
        self.floor = self.least.copy()  # what a row must reach to be among the best of a place
        self.found = np.empty((5, 0), np.int64)  # anchor * places + place, negative score, no id, id, score

    def keep(self, new: np.ndarray) -> None:
        """new: like self.found. The best of each place stay."""
        rows = np.concatenate([self.found, new], axis=1)
        rows = rows[:, np.lexsort(rows[3::-1])]
        begins = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
        rank = np.arange(rows.shape[1]) - np.repeat(begins, np.diff(np.append(begins, rows.shape[1])))
        full = rows[:, rank == NEAREST - 1]
        np.maximum.at(self.floor.reshape(-1), full[0], full[4])
        self.found = rows[:, rank < NEAREST]

    def meet(self, rid: np.ndarray, no_id: np.ndarray, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        codes = approximate(x, self.highs)
        for at in range(0, len(self.v), TOGETHER):
            few = slice(at, at + TOGETHER)
            table = tables(self.v[few], self.lows, self.highs)
            begin, size = 0, FIRST
            while begin < len(x):
                rows = slice(begin, begin + size)
                lower, upper = bounds(np.ascontiguousarray(codes[:, rows]), table)
                fits = label[rows, None] == self.label[few]
                fits = fits & (rid[rows, None] != self.rid[few]) if self.alike else ~fits
                news = []
                for k in range(self.places):
                    r, a = np.nonzero(fits & (upper >= self.floor[few, k]) & (lower <= self.most[few, k]))
                    if len(r):
                        score = np.concatenate([np.einsum("ij,ij->i", x[r[i : i + 20_000] + begin].astype(np.int64), self.v[a[i : i + 20_000] + at]) for i in range(0, len(r), 20_000)])
                        hit = (score >= self.floor[few, k][a]) & (score <= self.most[few, k][a])
                        r, a, score = r[hit] + begin, a[hit] + at, score[hit]
                        news.append(np.stack([a * self.places + k, -score, no_id[r], vec_id[r], score]))
                if news:
                    self.keep(np.concatenate(news, axis=1))
                begin, size = begin + size, CHUNK

    def results(self) -> Iterator[pa.RecordBatch]:
        if self.found.shape[1]:
            owner, _, no_id, vec_id, score = self.found
            yield pa.record_batch([pa.array(self.rid[owner // self.places]), pa.array((owner % self.places).astype(np.int32)), pa.array(vec_id, mask=no_id > 0), pa.array(score)], names=["anchor", "place", "id", "score"])


def _search(lows: np.ndarray, highs: np.ndarray, alike: bool) -> Callable:
    """Rows come by cell of the grid, a cell's anchors first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors, search = None, [], None
        for b in batches:
            where = b.column("cell").to_numpy() * 2 + b.column("is_row").to_numpy()
            edges = np.flatnonzero(np.diff(where)) + 1
            for begin, end in zip([0, *edges], [*edges, len(where)]):
                if end == begin:
                    continue
                part = b.slice(begin, end - begin)
                if where[begin] // 2 != cell:
                    if search:
                        yield from search.results()
                    cell, anchors, search = where[begin] // 2, [], None
                if where[begin] % 2 == 0:
                    anchors.append(part)
                elif anchors:
                    search = search or Search(pa.Table.from_batches(anchors).combine_chunks().to_batches()[0], lows, highs, alike)
                    ids = part.column("vec_id")
                    rid, label = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rid", "label"))
                    search.meet(rid, ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False), label, matrix(part.column("v"), len(lows)))
        if search:
            yield from search.results()

    return run


def best(rows: DataFrame, anchors: DataFrame, grid: tuple[int, int], bounds_of_cells: tuple[np.ndarray, np.ndarray], alike: bool) -> DataFrame:
    """anchor (rid), place, id, score, rank: the NEAREST rows of each window of each anchor.

    anchors has also windows, an array of (least, largest) scores. alike: rows of the
    anchor's label other than itself, else rows of other labels.
    """
    a_blocks, r_blocks = grid
    of = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("rid")), F.lit(n))
    windows = "array<struct<least:long,most:long>>"
    left = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))).alias("block"), "*").select((of(a_blocks, 1) * r_blocks + F.col("block")).alias("cell"), F.lit(0).alias("is_row"), "rid", "vec_id", "label", "v", "windows")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1))).alias("block"), "*").select((F.col("block") * r_blocks + of(r_blocks, 2)).alias("cell"), F.lit(1).alias("is_row"), "rid", "vec_id", "label", "v", F.lit(None).cast(windows).alias("windows"))
    dealt = left.union(right).repartitionById(a_blocks * r_blocks, F.col("cell").cast("int")).sortWithinPartitions("cell", "is_row")
    found = dealt.mapInArrow(_search(*bounds_of_cells, alike), FOUND)
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEAREST)


def mine(embeddings: DataFrame, every: int = ANCHOR_EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows whose label or vector is null, or whose vector holds a null or non-finite component,
    take no part. Vectors shorter than the longest count as filled up with zeros, components
    as 134,217,728 at most. Rows that share an id each count for themselves: a copy of
    an anchor is one of its positives, and an anchor that is there twice is answered
    twice. A row without id is no anchor and comes last among equal scores. Anchors
    without positives, and positives whose window is empty (scores below 0 among them), have no
    rows; an empty table gives an empty result. Other columns are ignored.
    """
    folder = Folder(embeddings.sparkSession, "negatives")
    rows = folder.write(relabelled(whole_rows(embeddings, SCALE)), "rows")
    is_anchor = F.col("vec_id") % every == 0
    n, n_anchors, longest = rows.agg(F.count("*"), F.count_if(is_anchor), F.max(F.octet_length("v"))).first()
    width = (longest or 0) // 4
    spark = embeddings.sparkSession
    if not n_anchors or not width:  # vectors of no components: no score, nothing to tell apart
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = (-(-n_anchors // ANCHORS_EACH), max(-(-n // ROWS_EACH), min(parts, -(-n // LEAST_EACH))))
    bounds_of_cells = cells(rows, width)
    anchors = rows.filter(is_anchor)
    every_score = F.array(F.struct(F.lit(FLOOR + 1).alias("least"), F.lit(-(FLOOR + 1)).alias("most")))
    positives = folder.write(best(rows, anchors.withColumn("windows", every_score), grid, bounds_of_cells, True).select("anchor", "rank", "id", "score"), "positives")
    least = F.expr(f"{LEAST} * score div {WHOLE} + IF(score > 0 AND {LEAST} * score % {WHOLE} != 0, 1, 0)")  # rounded up
    by_anchor = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", least.alias("least"), F.col("score").alias("most")))).alias("all"))
    windows = F.transform("all", lambda w: F.struct(w["least"].alias("least"), w["most"].alias("most")))
    asked = anchors.join(by_anchor.select(F.col("anchor").alias("rid"), windows.alias("windows")), "rid")
    negatives = best(rows, asked, grid, bounds_of_cells, False).select("anchor", (F.col("place") + 1).alias("of"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    named = named.select("anchor", F.col("rank").alias("of"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(negatives, ["anchor", "of"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
