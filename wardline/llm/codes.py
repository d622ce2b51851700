"""Product codes of vectors by exponion search, in exact integers.

Each part of a vector has a codebook of 256 entries. A part's nearest entry is looked for
among the neighbours of the entry it had in the round before, nearest neighbour first: with
u the distance to that entry and b the least distance met so far, an entry that is as near
as b lies within u + b of it (triangle inequality), so the scan ends at the first neighbour
beyond that radius, which shrinks with b and is 2u at the start. Distances are exact
integers and ties go to the lower index. Parts that had the same entry scan its list together.
Codebooks and their sums have a fixed size; rows stay where they are, and the entries of a
round are kept with them in files of the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Folder
from .vectors import ROWS, matrix, whole_rows

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Neighbours looked at between two looks at the radius.
STEP = 16
#: The radius is taken larger by this share, far more than square roots are rounded by.
SLACK = 1e-9


class Codebook:
    """Entries of one part, with each entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        apart = self.entries[:, None] - self.entries[None]
        apart = (apart * apart).sum(axis=2)
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.far = np.sqrt(np.take_along_axis(apart, self.near, axis=1).astype(float))
        self.largest = int(np.abs(self.entries).max(initial=0))

    def search(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry and the squared distance, from the entry it had before."""
        most = max(self.largest, int(np.abs(x).max(initial=0)))
        exact = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64  # products by BLAS where doubles hold them
        x, entries = x.astype(exact), self.entries.astype(exact)
        own, squares = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", entries, entries)
        found, least = before.astype(np.int64).copy(), np.zeros(len(x), exact)
        order = np.argsort(before, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(before[order])) + 1) if len(x) else []:
            start = before[rows[0]]
            apart = x[rows] - entries[start]
            best, index = np.einsum("ij,ij->i", apart, apart), np.full(len(rows), start)
            u = np.sqrt(best.astype(float))
            active = np.arange(len(rows))
            for at in range(0, len(self.entries), STEP):
                radius = (u[active] + np.sqrt(best[active].astype(float))) * (1 + SLACK)
                active = active[radius >= self.far[start, at]]
                if not len(active):
                    break
                near = self.near[start, at : at + STEP]
                distance = own[rows[active], None] - 2 * (x[rows[active]] @ entries[near].T) + squares[near]
                closest = distance.min(axis=1)
                lowest = np.where(distance == closest[:, None], near, len(self.entries)).min(axis=1)
                better = (closest < best[active]) | (closest == best[active]) & (lowest < index[active])
                best[active[better]], index[active[better]] = closest[better], lowest[better]
            found[rows], least[rows] = index, best
        return found, least.astype(np.int64)


def _assign(books: list[np.ndarray], width: int, last: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Codebook(b) for b in books]
        part = width // PARTS
        for b in batches:
            x = matrix(b.column("v"), width)
            before = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(x), PARTS)
            codes, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(searched):
                found, distance = book.search(x[:, p * part : (p + 1) * part], before[:, p])
                codes[:, p], error = found, error + distance
            raw = pa.array([c.tobytes() for c in codes], pa.binary())
            rows = [b.column("rid"), b.column("vec_id"), b.column("label")]
            yield pa.record_batch([*rows, raw, pa.array(error)], names=["rid", "vec_id", "label", "codes", "error"]) if last else pa.record_batch([*rows, b.column("v"), raw], names=["rid", "vec_id", "label", "v", "codes"])

    return run


def _sums(width: int) -> Callable:
    """Of each task: for every part and entry that it has, rows and sums of their components."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = width // PARTS
        n, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, part), np.int64)
        for b in batches:
            x = matrix(b.column("v"), width)
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(x), PARTS)
            for p in range(PARTS):
                n[p] += np.bincount(codes[:, p], minlength=ENTRIES)
                np.add.at(total[p], codes[:, p], x[:, p * part : (p + 1) * part])
        at = np.argwhere(n > 0)
        sums = pa.array([total[p, e].tolist() for p, e in at], pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(n[n > 0]), sums], names=["part", "entry", "n", "sums"])

    return run


def moved(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks with each entry at the floor of the mean of its parts; unused entries stay."""
    sums = rows.select("v", "codes").mapInArrow(_sums(width), "part int, entry int, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width // PARTS)]
    out = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():  # PARTS * ENTRIES rows at most
        out[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r[3:]]
    return out


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(v)) for b in books for v in b.ravel())


def train(embeddings: DataFrame, folder: Folder, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], int]:
    """Rows with the codes of the last round, the codebooks after it, and the width of the vectors."""
    start = folder.write(whole_rows(embeddings, SCALE).withColumn("codes", F.lit(bytes(PARTS))), "start")
    longest = start.agg(F.max(F.octet_length("v"))).first()[0] or 0
    width = -(-longest // 4 // PARTS) * PARTS
    first = start.select("v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    whole = matrix(pa.array([bytes(r[0]) for r in first], pa.binary()), width).astype(np.int64)
    books, rows = np.split(whole, PARTS, axis=1), start
    if not first or not width:
        return rows, books, width
    for i in range(rounds):
        rows = folder.write(rows.mapInArrow(_assign(books, width, False), ROWS + ", codes binary"), f"round{i}")
        folder.empty(f"round{i - 1}" if i else "start")
        books = moved(rows, books, width)
    return rows, books, width


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per row kept.

    Rows whose vector is null or holds a null or non-finite component are dropped. Vectors
    shorter than the longest, or than a multiple of four, count as filled up with zeros;
    components count as 131,072 at most. A null vec_id comes last where entries are chosen, and
    of rows that share an id, the vector with the lesser bytes first; each row counts for
    itself, repeated ones too. Equal distances go to the lower index. Null labels are one
    label. With fewer rows than entries the codebooks are shorter; an empty table gives an
    empty result. Other columns are ignored.
    """
    folder = Folder(embeddings.sparkSession, "codes")
    rows, books, width = train(embeddings, folder, rounds)
    if width:
        last = rows.mapInArrow(_assign(books, width, True), "rid long, vec_id long, label long, codes binary, error long")
    else:  # no rows, or vectors of no components
        last = rows.select("rid", "vec_id", "label", "codes", F.lit(0).cast("long").alias("error"))
    last = folder.write(last, "last")
    by_label = last.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return last.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
