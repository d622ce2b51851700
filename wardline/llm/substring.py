"""Substring dedup over a log-structured fingerprint index.

The index is a folder of immutable runs, each bucketed and sorted by fingerprint: the
keys of the windows, or of whole stretches of windows, met so far. A batch of documents
is dealt to the same buckets, sorted, and merge-joined with each run where that lies; a
place whose fingerprint a run or an earlier place of the batch holds is a duplicate, and
the batch's rows become a new run. Runs are compacted into one when there are several. A
match is one of 128 bits: 64 to find it by and 64 more of the digest to verify it. A task
drops the repetitions within its own documents before they are dealt, so a large group
of copies adds a row or few for each task.

Two things keep the index far smaller than the text without missing a window:

- Windows are dealt into stretches whose ends depend on the words alone. A stretch and
  the words its last window needs make one fingerprint; a stretch met before has all
  its windows met before.
- Where all documents are known beforehand, single windows are indexed only in stretches
  met for the first time, and there only where their words recur. Each window has an
  anchor, the least hash of its shorter word runs, so equal windows have equal anchors,
  and windows of an anchor that was met in one stretch only recur with their whole
  stretch or not at all. Stretches, anchors and texts meet by shuffled joins; nothing
  here has a size of its own that the data could outgrow.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import combine, hash_words, pieces, settle, shared_folder

WINDOW, ANCHOR = 20, 12
#: One word run in so many ends a stretch.
STRETCH = 64
BATCHES, MOST_RUNS = 3, 2
LAST = (1 << 63) - 1  # place of documents without id
#: Keys of stretches differ from those of windows in this.
STRETCH_MARK = 0x5DEECE66D
#: A cell, some windows in a row with one anchor, is written as its first window, whether it recurs for sure, and their number.
CELL_BITS, RECURS, CELL_WINDOWS = 24, 1 << 23, 1 << 20


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words, by doubling."""
    out, have = words, 1
    while have < size:
        step = min(have, size - have)
        out = combine(out[: len(out) - step], out[step:])
        have += step
    return out


class Page:
    """The windows of one document."""

    def __init__(self, text: bytes | None):
        self.words = (text or b"").split()
        self.joined = b" ".join(self.words)
        self.windows = max(0, len(self.words) - WINDOW + 1)

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.words), np.int64, len(self.words))

    @cached_property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.lengths + 1) - 1

    @cached_property
    def starts(self) -> np.ndarray:
        return self.ends - self.lengths

    @cached_property
    def word_hash(self) -> np.ndarray:
        return hash_words(self.joined, self.starts, self.lengths)

    def keys(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of the digests of the words first..last."""
        text, digest = self.joined, xxhash.xxh3_128_digest
        rows = b"".join([digest(text[a:b]) for a, b in zip(self.starts[first].tolist(), self.ends[last].tolist())])
        both = np.frombuffer(rows, [("k1", "<i8"), ("k2", "<i8")])
        return both["k1"], both["k2"]

    def stretches(self) -> np.ndarray:
        """First window of each stretch."""
        ends = np.flatnonzero(_runs(self.word_hash, 3)[: self.windows] % np.uint64(STRETCH) == 0)
        return np.unique(np.append(ends, 0))

    def cells(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of the windows, each run of equal ones in a stretch once; the cells; and how many each stretch has."""
        short = _runs(self.word_hash, ANCHOR)
        low, wide, have = short, WINDOW - ANCHOR + 1, 1
        while have < wide:
            step = min(have, wide - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        new = np.append(True, low[1:] != low[:-1])
        new[first] = True
        new[::CELL_WINDOWS] = True
        at = np.flatnonzero(new)
        anchors, cell = low[at], at << CELL_BITS | np.diff(np.append(at, self.windows))
        order = np.sort(short)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):  # word runs that recur in this document
            cell |= np.where(np.isin(anchors, twice), RECURS, 0)
        return anchors, cell, np.diff(np.append(np.searchsorted(at, first), len(at)))

    def result(self, places: Iterable[dict]) -> tuple[int, int, str]:
        """Words, removed words and the hash of the kept ones, given the places (at, span) of duplicate windows."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        for p in places:
            edge[p["at"]] += 1
            edge[p["at"] + p["span"] + WINDOW - 1] -= 1
        kept = np.cumsum(edge[:-1]) == 0
        words = b" ".join([w for w, k in zip(self.words, kept.tolist()) if k])
        return len(self.words), int(len(kept) - kept.sum()), hashlib.sha256(words).hexdigest()


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in pieces(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns))


_PLACES = "k1 long, k2 long, place long, doc long, at int, span int, again boolean, cells array<long>"
_CELLS = pa.list_(pa.int64())
_FIELDS = {"k1": pa.int64(), "k2": pa.int64(), "place": pa.int64(), "doc": pa.int64(), "at": pa.int32(), "span": pa.int32(), "again": pa.bool_(), "cells": _CELLS}


def _emit(parts: Iterable[tuple], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of ((k1, k2), place, doc, at, span[, cells, cells of each]).

    A place that repeats another of the same batch is marked, its key given up and its
    cells left out; of rows alike in everything one is left.
    """
    waiting: list[list] = []
    held = 0

    def flush() -> pa.RecordBatch:
        if not waiting:
            return pa.record_batch([pa.array([], k) for k in _FIELDS.values()], names=list(_FIELDS))
        k1, k2, place, doc, at, span, cells, sizes = (np.concatenate(x) for x in zip(*waiting))
        order = np.lexsort((at, doc, place, k2, k1))
        k1, k2, place, doc, at, span = (x[order] for x in (k1, k2, place, doc, at, span))
        twin = np.append(False, (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]))
        own = twin & np.append(False, (place[1:] == place[:-1]) & (doc[1:] == doc[:-1]))
        head, own_head = (np.maximum.accumulate(np.where(x, 0, np.arange(len(k1)))) for x in (twin, own))
        again = (place != place[head]) | (at != at[own_head])
        alike = own & np.append(False, at[1:] == at[:-1])
        # a repetition needs no key: its place deals it anywhere
        k1 = np.where(again, (combine(place.astype(np.uint64), 0) ^ at.astype(np.uint64)).view(np.int64), k1)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(cells)).take(pa.array(np.where(again, -1, order), mask=again))
        columns = [pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip((k1, k2, place, doc, at, span, again), _FIELDS.values())]
        return pa.record_batch([*columns, lists], names=list(_FIELDS)).filter(pa.array(~alike))

    for (k1, k2), place, doc, at, span, *cells in parts:
        waiting.append([k1, k2, np.full(len(k1), place), np.full(len(k1), doc), at, span, *(cells or (np.zeros(0, np.int64), np.zeros(len(k1), np.int64)))])
        held += len(k1) + len(waiting[-1][6])
        if held > most:
            yield flush()
            waiting, held = [], 0
    yield flush()


def _stretch_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stretch, with its anchors and cells."""

    def parts() -> Iterator[tuple]:
        for place, doc, text in _rows(batches):
            page = Page(text)
            if page.windows:
                first = page.stretches()
                span = np.diff(np.append(first, page.windows))
                k1, k2 = page.keys(first, first + span + WINDOW - 2)
                anchors, cells, sizes = page.cells(first)
                both = np.empty(2 * len(cells), np.int64)
                both[::2], both[1::2] = anchors.view(np.int64), cells
                yield (k1 ^ STRETCH_MARK, k2), place, doc, first, span, both, 2 * sizes

    return _emit(parts(), 1_500_000)


def _cell_rows(every: bool):
    """anchor, doc, cell, known: the cells of stretches; known are those that recur in the batch (all, if every)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            anchor, doc, cell = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
            order = np.argsort(anchor, kind="stable")
            anchor, doc, cell = anchor[order], doc[order], cell[order]
            twin = anchor[1:] == anchor[:-1]
            again = np.append(False, twin)[: len(anchor)]
            known = again | np.append(twin, False)[: len(anchor)] | (cell & RECURS > 0) | every
            anchor = np.where(again, doc ^ cell, anchor)  # one is left to find those elsewhere by
            return pa.record_batch([pa.array(anchor), pa.array(doc), pa.array(cell), pa.array(known)], names=["anchor", "doc", "cell", "known"])

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy()
            doc = np.repeat(batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy() // 2)
            parts.append((flat[::2], doc, flat[1::2]))
            held += len(doc)
            if held > 1_000_000:
                yield flush()
                parts, held = [], 0
        yield flush()

    return run


def _recurring(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, cell of the rows, sorted by anchor, that are known or share their anchor with another row."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, doc, cell, known = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        same = anchor[1:] == anchor[:-1]
        hit = known | np.append(False, same) | np.append(same, False)
        if last and last[0] == anchor[0]:
            hit[0] = True
            if not last[3]:
                yield pa.record_batch([pa.array([last[1]]), pa.array([last[2]])], names=["doc", "cell"])
        last = anchor[-1], doc[-1], cell[-1], hit[-1]
        yield pa.record_batch([pa.array(doc[hit]), pa.array(cell[hit])], names=["doc", "cell"])


def _window_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window in the cells given for a document."""

    def parts() -> Iterator[tuple]:
        for place, doc, text, cells in _rows(batches):
            page = Page(text)
            wanted = np.zeros(page.windows + 1, np.int64)
            cells = np.array(cells, np.int64)
            low = np.minimum(cells >> CELL_BITS, page.windows)  # cells of another text of the same hash may lie outside
            np.add.at(wanted, low, 1)
            np.subtract.at(wanted, np.minimum(low + (cells & RECURS - 1), page.windows), 1)
            at = np.flatnonzero(np.cumsum(wanted[:-1]))
            for part in np.array_split(at, len(at) // 100_000 + 1):
                yield page.keys(part, part + WINDOW - 1), place, doc, part, np.ones(len(part), np.int64)

    return _emit(parts(), 300_000)


def _marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's rows by key, place, doc and at: marked where a run has the key (old), a smaller place or the row's own text before it.

    Of unmarked rows of a key (texts that share their place) the first keeps the key, so
    that a run has each key once.
    """
    now: tuple | None = None  # key, place and doc of the row met last; the first place of its key, the first at of its doc there
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, place, doc, at, again, old = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("k1", "k2", "place", "doc", "at", "again", "old"))
        rows = np.arange(len(k1))
        new = np.append(now is None or (k1[0], k2[0]) != now[:2], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
        new_doc = new | np.append(now is None or (place[0], doc[0]) != now[2:4], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))
        head, own = (np.maximum.accumulate(np.where(x, rows, -1)) for x in (new, new_doc))
        first_place, first_at = place[np.maximum(head, 0)], at[np.maximum(own, 0)]
        if now is not None:
            first_place, first_at = np.where(head < 0, now[4], first_place), np.where(own < 0, now[5], first_at)
        now = k1[-1], k2[-1], place[-1], doc[-1], first_place[-1], first_at[-1]
        again = again | old | (place != first_place) | (at != first_at)
        k2 = np.where(new | again, k2, (k2.astype(np.uint64) ^ combine(doc.astype(np.uint64), 1)).view(np.int64))
        marks = pa.array(again)
        cells = pc.if_else(marks, pa.scalar(None, _CELLS), batch.column("cells").cast(_CELLS))
        yield pa.record_batch([batch.column("k1"), pa.array(k2), *batch.columns[2:6], marks, cells], names=list(_FIELDS))


class FingerprintIndex:
    """Immutable runs of keys, bucketed and sorted, in one folder that all executors share.

    A folder that holds an index is opened as it is; what was merged before counts as
    earlier than all that is merged from then on.
    """

    def __init__(self, spark: SparkSession, folder: str, most_runs: int = MOST_RUNS, buckets: int | None = None):
        self.spark, self.folder, self.most_runs = spark, folder, most_runs
        self.name = f"wardline_{uuid.uuid4().hex}"
        self.made, self.runs, self.every, self.buckets = 0, [], [], buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if states := self._states():
            state = max(states, key=lambda s: s["made"])
            self.made, self.buckets = state["made"], state["buckets"]
            self.runs = [self._known(number) for number in state["runs"]]

    def _states(self) -> list:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.json(f"{self.folder}/state-*", schema="made long, buckets int, runs array<long>").collect()  # a row for each run made
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _known(self, number: int) -> str:
        """The table of a run that lies in the folder."""
        table = f"{self.name}_{number}"
        self.spark.sql(f"CREATE TABLE {table} ({_PLACES}) USING parquet CLUSTERED BY (k1) SORTED BY (k1, k2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/run-{number}'")
        self.every.append(table)
        return table

    def _write(self, rows: DataFrame) -> str:
        """Write rows, dealt to the buckets and sorted, as a run."""
        number, self.made = self.made, self.made + 1
        self.every.append(f"{self.name}_{number}")
        rows.write.bucketBy(self.buckets, "k1").sortBy("k1", "k2").option("path", f"{self.folder}/run-{number}").saveAsTable(self.every[-1])
        return self.every[-1]

    def _save(self) -> None:
        numbers = [int(run.rsplit("_", 1)[1]) for run in self.runs]
        self.spark.createDataFrame([(self.made, self.buckets, numbers)], "made long, buckets int, runs array<long>").coalesce(1).write.json(f"{self.folder}/state-{self.made}")

    def history(self) -> DataFrame | None:
        """Keys of all runs; no key is in two of them."""
        keys = None
        for run in self.runs:
            part = self.spark.table(run).filter("NOT again").select("k1", "k2")
            keys = part if keys is None else keys.union(part)
        return keys

    def merge(self, places: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Merge a batch's places with the runs into a new run: the places that repeat an earlier one, and the first ones."""
        order, key = "spark.sql.legacy.bucketedTableScan.outputOrdering", [F.col("k1"), F.col("k2")]
        rows = places.select(*_FIELDS).repartition(self.buckets, "k1").withColumn("old", F.lit(False))
        for run in self.runs:
            past = self.spark.table(run).filter("NOT again").select(F.col("k1").alias("past"), F.col("k2").alias("past2"))
            # on the first half, by which the buckets lie; the second half is looked at in each pair
            both = (key[0] == F.col("past")) & (key[1].bitwiseXOR(F.col("past2")) == 0)
            rows = rows.join(past.hint("merge"), both, "left").select(*_FIELDS, (F.col("old") | F.col("past2").isNotNull()).alias("old"))
        before = self.spark.conf.get(order, None)
        self.spark.conf.set(order, "true")  # while this plan is made and run: sorted files are not sorted again
        try:
            ordered = rows.sortWithinPartitions(*key, "place", "doc", "at")  # by the first key already, where there are runs
            self.runs.append(self._write(ordered.mapInArrow(_marked, _PLACES)))
        finally:
            self.spark.conf.set(order, before) if before is not None else self.spark.conf.unset(order)
        run = self.spark.table(self.runs[-1])
        self.compact()
        self._save()
        return run.filter("again").select("place", "doc", "at", "span"), run.filter("NOT again").drop("again")

    def compact(self) -> None:
        """Merge the runs into one once there are more than most_runs."""
        if len(self.runs) > self.most_runs:
            keys = self.history().repartition(self.buckets, "k1").sortWithinPartitions("k1", "k2")
            self.runs = [self._write(keys.select(*[F.col(n) if n in ("k1", "k2") else F.lit(False).alias(n) if n == "again" else F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in _PLACES.split(", "))]))]

    def close(self, empty: bool = False) -> None:
        """Forget the tables of the runs, and let their files go too if empty."""
        for table in self.every:
            if empty:
                self.spark.range(0).write.mode("overwrite").parquet(f"{self.folder}/run-{table.rsplit('_', 1)[1]}")
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.runs, self.every = [], []


def _final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of documents, with the duplicate places found for them."""
    for batch in pieces(batches):
        out = [(doc_id, *Page(text).result(places or ())) for doc_id, text, places in zip(*(c.to_pylist() for c in batch.columns))]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame, batches: int = BATCHES, filtered: bool = True, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of docs.

    Documents go through the index in batches by rising doc_id. A null text has no words;
    rows without doc_id come last, with one of doc_id 2^63 - 1. Of rows that share their doc_id
    or have none, none is earlier than another: a window of theirs is a duplicate if a
    smaller doc_id has it, or the same text earlier on. Each row loses only what was found in
    it, told by its doc_id and a hash of its text. Repeated rows get the same result each.
    Texts of any length are read whole, one at a time; other columns are ignored; an empty table
    gives an empty result.

    With an index of one's own the texts merged into it before are earlier ones, and it
    stays for later calls: runs of stretches in its folder, of single windows in one below.
    Every window is then indexed, as without the filter. Without one an index is made for
    the call and emptied after it.
    """
    spark = docs.sparkSession
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    read = docs.select(place.alias("place"), F.xxhash64(place, F.col("text").cast("binary")).alias("doc"), F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    stretches = index or FingerprintIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    # keys of windows are never those of stretches, so they have runs of their own
    singles = FingerprintIndex(spark, f"{stretches.folder}/windows", stretches.most_runs, stretches.buckets)

    def batch(i: int) -> DataFrame:
        begin, end = (low + (high - low + 1) * k // batches for k in (i, i + 1))
        inside = [F.col("place") >= begin] * (i > 0) + [F.col("place") < end] * (i < batches - 1)
        part = read.select("place", "doc", "text")
        for condition in inside:
            part = part.filter(condition)
        return part

    try:
        found, cells = None, None
        for i in range(batches):
            again, new = stretches.merge(batch(i).mapInArrow(_stretch_rows, _PLACES))
            found, cells = (again, new) if i == 0 else (found.union(again), cells.union(new))
        cells = cells.select("doc", "cells").mapInArrow(_cell_rows(index is not None or not filtered), "anchor long, doc long, cell long, known boolean")
        cells = cells.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_recurring, "doc long, cell long")
        cells = settle(cells.groupBy("doc").agg(F.collect_set("cell").alias("cells")))
        if index is None:  # what the runs of stretches told is kept, they can go
            found = settle(found)
            stretches.close(empty=True)
        for i in range(batches):
            single, _ = singles.merge(batch(i).join(cells, "doc").select("place", "doc", "text", "cells").mapInArrow(_window_rows, _PLACES))
            found = found.union(single)
        found = found.groupBy("doc", "place").agg(F.collect_set(F.struct("at", "span")).alias("places"))
        result = read.join(found, ["doc", "place"], "left").select("doc_id", "text", "places").mapInArrow(_final, "doc_id long, n_words long, n_removed long, kept_sha256 string")
        return settle(result)
    finally:  # tables and files of a call that failed go too
        singles.close(empty=index is None)
        if index is None:
            stretches.close(empty=True)
