"""Exact dedup with Patricia tries.

Each task first merges its own rows in a compressed radix trie over the whole
normalised byte strings, so a group of copies leaves a task as one row however large it
is. Those rows are dealt by length and content hash; a second trie finds the owner of
each distinct text. A trie that outgrows its budget hands on its entries (first pass)
or spills whole subtrees to the task's temporary folder and takes them up one by one
(second pass).
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, kept_rows, pieces, settle

TRIE_BYTES = 32_000_000
NODE_BYTES = 260
Value = list  # [code points of the owner, no id?, its id, rows, rows alike in both], least owner first


class _Node:
    __slots__ = ("label", "below", "value", "file", "path")

    def __init__(self, label: bytes, value: Value | None = None):
        self.label, self.below, self.value = label, {}, value
        self.file, self.path = None, None


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Bytes that a and b[at:] begin with alike."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[at : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _merge(old: Value | None, new: Value) -> Value:
    if old is None:
        return new
    rows, (a, b) = old[3] + new[3], (old[:3], new[:3])
    return [*min(a, b), rows, old[4] + new[4] if a == b else (old if a < b else new)[4]]


class Trie:
    """Compressed radix trie from byte strings to owners.

    Of a spilled subtree a stub of one byte stays (below is None), whose keys go to its
    file from there on. What all keys of a file begin with is kept once, as the path.
    """

    def __init__(self, budget: int = TRIE_BYTES):
        self.budget, self.held, self.root = budget, 0, _Node(b"")
        self.spilled: list[tuple[object, bytes]] = []  # with what comes before their keys

    def add(self, key: bytes, value: Value) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                node.below[key[at]] = _Node(key[at:], value)
                self.held += len(key) - at + NODE_BYTES
                return
            if child.below is None:
                pickle.dump((key[at:], value), child.file)
                return
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _shared(child.label, key, at)  # split the edge
            upper = _Node(child.label[:n])
            child.label = child.label[n:]
            upper.below[child.label[0]] = child
            node.below[key[at]] = upper
            self.held += NODE_BYTES
            node, at = upper, at + n
        node.value = _merge(node.value, value)

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, Value]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.value is not None:
                yield prefix, node.value
            stack.extend((x, prefix) for x in (node.below or {}).values())

    def _sizes(self) -> tuple[dict[int, int], set[int]]:
        """Bytes held under each node, and the nodes that have stubs below; by id."""
        nodes, above = [self.root], [0]
        for i, node in enumerate(nodes):  # grows as it is read
            below = (node.below or {}).values()
            nodes.extend(below)
            above.extend([i] * len(below))
        sizes = [0 if n.below is None else len(n.label) + NODE_BYTES for n in nodes]
        cut = [n.below is None for n in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            sizes[above[i]] += sizes[i]
            cut[above[i]] |= cut[i]
        return {id(n): s for n, s in zip(nodes, sizes)}, {id(n) for n, c in zip(nodes, cut) if c}

    def _new_file(self, path: bytes):
        self.spilled.append((tempfile.TemporaryFile(), path))
        return self.spilled[-1][0]

    def spill(self) -> bool:
        """Move subtrees to files, the largest first, until half the budget is free; False if there are none.

        They are cut below the last node that holds over half of all, so neither one
        long key nor a long beginning that keys share is written again.
        """
        sizes, cut = self._sizes()
        node, labels = self.root, []
        while node.below:
            heavy = max(node.below.values(), key=lambda x: sizes[id(x)])
            if sizes[id(heavy)] <= self.held / 2:
                break
            node = heavy
            labels.append(node.label)
        found, open_ = [], [(node, labels)]
        while open_:
            site, labels = open_.pop()
            for child in (site.below or {}).values():
                if child.below is not None:
                    if id(child) in cut:
                        open_.append((child, [*labels, child.label]))
                    else:
                        found.append((sizes[id(child)], site, labels, child))
        for size, site, labels, child in sorted(found, key=lambda x: -x[0]):
            if self.held <= self.budget / 2:
                break
            if site.path is None:
                site.path = b"".join(labels)
            stub = _Node(child.label[:1])
            if size > self.budget / 64:
                stub.file = self._new_file(site.path)
            else:  # small subtrees share a file
                site.file = site.file or self._new_file(site.path)
                stub.file = site.file
            stub.below = None
            for entry in self._walk(child, b""):
                pickle.dump(entry, stub.file)
            site.below[child.label[0]] = stub
            self.held -= size
        return bool(found)

    def items(self) -> Iterator[tuple[bytes, Value]]:
        """All entries; each file is read back into a trie of its own, and so are the files that this makes."""
        yield from self._walk(self.root, b"")
        waiting, self.root, self.spilled = self.spilled, _Node(b""), []
        while waiting:
            file, path = waiting.pop()
            file.seek(0)
            part = Trie(self.budget)
            try:
                while True:
                    part.put(*pickle.load(file))
            except EOFError:
                file.close()
            yield from self._walk(part.root, path)
            waiting.extend((f, path + p) for f, p in part.spilled)

    def put(self, key: bytes, value: Value) -> None:
        """add, within the budget as far as entries can be parted."""
        self.add(key, value)
        while self.held > self.budget and self.spill():
            pass


def normal(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACE)


_TEXTS = "length long, sha binary, content binary, n long, id long, rows long, alike long"


def _rows(entries: Iterable[tuple[bytes, Value]], content: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.binary(), *[pa.binary()] * content, *[pa.int64()] * 4]
    names = [x.split()[0] for x in _TEXTS.split(", ") if content or not x.startswith("content")]
    part, held = [], 0
    for key, (n, no_id, doc_id, rows, alike) in entries:
        part.append((len(key), hashlib.sha256(key).digest(), *[key] * content, -n, None if no_id else doc_id, rows, alike))
        held += len(key) * content + 100
        if held > 4_000_000:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)
            part, held = [], 0
    if part:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie(TRIE_BYTES // 4)
    for batch in pieces(batches):
        for doc_id, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            trie.add(normal(text), [-n, doc_id is None, doc_id or 0, 1, 1])
            if trie.held > trie.budget:
                yield from _rows(trie.items(), True)
                trie = Trie(trie.budget)
    yield from _rows(trie.items(), True)


def _own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in pieces(batches):
        for content, n, doc_id, rows, alike in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            trie.put(content, [-n, doc_id is None, doc_id or 0, rows, alike])
    yield from _rows(trie.items(), False)


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        keys = [normal(t) for t in batch.column(2).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(map(len, keys), pa.int64()), pa.array([hashlib.sha256(k).digest() for k in keys], pa.binary())],
            names=["doc_id", "n", "text_hash", "length", "sha"],
        )


def decisions(docs: DataFrame) -> DataFrame:
    """The rows of groups(), with the xxhash64 of each row's text as text_hash.

    Of rows alike in all that decides, one is chosen by an aggregation, so that no task
    holds a group of copies.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long"), F.char_length(text).cast("long").alias("n"), text.cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    owners = (
        read.select("doc_id", "n", "text")
        .mapInArrow(_combine, _TEXTS)
        .repartition("length", "sha")
        .mapInArrow(_own, _TEXTS.replace("content binary, ", ""))
        .select("length", "sha", F.col("n").alias("most"), F.col("id").alias("owner"), "rows", "alike")
    )
    members = read.mapInArrow(_members, "doc_id long, n long, text_hash long, length long, sha binary")
    first = (F.col("n") == F.col("most")) & F.col("doc_id").eqNullSafe(F.col("owner"))
    joined = settle(members.join(owners, ["length", "sha"]).withColumns({"first": first, "row": F.monotonically_increasing_id()}))
    shown = ["doc_id", F.col("owner").alias("keep_id"), F.col("rows").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"), "text_hash"]
    several = F.col("first") & (F.col("alike") > 1)
    one = joined.filter(several).groupBy("length", "sha").agg(F.min("row").alias("row")).withColumn("chosen", F.lit(True))
    chosen = joined.filter(several).join(one, ["length", "sha", "row"], "left").withColumn("kept", F.col("chosen").isNotNull())
    return joined.filter(~several).withColumn("kept", F.col("first")).select(*shown).union(chosen.select(*shown))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Texts are equal when the same bytes remain without ASCII white space; null counts as
    empty. The row with the most code points stays, then the smallest doc_id (null last,
    given as keep_id null); of rows alike in that too, exactly one. Texts of any length are
    compared whole; a trie that outgrows its budget spills by subtree. An empty table gives
    an empty result; other columns are ignored.
    """
    return decisions(docs).drop("text_hash")


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the copies: of equal texts one row stays, columns unchanged.

    Null texts count as empty ones; of the rows of equal texts the one that groups() keeps
    stays, and of rows repeated in doc_id and text one. An empty table stays empty.
    """
    return kept_rows(docs, decisions(docs))
