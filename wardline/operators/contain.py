"""Which parts (needles, names, words) a text contains, by an Aho-Corasick automaton.

The parts are dealt to slices of bounded size. A single slice goes to all tasks, which scan
the texts where they lie; several slices are met with blocks of texts in a grid, each
cell's parts first, its texts as a stream. A text is scanned once for each slice, however
many parts look alike, and what is returned is what was found, never pairs to be tried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Bytes of the parts of one slice, at about; an automaton takes some 50 times as many.
SLICE_BYTES = 2_000_000
#: Texts of a block at most, about.
BLOCK_TEXTS = 200_000


def automaton(parts: Iterable[tuple[str, int]]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for part, pos in parts:
        if part not in made or pos < made.get(part)[1]:
            made.add_word(part, (part, pos))
    made.make_automaton()
    return made


def _pairs(made, ids: list, texts: list, seen: set) -> Iterator[tuple]:
    for i, text in zip(ids, texts):
        for part in {p for _, (p, _) in made.iter(text)}:
            yield i, part, None


def _first(made, ids: list, texts: list, seen: set) -> Iterator[tuple]:
    for i, text in zip(ids, texts):
        least = min((pos for _, (_, pos) in made.iter(text)), default=None)
        if least is not None:
            yield i, None, least


def _any(made, ids: list, texts: list, seen: set) -> Iterator[tuple]:
    for i, text in zip(ids, texts):
        if next(made.iter(text), None):
            yield i, None, None


def _parts(made, ids: list, texts: list, seen: set) -> Iterator[tuple]:
    for text in texts:
        for part in {p for _, (p, _) in made.iter(text)} - seen:
            seen.add(part)
            yield None, part, None


#: What is asked: all pairs, the least position of a text's parts, texts with any part, or parts in any text.
ASKED = {"pairs": _pairs, "first": _first, "any": _any, "parts": _parts}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)


def _answers(found: Iterable[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    rows = []
    for row in found:
        rows.append(row)
        if len(rows) == most:
            yield _batch(rows, schema)
            rows = []
    if rows:
        yield _batch(rows, schema)


def _in_place(shared, ask: Callable, schema: pa.Schema) -> Callable:
    """Texts (id, text) scanned where they are, with the parts of a broadcast."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, seen = automaton(shared.value), set()
        for b in batches:
            if len(made):
                yield from _answers(ask(made, b.column(0).to_pylist(), b.column(1).to_pylist(), seen), schema)

    return run


def _by_cell(ask: Callable, schema: pa.Schema) -> Callable:
    """Rows (cell, is_text, id, text, pos) sorted by cell, its parts before its texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, made, seen = None, [], None, set()
        for b in batches:
            cells, kinds, ids, texts, places = (c.to_pylist() for c in b.columns)
            at = 0
            while at < len(cells):
                end = at
                while end < len(cells) and (cells[end], kinds[end]) == (cells[at], kinds[at]):
                    end += 1
                if cells[at] != now:
                    now, parts, made, seen = cells[at], [], None, set()
                if kinds[at]:
                    made = made or automaton(parts)
                    if len(made):
                        yield from _answers(ask(made, ids[at:end], texts[at:end], seen), schema)
                else:
                    parts += zip(texts[at:end], places[at:end])
                at = end

    return run


def found(texts: DataFrame, parts: DataFrame, ask: str = "pairs") -> DataFrame:
    """texts: id, text; parts: part and, for the least position, pos -> id, part, pos as asked.

    pairs: id and part of each part that a text contains, once; first: id and the least pos
    of its parts; any: the ids of texts with parts; parts: the parts that a text contains.
    Null texts contain nothing and an empty part is in none; ids should be distinct.
    """
    spark, kind = texts.sparkSession, texts.schema["id"].dataType
    schema = StructType([StructField("id", kind), StructField("part", StringType()), StructField("pos", LongType())])
    arrow = pa.schema([pa.field("id", pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()), pa.field("part", pa.string()), pa.field("pos", pa.int64())])
    pos = F.min("pos") if "pos" in parts.columns else F.lit(0)
    whole = parts.filter("length(part) > 0").groupBy("part").agg(pos.cast("long").alias("pos"))
    given = texts.filter("text IS NOT NULL").select("id", "text")
    size = whole.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    slices = -(-size // SLICE_BYTES)
    if slices <= 1:
        shared = spark.sparkContext.broadcast([tuple(r) for r in whole.collect()])  # SLICE_BYTES at most
        out = given.mapInArrow(_in_place(shared, ASKED[ask], arrow), schema)
    else:
        blocks = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // slices), -(-given.count() // BLOCK_TEXTS))
        of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        left = whole.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "*").select((F.col("block") * slices + of("part", slices)).cast("int").alias("cell"), F.lit(0).alias("is_text"), F.lit(None).cast(kind).alias("id"), F.col("part").alias("text"), "pos")
        right = given.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "*").select((of("id", blocks) * slices + F.col("slice")).cast("int").alias("cell"), F.lit(1).alias("is_text"), "id", "text", F.lit(None).cast("long").alias("pos"))
        dealt = left.union(right).repartitionById(blocks * slices, F.col("cell")).sortWithinPartitions("cell", "is_text")
        out = dealt.mapInArrow(_by_cell(ASKED[ask], arrow), schema)
    if ask == "pairs":
        return out.select("id", "part")
    if ask == "first":
        return out.groupBy("id").agg(F.min("pos").alias("pos"))
    return out.select("id" if ask == "any" else "part").distinct()
