"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests (DataFrame functions only).

A text is the set of the digests of its paragraphs (lines, and of long lines parts that
end with a sentence; repeats count once). Each digest goes into three of a sketch's
cells, which sum up counts, keys and check bits by plus and exclusive or. Subtracting the
sketches of two versions leaves the paragraphs that differ; cells that hold one of them
give it away and are peeled until all cells are empty, which recovers the digests of
either side. How many differ is first estimated by one stratum of the digests, and the
sketches begin at the size for that; if they don't empty, both sets are sketched anew,
larger: split by digest into four times as many blocks of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SUBTABLES, WIDTH = 3, 8
CELLS = SUBTABLES * WIDTH
#: Blocks at the largest size: 4 to this power, for some 2.6 million digests that differ. Beyond it, texts of
#: over 100 MB with nothing in common, the digests are compared one by one.
MOST_LEVEL = 9
#: Digests that differ which a block of cells is meant for, and the digests of which one is in the stratum.
A_BLOCK, STRATUM = 10, 8
#: Lines of more characters are cut after sentences that end with a letter of the alphabet's first half, so at
#: places that depend on what is there.
LONG_LINE = 300
SENTENCE_END = "(?<=[a-mA-M][.!?]) +"

_CELL = "named_struct('n', {n}, 'key', {key}, 'check', {check})"
_ZERO = _CELL.format(n="0", key="0L", check="0L")


def digests(text: str) -> Column:
    """Digests of the paragraphs of a text column."""
    parts = f"transform(split({text}, '\\n'), line -> if(length(line) > {LONG_LINE}, split(line, '{SENTENCE_END}'), array(line)))"
    return F.expr(f"array_distinct(transform(flatten({parts}), paragraph -> xxhash64(paragraph)))")


def _hashed(key: str, level: str, more: str = "") -> str:
    """struct(key, h, and its cell in each subtable c0, c1, c2)."""
    cells = ", ".join(f"'c{i}', int(shiftrightunsigned(h, {8 * i}) & {WIDTH - 1}) + {WIDTH * i}" for i in range(SUBTABLES))
    return f"element_at(transform(array(xxhash64({key}, {level})), h -> named_struct({more}'key', {key}, 'h', h, {cells})), 1)"


def _add(cell: str, n: str, key: str, h: str) -> str:
    return _CELL.format(n=f"{cell}.n + {n}", key=f"{cell}.key ^ {key}", check=f"{cell}.check ^ shiftrightunsigned({h}, 32)")


def _sketch(keys: str, level: str) -> str:
    """Cells of an array of keys; hashes differ by level."""
    hashed = f"transform({keys}, k -> {_hashed('k', level)})"
    table = lambda t: f"transform(sequence({WIDTH * t}, {WIDTH * t + WIDTH - 1}), i -> aggregate(filter(hs, x -> x.c{t} = i), {_ZERO}, (c, x) -> {_add('c', '1', 'x.key', 'x.h')}))"
    return f"element_at(transform(array({hashed}), hs -> concat({', '.join(table(t) for t in range(SUBTABLES))})), 1)"


_NONE = "named_struct('mine', cast(array() AS array<bigint>), 'others', cast(array() AS array<bigint>))"


def _side(named: str, n: int) -> str:
    return f"transform(filter({named}, x -> x.n = {n}), x -> x.key)"


def _peel(cells: str, level: str) -> str:
    """Peel subtracted cells: struct(cells, found: the keys recovered of either side, done)."""
    pure = f"filter(s.cells, c -> abs(c.n) = 1 AND c.check = shiftrightunsigned(xxhash64(c.key, {level}), 32))"
    named = "array_distinct(transform({}, c -> {}))".format(pure, _hashed("c.key", level, "'n', c.n, "))
    rest = f"transform(s.cells, (c, i) -> aggregate(filter(p, x -> x.c0 = i OR x.c1 = i OR x.c2 = i), c, (c2, x) -> {_add('c2', '-x.n', 'x.key', 'x.h')}))"
    more = f"named_struct('mine', concat(s.found.mine, {_side('p', 1)}), 'others', concat(s.found.others, {_side('p', -1)}))"
    step = f"element_at(transform(array({named}), p -> if(size(p) = 0, named_struct('cells', s.cells, 'found', s.found, 'done', true), named_struct('cells', {rest}, 'found', {more}, 'done', false))), 1)"
    start = f"named_struct('cells', {cells}, 'found', {_NONE}, 'done', false)"
    return f"aggregate(sequence(1, {CELLS}), {start}, (s, turn) -> if(s.done, s, {step}))"


def _minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> {_CELL.format(n='x.n - y.n', key='x.key ^ y.key', check='x.check ^ y.check')})"


def _emptied(peeled: str) -> str:
    """The keys recovered, null if cells are left."""
    return f"element_at(transform(array({peeled}), r -> if(exists(r.cells, c -> c.n != 0 OR c.key != 0 OR c.check != 0), null, r.found)), 1)"


def _blocks(keys: str, level: str) -> str:
    """The keys dealt into 4 ** level blocks by their low bits."""
    deal = "flatten(transform(parts, p -> transform(sequence(0, 3), q -> filter(p, k -> (shiftrightunsigned(k, 2 * t - 2) & 3) = q))))"
    return f"if({level} = 0, array({keys}), aggregate(sequence(1, {level}), array({keys}), (parts, t) -> {deal}))"


def level_for(a: str, b: str) -> str:
    """The power of 4 of blocks to begin with, by how many digests of the stratum differ."""
    stratum = [f"filter({x}, k -> shiftrightunsigned(k, 40) % {STRATUM} = 0)" for x in (a, b)]
    apart = f"(size(array_except({stratum[0]}, {stratum[1]})) + size(array_except({stratum[1]}, {stratum[0]})))"
    return f"cast(least({MOST_LEVEL}, ceil(log(4, greatest(1, {apart} * {STRATUM} / {A_BLOCK})))) AS int)"


def difference(a: str, b: str, cells_a: str, cells_b: str) -> Column:
    """mine, others: the digests of array column a alone and of b alone, by peeling; cells_*: their smallest sketches."""
    first = _emptied(_peel(_minus(cells_a, cells_b), "0"))
    block = _emptied(_peel(_minus(_sketch("z.a", "l"), _sketch("z.b", "l")), "l"))
    both = "named_struct('mine', concat(n.mine, m.mine), 'others', concat(n.others, m.others))"
    whole = f"aggregate(zip_with({_blocks(a, 'l')}, {_blocks(b, 'l')}, (x, y) -> named_struct('a', x, 'b', y)), {_NONE}, (n, z) -> if(n IS NULL, null, element_at(transform(array({block}), m -> if(m IS NULL, null, {both})), 1)))"
    larger = f"element_at(transform(array({level_for(a, b)}), begin -> coalesce(if(begin = 0, {first}, null), aggregate(sequence(greatest(1, begin), {MOST_LEVEL}), cast(null AS struct<mine: array<bigint>, others: array<bigint>>), (n0, l) -> coalesce(n0, {whole})))), 1)"
    by_one = f"named_struct('mine', array_except({a}, {b}), 'others', array_except({b}, {a}))"
    return F.expr(f"coalesce({larger}, {by_one})")


def likeness(differ: Column, a: Column, b: Column) -> Column:
    """Shared share of two sets of sizes a and b that differ in so many members."""
    return (a + b - differ) / (a + b + differ)


def written(cells: str) -> Column:
    """A sketch as text: count, key and check of each cell, in base 64."""
    cell = "concat(lpad(hex(c.n & 65535), 4, '0'), lpad(hex(c.key), 16, '0'), lpad(hex(c.check), 8, '0'))"
    return F.expr(f"base64(unhex(array_join(transform({cells}, c -> {cell}), '')))")


def _followers(keys: DataFrame) -> DataFrame:
    """id, th, n -> also next_id, next_th: the next row by descending id, the first after the last.

    Rows are dealt by ranges; only the first row of each range is looked at across them.
    """
    order = [F.col("id").desc(), F.col("th").desc()]
    ranged = settle(keys.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))
    firsts = ranged.groupBy("pid").agg(F.max(F.struct("id", "th")).alias("first"))
    follow = F.lead("first").over(Window.orderBy("pid"))
    top = F.first("first").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("pid", F.coalesce(follow, top).alias("other"))  # one row for each range
    inside = F.lead(F.struct("id", "th")).over(Window.partitionBy("pid").orderBy(*order))
    return (
        ranged.withColumn("inside", inside)
        .join(F.broadcast(firsts), "pid")
        .withColumn("next", F.coalesce("inside", "other"))
        .select("id", "th", "n", F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th"))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, only_here, only_edited: one row per row of docs.

    The last two are the paragraph digests recovered by peeling: those of the text that
    the edited text lacks, and those of the edited text alone.

    A null text is empty, which is one empty paragraph. Rows without doc_id come last.
    Rows alike in doc_id and text share one place in the order, so they have the same
    next document, which is a different one unless there is no other. Texts of any length
    are sketched whole, a paragraph that repeats once. Other columns are ignored; an empty
    table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    no_id = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    keys = rows.select("id", "th", F.char_length("text").alias("n")).distinct()
    edges = settle(_followers(keys)).withColumn("cut", F.floor(F.col("n") / 3).cast("int"))
    receivers = edges.select(F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.col("id").alias("to_id"), F.col("th").alias("to_th"), "cut")
    texts = rows.select("id", "th", "text")  # dealt once, for senders and receivers
    sent = texts.join(receivers, ["id", "th"]).select(
        F.col("to_id").alias("id"), F.col("to_th").alias("th"), "cut", F.expr("left(text, cut)").alias("begin"), digests("text").alias("next")
    )
    if keys.count() < rows.count():  # rows alike send the same
        sent = sent.groupBy("id", "th").agg(F.first("cut").alias("cut"), F.first("begin").alias("begin"), F.first("next").alias("next"))
    joined = texts.join(sent, ["id", "th"])
    edited = joined.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.expr("concat(left(text, int(n_chars) - cut), begin)"))
    sets = edited.select(F.nullif("id", no_id).alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests("text").alias("own"), digests("edited").alias("other"), "next")
    cells = sets.withColumns({c: F.expr(_sketch(k, "0")) for c, k in (("own_cells", "own"), ("other_cells", "other"))})
    # the next document's smallest sketch is made only where so small a difference is expected
    apart = cells.withColumns({"apart_edited": difference("own", "other", "own_cells", "other_cells"), "apart_next": difference("own", "next", "own_cells", _sketch("next", "0"))})
    differ = lambda c: F.size(f"{c}.mine") + F.size(f"{c}.others")
    return apart.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written("own_cells").alias("fingerprint"),
        written("other_cells").alias("edited_fingerprint"),
        likeness(differ("apart_edited"), F.size("own"), F.size("other")).alias("near_edited"),
        likeness(differ("apart_next"), F.size("own"), F.size("next")).alias("near_next"),
        F.array_sort("apart_edited.mine").alias("only_here"),
        F.array_sort("apart_edited.others").alias("only_edited"),
    )
