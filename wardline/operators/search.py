"""The best entries of a directory for each address, by text score, with early stop.

Everything that the score adds up is a feature: a word of the address that an entry's text
contains, its house after a mark, the parity rule of one street. Which entries have
which feature is found by one scan of their texts (contain.py) and kept as posting lists
in shards of the directory. An address opens only its short lists; the entries in them are
scored by all features. What long lists, of words that most entries share, could add is
bounded by their weights: while that stays below the second best score found, they are never
opened, and otherwise the ranking by long lists alone, which alike addresses share, is walked
from its top until two entries are met that no short list holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from wardline.functions import text

from . import contain
from .shared import settle

#: Entries of a shard, and of a list that counts as short, at most.
SHARD_ENTRIES, SHORT = 50_000, 500
#: Kinds of features: contained text, house after a mark, parity class.
HELD, MARKED, PARITY = 0, 1, 2
PARTS = ["address", "region_code", "street", "district", "house"]


def features(most: int) -> Column:
    """What can add to an entry's score for an address of PARTS: array of (term, kind, weight, opens).

    opens: an entry with it is a candidate (one of the address's longest tokens).
    """
    street, district, house = F.col("street"), F.col("district"), F.trim("house")
    tokens = text.address_tokens(street, F.col("address"), district, street)
    longest = F.slice(F.array_sort(tokens, lambda a, b: F.length(b) - F.length(a)), 1, most)
    no, yes = F.lit(False), F.lit(True)
    one = lambda term, kind, weight, opens=no: F.struct(term.alias("term"), F.lit(kind).alias("kind"), (F.lit(weight) if isinstance(weight, int) else weight).cast("int").alias("weight"), opens.alias("opens"))
    when = lambda test, *all_of: F.when(test, F.array(*all_of)).otherwise(F.array().cast("array<struct<term:string,kind:int,weight:int,opens:boolean>>"))
    st, d = text.ru_lower(street), text.ru_lower(district)
    parts = F.filter(F.split(F.coalesce(d, F.lit("")), r"\s+"), lambda x: F.length(x) >= 4)
    n = F.regexp_extract(house, r"^(\d+)", 1).try_cast("decimal(38,0)")
    # The points for words, street, stem, district, house and parity.
    parity = lambda good, bad: [one(F.lit(good), PARITY, 55), one(F.lit("both"), PARITY, 55), one(F.lit(bad), PARITY, -52)]
    return F.concat(
        F.transform(tokens, lambda t: one(t, HELD, F.least(F.length(t), F.lit(12)), F.array_contains(longest, t))),
        when(text.not_blank(street), one(st, HELD, 28)),
        F.transform(F.filter(text.street_stems(street), lambda x: x != st), lambda x: one(x, HELD, 14)),
        when(text.not_blank(district), one(d, HELD, 22)),
        F.transform(parts, lambda x: one(x, HELD, 10)),
        when(text.not_blank(house) & (F.length(house) <= 5), one(house, HELD, 18), one(house, MARKED, 22)),
        when(text.not_blank(house) & (F.length(house) > 5), one(house, MARKED, 40)),
        when(text.not_blank(house) & (n % 2 == 1), *parity("odd", "even")),
        when(text.not_blank(house) & (n % 2 == 0), *parity("even", "odd")),
    )


def postings(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """entry_id, term, kind: which of the wanted features (term, kind) an entry (entry_id, blob) has."""
    texts = entries.select(F.col("entry_id").alias("id"), F.col("blob").alias("text"))
    terms = wanted.filter(F.col("kind") != PARITY).groupBy(F.col("term").alias("part")).agg(F.max((F.col("kind") == MARKED)).alias("house"), F.max(F.col("kind") == HELD).alias("held"))
    found = contain.found(texts, terms).join(terms, "part").select(F.col("id").alias("entry_id"), F.col("part").alias("term"), "house", "held")
    held = found.filter("held").select("entry_id", "term", F.lit(HELD).alias("kind"))
    near = F.regexp_like("blob", F.concat(F.lit(r"(?U)(?:д\.?|дом|№)\s*\Q"), F.col("term"), F.lit(r"\E\b")))
    marked = found.filter("house").join(entries, "entry_id").filter(near).select("entry_id", "term", F.lit(MARKED).alias("kind"))
    # The street and the words for even and odd houses after it.
    after = lambda word: F.regexp_like("blob", F.lit(rf"(?U)ильича[^.;]{{0,48}}дома\s+{word}"))
    kind = F.when(after("чет") & after("нечет"), "both").when(after("чет"), "even").when(after("нечет"), "odd")
    by_parity = entries.select("entry_id", kind.alias("term"), F.lit(PARITY).alias("kind")).filter("term IS NOT NULL")
    return held.union(marked).union(by_parity)


class Shard:
    """Posting lists over the entries 0..n-1 of a shard, which lie in the order of their ids."""

    def __init__(self, regions: list, lists: dict[tuple, np.ndarray]):
        self.regions = np.array(regions, object)
        self.lists = lists
        self.long = {k: np.bincount(v, minlength=len(regions)).astype(bool) for k, v in lists.items() if len(v) > SHORT}
        self.ranking = lru_cache(maxsize=64)(self._ranking)

    def _ranking(self, region: str | None, tail: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Entries with an opening feature of the tail, the best first, and the points that the tail gives them."""
        points, opened = np.zeros(len(self.regions), np.int32), np.zeros(len(self.regions), bool)
        for key, weight, opens in tail:
            points[self.long[key]] += weight
            if opens:
                opened |= self.long[key]
        if region is not None:
            opened &= self.regions == region
        at = np.flatnonzero(opened)
        order = np.lexsort((at, -points[at]))
        return at[order], points[at][order]

    def best(self, features: list[tuple], region: str | None, least: int) -> tuple[list[tuple[int, int]], int]:
        """The two best (entry, score), in the region if one is given, and how many entries were scored.

        features: (term, kind), weight, opens. Scores below least may be missing.
        """
        here = [(k, w, o) for k, w, o in features if k in self.lists]
        short, tail = [f for f in here if f[0] not in self.long], tuple(f for f in here if f[0] in self.long)
        seen = np.unique(np.concatenate([self.lists[k] for k, _, _ in short])) if short else np.zeros(0, np.int64)
        if region is not None and len(seen):
            seen = seen[self.regions[seen] == region]
        points, opened = np.zeros(len(seen), np.int64), np.zeros(len(seen), bool)
        for k, w, o in here:
            has = self.long[k][seen] if k in self.long else np.isin(seen, self.lists[k], assume_unique=True)
            points[has] += w
            if o:
                opened |= has
        at = np.flatnonzero(opened)
        at = at[np.lexsort((seen[at], -points[at]))][:2]
        found, looked = [(int(seen[i]), int(points[i])) for i in at], len(seen)
        reach = sum(w for _, w, _ in tail if w > 0)
        beaten = found[1][1] if len(found) > 1 else least
        if any(o for *_, o in tail) and reach >= max(beaten, least):
            ranked, given = self.ranking(region, tail)
            new, known = [], set(seen.tolist())
            for e, p in zip(ranked, given):
                looked += 1
                if e not in known:
                    new.append((int(e), int(p)))
                    if len(new) == 2:
                        break
            found = sorted(found + new, key=lambda x: (-x[1], x[0]))[:2]
        return found, looked


def _search(schema: pa.Schema, least: int):
    """Rows by cell: the shard's entries and lists first, then addresses as a stream."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, names, regions, lists = None, None, [], [], {}
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["cell"] != now:
                    now, shard, names, regions, lists = r["cell"], None, [], [], {}
                if r["names"] is not None:
                    names, regions = r["names"], r["regions"]
                elif r["ids"] is not None:
                    lists[r["term"], r["kind"]] = np.array(r["ids"], np.int64)
                else:
                    shard = shard or Shard(regions, lists)
                    given = [((f["term"], f["kind"]), f["weight"], f["opens"]) for f in r["features"]]
                    for home in (True, False) if r["region"] is not None else (False,):
                        found, looked = shard.best(given, r["region"] if home else None, -(1 << 30) if home else least)
                        out += [(r["probe"], home, names[e], points, looked) for e, points in found]
            if out:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def candidates(probes: DataFrame, entries: DataFrame, least: int, most: int) -> DataFrame:
    """probe, home, entry_id, score, looked: the two best entries of each shard for each address, in its region and at large.

    probes: _id and PARTS, each once; entries: entry_id (each once), region_code, blob. looked: entries scored for it in the shard.
    """
    spark, kind = entries.sparkSession, entries.schema["entry_id"].dataType
    tall = probes.select("_id", "region_code", F.explode(features(most)).alias("f")).select("_id", "region_code", "f.*")
    summed = settle(tall.groupBy("_id", "region_code", "term", "kind").agg(F.sum("weight").cast("int").alias("weight"), F.max("opens").alias("opens")))
    asked = summed.groupBy("_id", "region_code").agg(F.collect_list(F.struct("term", "kind", "weight", "opens")).alias("features"))
    n = entries.count()
    shards = max(1, -(-n // SHARD_ENTRIES))
    blocks = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    of = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k))
    numbered = entries.select("entry_id", "region_code", of("entry_id", shards).alias("shard")).withColumn("nth", F.row_number().over(Window.partitionBy("shard").orderBy("entry_id")) - 1)
    named = numbered.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("nth", "entry_id", "region_code"))).alias("all"))
    lists = postings(entries.select("entry_id", "blob"), summed.select("term", "kind").distinct()).join(numbered, "entry_id").groupBy("shard", "term", "kind").agg(F.sort_array(F.collect_list("nth")).alias("ids"))
    none = lambda t: F.lit(None).cast(t)
    made = "array<struct<term:string,kind:int,weight:int,opens:boolean>>"
    cell = lambda shard, block: (shard * blocks + block).cast("int").alias("cell")
    every_block, every_shard = (F.explode(F.sequence(F.lit(0), F.lit(k - 1))) for k in (blocks, shards))
    first = named.withColumn("block", every_block).select(cell(F.col("shard"), F.col("block")), F.lit(0).alias("stage"), F.col("all.entry_id").alias("names"), F.col("all.region_code").alias("regions"), none("string").alias("term"), none("int").alias("kind"), none("array<int>").alias("ids"), none("long").alias("probe"), none("string").alias("region"), none(made).alias("features"))
    second = lists.withColumn("block", every_block).select(cell(F.col("shard"), F.col("block")), F.lit(1), none(f"array<{kind.simpleString()}>"), none("array<string>"), "term", "kind", F.col("ids").cast("array<int>"), none("long"), none("string"), none(made))
    third = asked.withColumn("shard", every_shard).select(cell(F.col("shard"), of("_id", blocks)), F.lit(2), none(f"array<{kind.simpleString()}>"), none("array<string>"), none("string"), none("int"), none("array<int>"), "_id", "region_code", "features")
    dealt = first.union(second).union(third).repartitionById(shards * blocks, F.col("cell")).sortWithinPartitions("cell", "stage")
    schema = StructType([StructField("probe", first.schema["probe"].dataType), StructField("home", BooleanType()), StructField("entry_id", kind), StructField("score", IntegerType()), StructField("looked", IntegerType())])
    arrow = pa.schema([("probe", pa.int64()), ("home", pa.bool_()), ("entry_id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())), ("score", pa.int32()), ("looked", pa.int32())])
    assert kind == StringType() or arrow.field("entry_id").type != pa.string(), "entry_id is a whole number or text"
    return dealt.mapInArrow(_search(arrow, least), schema)
