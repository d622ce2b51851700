"""Containment, top-1 search, interval joins and stems against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.functions import text
from wardline.operators import contain, intervals, joins, search

RULES = "rule_order int, section_num string, region string, area_text string, street_pattern string, house_from int, house_to int, house_parity string, house_suffix string, house_step int"


@pytest.mark.parametrize("slice_bytes", [2_000_000, 40])
def test_contained_parts_against_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(contain, "SLICE_BYTES", slice_bytes)
    draw = random.Random(3)
    texts = ["".join(draw.choices("абв ", k=draw.randint(0, 12))) for _ in range(200)] + ["судья ё" * 3]
    parts = ["".join(draw.choices("абв", k=draw.randint(0, 4))) for _ in range(60)] + ["ё", "судья"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(999, None)], "id long, text string")
    p = spark.createDataFrame([(x, i) for i, x in enumerate(parts)] + [(None, 1)], "part string, pos int")
    want = {(i, x) for i, t_ in enumerate(texts) for x in parts if x and x in t_}
    assert sorted(map(tuple, contain.found(t, p).collect())) == sorted(want)
    first = {i: min(k for k, x in enumerate(parts) if x and x in texts[i]) for i, _ in want}
    assert dict(map(tuple, contain.found(t, p, "first").collect())) == first
    assert {r.id for r in contain.found(t, p, "any").collect()} == {i for i, _ in want}
    assert {r.part for r in contain.found(t, p, "parts").collect()} == {x for _, x in want}
    assert contain.found(t, p.filter("false")).count() == 0 and contain.found(t.filter("false"), p).count() == 0


def test_alike_names_meet_without_pairs(spark):
    """10^5 names against 10^5 that begin and end alike; what is made on the way stays in proportion."""
    name = lambda c: F.concat(F.lit("Судебный участок мирового судьи "), F.lpad(c.cast("string"), 6, "0"), F.lit(" района"))
    names = spark.range(100_000).select(F.col("id").alias("row_id"), name(F.col("id")).alias("name"))
    catalogue = spark.range(50_000, 150_000).select(name(F.col("id")).alias("court_name"), F.lit(None).cast("int").alias("section_num"))
    folded = names.select(F.col("name").alias("id"), F.col("name").alias("text"))
    assert contain.found(folded, catalogue.select(F.col("court_name").alias("part"))).count() == 50_000
    assert joins.known_names(names, catalogue).groupBy("known").count().orderBy("known").collect() == [(False, 50_000), (True, 50_000)]


def test_alike_rules_meet_only_their_addresses(spark):
    rules = spark.range(2000).select(
        F.col("id").cast("int").alias("rule_order"), F.col("id").cast("string").alias("section_num"), F.lit("").alias("region"), F.lit(None).cast("string").alias("area_text"),
        F.concat(F.lit(r"(?i)\bулицаx"), F.translate(F.lpad(F.col("id").cast("string"), 4, "0"), "0123456789", "абвгдежзик"), F.lit(r"\b")).alias("street_pattern"),
        F.lit(1).alias("house_from"), F.lit(20).alias("house_to"), *[F.lit(None).cast(t).alias(n) for n, t in (("house_parity", "string"), ("house_suffix", "string"), ("house_step", "int"))],
    )
    street = F.concat(F.lit("улицаx"), F.translate(F.lpad((F.col("id") % 2000).cast("string"), 4, "0"), "0123456789", "абвгдежзик"))
    addresses = spark.range(6000).select(F.col("id").alias("row_id"), F.concat(street, F.lit(", д. "), (F.col("id") % 40 + 1).cast("string")).alias("address"), F.array().cast("array<string>").alias("lemmas"))
    probes = addresses.withColumn("house", text.house_of(F.lower("address")))
    assert joins.rule_pairs(probes, rules).count() <= 12_000
    got = {r.row_id: r.section_num for r in joins.rule_match(addresses, rules).collect()}
    assert got == {i: str(i % 2000) if i % 40 < 20 else None for i in range(6000)}


def brute_top1(probes, entries, least=12, gap=8, most=8):
    """Every address scored with every entry by text.text_score."""
    tokens = text.address_tokens(F.col("street"), F.col("address"), F.col("district"), F.col("street"))
    longest = F.slice(F.array_sort(tokens, lambda a, b: F.length(b) - F.length(a)), 1, most)
    e = entries.withColumn("blob", text.ru_lower(F.concat_ws(" ", "court_name", "jurisdiction_text"))).withColumnRenamed("region_code", "entry_region")
    both = probes.crossJoin(e).withColumn("tokens", tokens).filter(F.exists(longest, lambda t: F.contains(F.col("blob"), t)))
    home = F.coalesce(F.col("region_code") == F.col("entry_region"), F.lit(False))
    both = both.withColumn("home", home).withColumn("any_home", F.max("home").over(Window.partitionBy("row_id"))).filter("home = any_home")
    scored = both.withColumn("score", text.text_score(F.col("blob"), F.col("tokens"), F.col("street"), F.col("district"), F.col("house")))
    order = Window.partitionBy("row_id").orderBy(F.col("score").desc(), "entry_id")
    top = scored.withColumn("next", F.lead("score").over(order)).withColumn("nth", F.row_number().over(order)).filter((F.col("nth") == 1) & (F.col("score") >= least))
    return sorted((r.row_id, r.entry_id, r.score, bool(r.next is not None and r.next >= least and r.score - r.next < gap)) for r in top.collect())


@pytest.mark.parametrize("short,shard", [(500, 50_000), (3, 50), (0, 17)])
def test_top1_with_early_stop_is_that_of_all_pairs(spark, monkeypatch, short, shard):
    monkeypatch.setattr(search, "SHORT", short)
    monkeypatch.setattr(search, "SHARD_ENTRIES", shard)
    draw = random.Random(8)
    streets = ["Гагарина", "Ленина", "Ильича", "Мира", "Большая Садовая", "Октябрьская", "Лесного", "пр. Победы"]
    districts = ["Приокский район", "Советский район", "Канавинский", None, ""]
    towns = ["Нижний Новгород", "Самара", "Пермь"]

    def jurisdiction():
        out = [f"район города {draw.choice(towns)}"]
        for _ in range(draw.randint(0, 4)):
            s = draw.choice(streets).lower()
            out.append(draw.choice([f"ул. {s}, дом {draw.randint(1, 30)}", f"{s[:-1]}у, дома {draw.choice(['четные', 'нечетные'])}", f"{s} д.{draw.randint(1, 9)}а", f"проспект {s}", f"№ {draw.randint(1, 12)}"]))
        return "; ".join(out)

    entries = [(i, draw.choice(["52", "63", None]), f"Судебный участок №{i} {draw.choice(districts) or ''}", jurisdiction()) for i in range(120)]
    probes = []
    for i in range(80):
        street, district, house = draw.choice(streets + [None, " "]), draw.choice(districts), draw.choice(["5", "12", "7а", "строение 4", None, " "])
        probes.append((i, f"{draw.choice(towns)}, {district or 'район'}, ул. {street or ''}, {house or ''}", draw.choice(["52", "63", "99", None]), street, district, house))
    p = spark.createDataFrame(probes, "row_id int, address string, region_code string, street string, district string, house string")
    e = spark.createDataFrame(entries, "entry_id long, region_code string, court_name string, jurisdiction_text string")
    want = brute_top1(p, e)
    got = sorted((r.row_id, r.entry_id, r.score, r.needs_review) for r in joins.text_top1(p, e).collect())
    assert got == want and len(want) > 40


def test_a_word_of_all_entries_is_not_met_by_all_addresses(spark):
    """«район» is in each of 20,000 entries and 300 addresses; an address has few entries scored."""
    entries = spark.range(20_000).select("id", F.concat(F.lit("район город участок улица"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("blob")).select(F.col("id").alias("entry_id"), F.lit(None).cast("string").alias("region_code"), "blob")
    lit = lambda c: F.lit(c).cast("string")
    probes = spark.range(300).select(F.col("id").alias("_id"), F.when(F.col("id") % 3 == 0, "район").otherwise(F.concat(F.lit("район город улица"), F.lpad((F.col("id") * 7).cast("string"), 5, "0"))).alias("address"), lit(None).alias("region_code"), lit(None).alias("street"), lit(None).alias("district"), lit(None).alias("house"))
    got = search.candidates(probes, entries, 5, 8).collect()
    assert max(r.looked for r in got) <= 10
    best = {}
    for r in got:
        if r.probe not in best or (-r.score, r.entry_id) < best[r.probe]:
            best[r.probe] = (-r.score, r.entry_id)
    assert all(best[i][1] == (0 if i % 3 == 0 else 7 * i) for i in range(300))


def test_bins_cover_each_number_of_an_interval_once(spark):
    draw = random.Random(4)
    rows = [(i, draw.randint(0, 300), draw.randint(0, 300)) for i in range(300)] + [(900, 0, 255), (901, 7, 7), (902, None, 3), (903, 0, 2047)]
    df = spark.createDataFrame(rows, "i int, low int, high int").withColumn("bins", intervals.covers(F.col("low"), F.col("high"), 8))
    for r in df.collect():
        held = [n for b in r.bins for n in range(b.bin << b.level, (b.bin + 1) << b.level)]
        assert sorted(held) == (list(range(r.low, r.high + 1)) if r.low is not None and r.low <= r.high else [])
        assert len(r.bins) <= 2 * 8 + 8


def test_interval_join_with_open_ends_and_left_rows(spark):
    draw = random.Random(5)
    intervals_ = [(draw.choice("ab"), draw.choice([None, draw.randint(-50, 50)]), draw.choice([None, draw.randint(-50, 50)]), i) for i in range(60)] + [(None, 0, 9, 99)]
    probes = [(i, draw.choice(["a", "b", "c", None]), draw.randint(-60, 60)) for i in range(200)] + [(999, "a", None)]
    left = spark.createDataFrame(probes, "row int, street string, house int")
    right = spark.createDataFrame(intervals_, "street string, low int, high int, nth int")
    want = sorted((r, k) for r, s, n in probes for t, lo, hi, k in intervals_ if s is not None and s == t and n is not None and (lo is None or lo <= n) and (hi is None or n <= hi))
    got = intervals.interval_join(left, right, ["street"], "house")
    assert sorted((r.row, r.nth) for r in got.collect()) == want
    kept = intervals.interval_join(left, right, ["street"], "house", how="left")
    alone = {r[0] for r in probes} - {r for r, _ in want}
    assert sorted((r.row, r.nth) for r in kept.filter("nth IS NOT NULL").collect()) == want and {r.row for r in kept.filter("nth IS NULL").collect()} == alone


def test_one_street_of_many_ranges(spark):
    """10^5 ranges of one street and 10^6 houses: joined on bins, no comparison by range in the plan."""
    ranges_ = spark.range(100_000).select(F.lit("улица").alias("street"), (F.col("id") * 17 % 500_000).alias("low"), (F.col("id") * 17 % 500_000 + F.col("id") % 7).alias("high"))
    houses = spark.range(1_000_000).select(F.lit("улица").alias("street"), (F.col("id") % 500_000).alias("house"))
    met = intervals.interval_join(houses, ranges_, ["street"], "house")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "house#" in plan and not any(f"({a}#" in line and ("<=" in line or ">=" in line) for line in plan.splitlines() if "Join" in line for a in ("low", "high"))
    i = np.arange(100_000)
    edge = np.zeros(500_008, np.int64)
    np.add.at(edge, i * 17 % 500_000, 1)
    np.subtract.at(edge, i * 17 % 500_000 + i % 7 + 1, 1)
    assert met.count() == 2 * int(np.cumsum(edge)[:500_000].sum())


def test_genitive_streets_meet_their_rules_without_lemmas(spark):
    words = ["октябрьской", "октябрьская", "ленина", "садовых", "гагариным", "мира", "лес", "площадями"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.stem(F.col("w"))).collect()
    assert [r[0] for r in got] == ["октябрьск", "октябрьск", "ленин", "садов", "гагарин", "мир", "лес", "площад"]
    rule = (1, "7", None, None, "(?i)октябрьск", None, None, None, None, None)
    other = (2, "8", None, None, "Садовая", 1, 9, None, None, None)
    addresses = spark.createDataFrame([(1, "г. Самара, ул. Октябрьской, д. 5"), (2, "дома по Садовой, д. 5"), (3, "дома по Садовой, д. 50"), (4, "Мира, 1"), (5, None)], "row_id int, address string")
    got = {r.row_id: (r.section_num, r.source) for r in joins.rule_match(addresses, spark.createDataFrame([rule, other], RULES)).collect()}
    assert got == {1: ("7", "law_rules"), 2: ("8", "law_rules_nlp_fuzzy"), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_interval_totals_as_counted_pairs(spark):
    draw = random.Random(6)
    intervals_ = [(draw.choice("ab"), draw.choice([None, draw.randint(-50, 50)]), draw.choice([None, draw.randint(-50, 50)]), i) for i in range(80)] + [(None, 0, 9, 99), ("a", -5, 5, 7)]
    probes = [(i, draw.choice(["a", "b", "c", None]), draw.randint(-60, 60)) for i in range(200)] + [(999, "a", None)]
    want = {}
    for r, s, n in probes:
        held = [k for t, lo, hi, k in intervals_ if s is not None and s == t and n is not None and (lo is None or lo <= n) and (hi is None or n <= hi)]
        if held:
            want[r] = (len(held), min(held))
    got = intervals.interval_totals(spark.createDataFrame(probes, "row int, street string, house int"), spark.createDataFrame(intervals_, "street string, low int, high int, nth int"), ["street"], "house", "nth")
    assert {r.row: (r.n_ranges, r.first) for r in got.collect()} == want


def test_interval_totals_make_no_pairs(spark):
    """20,000 houses of one number in 20,000 ranges would be 4 * 10^8 pairs."""
    k = F.col("id")
    one = spark.range(20_000).select(F.lit("a").alias("street"), F.lit(1).alias("low"), F.lit(9).alias("high"), k, F.lit(5).alias("house"))
    got = intervals.interval_totals(one.select("street", "house"), one, ["street"], "house", "id")
    assert got.groupBy("n_ranges", "first").count().collect() == [(20_000, 0, 20_000)]
