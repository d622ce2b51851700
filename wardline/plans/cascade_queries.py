"""Queries of the cascades and of small rules on names, regions and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import address, text
from wardline.operators import cascades, joins, quality, resolve, tables

from .registry import Tables, query

REGIONS = ["Нижегородская область", "Республика Татарстан", "Алтайский край", "Самарская область", "Республика Саха (Якутия)"]


def _section(c):
    return F.concat(F.lit("Судебный участок №"), c.cast("string"))


def _pick(words, by):
    return F.element_at(F.array(*map(F.lit, words)), (by + 1).cast("int"))


def _box(x: float, y: float, size: float):
    return F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((x, y), (x + size, y), (x + size, y + size), (x, y + size))])


def _point_tables(t: Tables) -> dict:
    """Areas, courts and districts that the points of the queries lie in."""
    one = t.spark.range(1)
    area = lambda x, name, n: one.select(F.lit(n).alias("area_id"), F.lit(1).alias("kind"), _box(x, 10.0, 1.0).alias("ring"), F.lit(name).alias("court_name"), F.lit(n).alias("section_num"))
    places = lambda x: t.spark.range(20).select(F.col("id").alias("place_id"), (F.col("id") * 0.5 + 30.001).alias("plat"), F.lit(x).alias("plon"), _section(F.col("id")).alias("court_name"), F.col("id").alias("section_num"))
    districts = t.spark.createDataFrame([(1, "R", "Первый район", "Судебный участок №31"), (2, "R", "Второй", "Судебный участок №32"), (3, "Самарская область", "Приокский", "Судебный участок №33"), (4, "Томская область", "Советский район", "Судебный участок №34")], "id long, region string, district string, court_name string")
    return {"spatial": area(10.0, "P", 1), "areas": area(20.0, "A", 2), "courts": places(30.0), "more_courts": places(31.0), "districts": districts}


@query(
    """SELECT k AS row_id, CASE WHEN k % 5 = 4 THEN CASE WHEN k % 10 = 4 THEN 'courts_nearest' ELSE 'courts_geo' END ELSE ['postgis', 'court_districts', 'coordinates_district', 'coordinates_district_osm'][k % 5 + 1] END AS source,
  CASE WHEN k % 5 = 4 THEN k % 20 ELSE [1, 2, 31, 32][k % 5 + 1] END::VARCHAR AS section_num, k % 10 = 1 AS needs_review FROM (SELECT c_custkey AS k FROM customer)"""
)
def q_point_cascade(t: Tables) -> DataFrame:
    """Points found by the spatial store, the district table, two reverse geocoders and the nearest courts, in that order."""
    k = F.col("c_custkey")
    lat = F.when(k % 5 < 2, 10.5).when(k % 5 < 4, 60.0).otherwise(30 + (k % 20) * 0.5)
    lon = F.when(k % 5 == 0, 10.5).when(k % 10 == 1, 20.0002).when(k % 5 == 1, 20.5).when(k % 5 < 4, 60.0).when(k % 10 == 4, 30.0).otherwise(31.0)
    points = t.customer.select(k.alias("row_id"), lat.alias("lat"), lon.alias("lon"))
    first = t.customer.filter(k % 5 == 2).select(k.alias("row_id"), F.lit(1).alias("pos"), F.lit(" r").alias("region"), F.lit("первый").alias("district"), F.lit("x").alias("locality"))
    later = t.customer.filter(k % 5 == 3).select(k.alias("row_id"), F.lit(2).alias("pos"), F.lit("R").alias("region"), F.lit("Третий").alias("district"), F.lit("Второй").alias("locality"))
    return cascades.by_point(points, reverse=first.union(later), **_point_tables(t)).select("row_id", "source", "section_num", "needs_review")


@query(
    """SELECT k AS row_id, ['law_rules', 'address_district', 'dadata', 'court_districts'][k % 4 + 1] AS source, CASE k % 4 WHEN 0 THEN k % 30 WHEN 1 THEN 33 WHEN 2 THEN k % 50 ELSE 2 END::VARCHAR AS section_num,
  k % 8 = 3 AS needs_review, CASE WHEN k % 4 = 3 THEN 'semi' END AS level FROM (SELECT c_custkey AS k FROM customer)"""
)
def q_address_cascade(t: Tables) -> DataFrame:
    """Addresses found by rules, by their district, by the provider and by the geocoded point, in that order."""
    k = F.col("c_custkey")
    written = F.when(k % 4 == 0, F.concat(F.lit("ул. Линия"), (k % 30).cast("string"), F.lit(" Ватутина, д. 7"))).when(k % 4 == 1, "Самарская область, Приокский район, д. 5").otherwise("неведомо где")
    rows = t.customer.select(k.alias("row_id"), written.alias("address"), F.array().cast("array<string>").alias("lemmas"))
    none, i = F.lit(None), F.col("id")
    rules = t.spark.range(30).select(
        i.alias("rule_order"), i.cast("string").alias("section_num"), F.lit("").alias("region"), none.cast("string").alias("area_text"), F.concat(F.lit(r"линия"), i.cast("string"), F.lit(r"\s+(?:ватутина|гагарина)")).alias("street_pattern"),
        F.lit(1).alias("house_from"), F.lit(9).alias("house_to"), F.lit("odd").alias("house_parity"), none.cast("string").alias("house_suffix"), none.cast("int").alias("house_step"),
    )
    provider = t.customer.filter(k % 4 == 2).select(k.alias("row_id"), _section(k % 50).alias("court_name"), (k % 50).alias("section_num"))
    geocoded = t.customer.filter(k % 4 == 3).select(k.alias("row_id"), F.lit(10.5).alias("lat"), F.lit(20.5).alias("lon"), (k % 8 == 3).alias("needs_review"), F.lit("semi").alias("level"))
    tables_ = _point_tables(t)
    point_tables = {n: tables_[n] for n in ("areas", "courts", "districts")}
    return cascades.by_address(rows, rules, tables_["districts"], provider, geocoded, point_tables).select("row_id", "source", "section_num", "needs_review", "level")


@query(
    """SELECT k AS row_id, ['dadata', 'address_geo', 'passport_code', 'address', 'fio_sudrf', 'fallback_rule'][k % 6 + 1] AS source, CASE k % 6 WHEN 0 THEN k % 50 WHEN 1 THEN 7 WHEN 2 THEN 33 WHEN 3 THEN 34 ELSE 0 END::INTEGER AS section_num,
  CASE k % 6 WHEN 2 THEN 'Самарская область' WHEN 3 THEN 'Томская область' ELSE '' END AS region FROM (SELECT c_custkey AS k FROM customer)"""
)
def q_person_cascade(t: Tables) -> DataFrame:
    """The older order: provider, geocoded point, passport's region, address's region, registry, fallback."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    written = F.when(k % 6 < 2, "неведомо где").when(k % 6 == 2, "Приокский район, д. 5").when(k % 6 == 3, "Томская область, Советский район, д. 1")
    rows = t.customer.select(k.alias("row_id"), F.when(k % 6 == 4, F.col("c_name")).otherwise(none).alias("fio"), F.when(k % 6 == 2, "36 01 123456").alias("passport"), written.alias("address"))
    prefixes = t.spark.createDataFrame([("360", "Самарская область")], "prefix string, region string")
    some = lambda keep, name, number: t.customer.filter(keep).select(k.alias("row_id"), name.alias("court_name"), number.alias("section_num"))
    found = cascades.by_person(rows, _point_tables(t)["districts"], prefixes, some(k % 6 == 0, _section(k % 50), k % 50), some(k % 6 < 2, F.lit("B"), F.lit(7)), some(k % 6 >= 4, F.lit("C"), F.lit(0)))
    return found.select("row_id", "source", "section_num", "region")


@query(
    "SELECT c_custkey, [NULL, 'Нижегородская область', 'Республика Татарстан', 'Алтайский край', 'Республика Саха (Якутия)', 'Республика Адыгея', 'Республика Северная Осетия', 'Москва', 'Санкт-Петербург', 'Самарская область'][c_custkey % 10 + 1] AS region FROM customer"
)
def q_court_region(t: Tables) -> DataFrame:
    """The regions that courts' names stand for."""
    names = ["Суд", "Нижегородский областной суд", "Верховный суд Республики Татарстан", "Алтайский краевой суд", "Верховный суд Республики Саха (Якутия)", "Верховный суд Республики Адыгея", "Верховный суд Республики Северная Осетия - Алания", "Суд г. Москва", "Суд Санкт-Петербурга", "Суд, самарская область"]
    return t.customer.select("c_custkey", address.region_of_court(_pick(names, F.col("c_custkey") % 10), REGIONS).alias("region"))


@query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE ['г. Город, улица Мира, д. 5', 'область Край, проспект Мира', 'улица Дагестанская, д. 1'][c_custkey % 5 + 1] END AS address,
  CASE c_custkey % 5 WHEN 3 THEN 'Адрес слишком короткий' WHEN 4 THEN 'Адрес не указан' END AS error FROM customer"""
)
def q_service_normalize(t: Tables) -> DataFrame:
    """Addresses as the service writes them, or why it refuses them."""
    written = F.when(F.col("c_custkey") % 5 < 4, _pick([" гор. Город ,, ул Мира , д 5,", "обл. Край, пр. Мира", "ул. Дагестанская,  д.1", " abc ", ""], F.col("c_custkey") % 5))
    return t.customer.select("c_custkey", text.service_normalize(written).alias("n")).select("c_custkey", "n.address", "n.error")


@query("SELECT doc_id, list_aggregate(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{2,}'))), 'string_agg', ' ') AS numbers FROM documents WHERE regexp_matches(text, '[0-9]{2,}')")
def q_sorted_matches(t: Tables) -> DataFrame:
    """Distinct numbers of documents in the order of text."""
    found = text.sorted_matches(F.col("text"), "[0-9]{2,}", 0)
    return t.documents.select("doc_id", found.alias("found")).filter("size(found) > 0").select("doc_id", F.array_join("found", " ").alias("numbers"))


@query(
    """SELECT 'n' AS layer, n_nationkey AS key, row_number() OVER (ORDER BY n_nationkey) AS id FROM nation
UNION ALL SELECT 'r', r_regionkey, (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY r_regionkey) FROM region"""
)
def q_union_numbered(t: Tables) -> DataFrame:
    """Rows of several layers, numbered on from one to the next."""
    layers = [t.nation.select(F.lit("n").alias("layer"), F.col("n_nationkey").alias("key")), t.region.select(F.lit("r").alias("layer"), F.col("r_regionkey").alias("key"))]
    return tables.union_numbered(layers, "id", F.col("key"))


@query(
    """SELECT s_suppkey AS row_id, CASE WHEN s_suppkey % 2 = 0 THEN 'card ' || s_suppkey::VARCHAR ELSE s_name END AS court_name, CASE WHEN s_suppkey % 6 = 0 THEN 7 ELSE 1 END AS section_num, CASE WHEN s_suppkey % 4 = 0 THEN 'p' ELSE 'old' END AS phone FROM supplier"""
)
def q_card_overlay(t: Tables) -> DataFrame:
    """A directory's cards over courts: filled fields win, the section only where there is one."""
    k = F.col("s_suppkey")
    courts = t.supplier.select(k.alias("row_id"), F.col("s_name").alias("court_name"), F.lit(1).alias("section_num"), F.lit("old").alias("phone"))
    sections = F.when(k % 6 == 0, F.array(F.lit("7"))).otherwise(F.array(F.lit("7"), F.lit("8")))
    cards = t.supplier.filter(k % 2 == 0).select(k.alias("row_id"), F.concat(F.lit("card "), k.cast("string")).alias("name"), F.when(k % 4 == 0, "p").otherwise("").alias("phone"), sections.alias("section_numbers"))
    return resolve.overlay_card(courts, cards)


@query("SELECT coalesce(nullif(trim(lower(CASE event_type WHEN 'view' THEN ' ' WHEN 'click' THEN NULL ELSE event_type END)), ''), 'unknown') AS verdict, count(*) AS n FROM events GROUP BY 1")
def q_feedback_summary(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    said = F.when(kind == "view", " ").when(kind == "click", None).otherwise(F.concat(F.lit(" "), F.upper(kind)))
    return tables.feedback_summary(t.events.select(said.alias("verdict")))


@query(
    """WITH c AS (SELECT s_suppkey, 'Суд ' || (s_suppkey % 10)::VARCHAR AS court_name, CASE WHEN s_suppkey % 3 = 0 THEN 'Томская обл., Томск' WHEN s_suppkey % 3 = 1 THEN '1, г Москва' ELSE 'x' END AS address FROM supplier)
SELECT min(s_suppkey) AS s_suppkey, court_name, address, CASE address WHEN 'x' THEN 'old' WHEN '1, г Москва' THEN 'Москва' ELSE 'Томская область' END AS region FROM c GROUP BY court_name, address"""
)
def q_dedup_courts(t: Tables) -> DataFrame:
    """Courts once for each name and address, under the region that the address names."""
    k = F.col("s_suppkey")
    written = F.when(k % 3 == 0, "Томская обл., Томск").when(k % 3 == 1, "1, г Москва").otherwise("x")
    courts = t.supplier.select("s_suppkey", F.concat(F.lit("Суд "), (k % 10).cast("string")).alias("court_name"), written.alias("address"), F.lit("old").alias("region"))
    return tables.dedup_courts(courts, F.col("s_suppkey"))


@query(
    """SELECT n_nationkey AS area_id, CASE n_nationkey % 5 WHEN 3 THEN 'crosses itself' WHEN 4 THEN 'too few corners' END AS fault, CASE WHEN n_nationkey % 5 < 2 THEN 1 ELSE 0 END AS overlaps,
  CASE WHEN n_nationkey % 5 > 2 THEN 'error' WHEN n_nationkey % 5 < 2 THEN 'warning' ELSE 'ok' END AS status FROM nation"""
)
def q_area_verification(t: Tables) -> DataFrame:
    """Each area's own faults and its overlaps: in every row of five, a concave pair that overlaps, one alone, two faulty."""
    n = F.col("n_nationkey")
    x, y = (n % 5).cast("double"), F.floor(n / 5) * 10.0
    corners = lambda *at: F.array(*[F.struct((F.lit(float(a)) + dx).alias("x"), (y + b).alias("y")) for a, b, dx in at])
    zero = F.lit(0.0)
    concave = corners((0, 0, zero), (4, 0, zero), (4, 4, zero), (2, 1, zero), (0, 4, zero))
    over = corners((3, 2, zero), (5, 2, zero), (5, 3, zero), (3, 3, zero))
    apart = corners((1.9, 2, zero), (2.1, 2, zero), (2.1, 3, zero), (1.9, 3, zero))  # in the notch of the concave one
    crossing = corners((20, 0, zero), (22, 2, zero), (22, 0, zero), (20, 2, zero))
    few = corners((30, 0, zero), (31, 1, zero))
    ring = F.when(x == 0, concave).when(x == 1, over).when(x == 2, apart).when(x == 3, crossing).otherwise(few)
    return quality.verification(t.nation.select(n.alias("area_id"), ring.alias("ring"))).select("area_id", "fault", F.col("overlaps").cast("int").alias("overlaps"), "status")


@query(
    """WITH c AS (SELECT n_nationkey, lower(n_name) AS n FROM nation WHERE n_nationkey < 20),
p AS (SELECT c_custkey, lower(trim(CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN 'x № ' || (c_custkey % 40)::VARCHAR WHEN 2 THEN left(n_name, 4) WHEN 3 THEN 'the ' || n_name || ' court' ELSE ' ' END)) AS name, CASE WHEN c_custkey % 5 = 1 THEN c_custkey % 40 END AS section
  FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey AS row_id, name <> '' AND (EXISTS (SELECT 1 FROM c WHERE contains(c.n, p.name) OR contains(p.name, c.n)) OR EXISTS (SELECT 1 FROM c WHERE c.n_nationkey = p.section)) AS known FROM p"""
)
def q_membership(t: Tables) -> DataFrame:
    """Whether a catalogue knows a court: by name, by section, or one name inside the other."""
    k, name = F.col("c_custkey"), F.col("n_name")
    said = F.when(k % 5 == 0, F.upper(name)).when(k % 5 == 1, F.concat(F.lit("x № "), (k % 40).cast("string"))).when(k % 5 == 2, F.left(name, F.lit(4))).when(k % 5 == 3, F.concat(F.lit("the  "), name, F.lit(" court"))).otherwise(" ")
    names = t.customer.join(joins.dimension(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("row_id"), said.alias("name"))
    return joins.known_names(names, t.nation.filter("n_nationkey < 20").select(F.col("n_name").alias("court_name"), F.col("n_nationkey").alias("section_num"))).select("row_id", "known")


@query("SELECT c_custkey AS row_id, [1, 2, 3, 4, NULL, NULL][c_custkey % 6 + 1]::VARCHAR AS section_num, CASE WHEN c_custkey % 6 < 4 THEN 'law_rules_nlp_fuzzy' END AS source FROM customer")
def q_rule_lemmas(t: Tables) -> DataFrame:
    """Rules met by the lemmas of an address where no pattern is: equal words, or four letters that words begin with."""
    k = F.col("c_custkey") % 6
    lemmas = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in (["улица", "октябрьский"], ["садовый", "большой"], ["мир"], ["лесной"], ["река"], [])]), (k + 1).cast("int"))
    addresses = t.customer.select(F.col("c_custkey").alias("row_id"), F.lit("без улицы").alias("address"), lemmas.alias("lemmas"))
    none, patterns = None, ["Октябрьская", "Большая Садовая", "Мир", "Лесная|x", "лесн"]
    rules = [(i, str(i + 1 if i < 3 else 4), "", none, p, none, none, none, none, none) for i, p in enumerate(patterns)]
    table = t.spark.createDataFrame(rules, "rule_order int, section_num string, region string, area_text string, street_pattern string, house_from int, house_to int, house_parity string, house_suffix string, house_step int")
    return joins.rule_match(addresses, table).select("row_id", "section_num", "source")


@query(
    """SELECT c_custkey AS row_id, CASE WHEN c_custkey % 6 = 0 THEN '1' WHEN c_custkey % 6 = 1 AND c_custkey % 30 BETWEEN 1 AND 15 THEN '2' WHEN c_custkey % 6 = 2 THEN '3' WHEN c_custkey % 6 = 3 THEN '4' END AS section_num,
  CASE WHEN c_custkey % 6 = 0 OR c_custkey % 6 = 1 AND c_custkey % 30 BETWEEN 1 AND 15 OR c_custkey % 6 = 3 THEN 'law_rules_nlp_fuzzy' WHEN c_custkey % 6 = 2 THEN 'law_rules' END AS source FROM customer"""
)
def q_rule_stems(t: Tables) -> DataFrame:
    """Streets in any case meet their rules by the stems of the address's own words."""
    k = F.col("c_custkey")
    street = _pick(["по Октябрьской", "на Садовых", "ул. Мира", "за Гоголем", "у реки", "Невского"], k % 6)
    address = F.concat(F.lit("г. Самара, "), street, F.lit(", д. "), (k % 30).cast("string"))
    none = None
    patterns = [("Октябрьская", none, none), ("Садовая", 1, 15), (r"\bмира\b", none, none), ("Гоголь", none, none), ("Лесная", 1, 9)]
    rules = [(i, str(i + 1), "", none, p, a, b, none, none, none) for i, (p, a, b) in enumerate(patterns)]
    table = t.spark.createDataFrame(rules, "rule_order int, section_num string, region string, area_text string, street_pattern string, house_from int, house_to int, house_parity string, house_suffix string, house_step int")
    return joins.rule_match(t.customer.select(k.alias("row_id"), address.alias("address")), table).select("row_id", "section_num", "source")
