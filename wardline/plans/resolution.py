"""Queries of votes, candidates and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import grades, text
from wardline.operators import joins, reports, resolve, votes

from .registry import SQL_KM, Tables, lat, lon, query, sql_point, sql_round

VOTES_SQL = """
WITH ranked AS (
  SELECT user_id AS probe, event_id AS pos, event_type, 'K' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS court_key,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth
  FROM events WHERE event_type <> 'error' AND value IS NOT NULL),
v AS (
  SELECT probe, pos, court_key, 'Court ' || court_key || repeat('*', CAST(pos % 4 AS INTEGER)) AS court_name,
    CASE event_type WHEN 'purchase' THEN 'polygon' WHEN 'signup' THEN 'dadata' WHEN 'view' THEN 'dagalin' ELSE 'district_db' END AS source,
    CASE event_type WHEN 'purchase' THEN 10 WHEN 'signup' THEN 8 WHEN 'view' THEN 5 ELSE 3 END AS w
  FROM ranked WHERE nth = 1)
"""


def event_votes(t: Tables) -> DataFrame:
    """The first event of each user and type as a vote."""
    kind = F.col("event_type")
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    first = t.events.filter((kind != "error") & F.col("value").isNotNull()).withColumn("nth", nth).filter("nth = 1")
    key = F.concat(F.lit("K"), (F.floor("value").cast("long") % 3).cast("string"))
    return first.select(
        F.col("user_id").alias("probe"),
        F.col("event_id").alias("pos"),
        F.when(kind == "purchase", "polygon").when(kind == "signup", "dadata").when(kind == "view", "dagalin").otherwise("district_db").alias("source"),
        F.concat(F.lit("Court "), key, F.repeat(F.lit("*"), (F.col("event_id") % 4).cast("int"))).alias("court_name"),
        key.alias("court_key"),
        F.when(kind == "purchase", 1.0).when(kind == "signup", 0.8).when(kind == "view", 0.5).otherwise(0.3).alias("weight"),
    )


@query(
    VOTES_SQL
    + """,
sums AS (SELECT probe, court_key, sum(w) AS s, min(pos) AS first FROM v GROUP BY ALL),
ranked_sums AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY s DESC, first) AS nth FROM sums),
top AS (SELECT probe, max(CASE WHEN nth = 1 THEN court_key END) AS court_key, max(CASE WHEN nth = 1 THEN s END) AS winner, coalesce(max(CASE WHEN nth = 2 THEN s END), 0) AS second, count(*) AS n_keys FROM ranked_sums GROUP BY probe),
poly AS (SELECT probe, arg_min(court_key, pos) AS polygon_key FROM v WHERE source = 'polygon' GROUP BY probe),
facts AS (
  SELECT top.*, poly.polygon_key, n.n_votes,
    coalesce(EXISTS (SELECT 1 FROM v WHERE v.probe = top.probe AND v.w >= 8 AND v.court_key <> poly.polygon_key), false) AS against
  FROM top LEFT JOIN poly USING (probe) JOIN (SELECT probe, count(*) AS n_votes FROM v GROUP BY probe) n USING (probe)),
named AS (SELECT v.probe, v.court_name, row_number() OVER (PARTITION BY v.probe ORDER BY length(v.court_name) DESC, v.pos) AS nth FROM v JOIN top USING (probe, court_key)),
flags AS (SELECT *, n_keys = n_votes AND n_votes >= 3 AS all_differ,
    (n_keys > 1 AND winner - second <= 5) OR against OR (n_keys > 1 AND second >= 8) AS clash FROM facts)
SELECT probe, named.court_name, court_key,
  CASE WHEN all_differ THEN 0.3 ELSE least(winner, 20) / 10.0 END::DOUBLE AS confidence_score,
  CASE WHEN all_differ THEN 'all sources differ'
    WHEN against AND court_key = polygon_key THEN 'polygon against other sources'
    WHEN winner >= 10 AND court_key = polygon_key THEN 'polygon and street'
    WHEN winner >= 8 THEN 'street and houses' WHEN winner >= 5 THEN 'street only' ELSE 'low sum' END AS reason,
  all_differ OR winner < 15 OR clash AS needs_manual_review, all_differ OR clash AS conflict, n_votes
FROM flags JOIN named USING (probe) WHERE named.nth = 1"""
)
def q_vote_resolution(t: Tables) -> DataFrame:
    return votes.resolve(event_votes(t))


@query(VOTES_SQL + "SELECT court_key, count(DISTINCT court_name) AS n_names FROM v GROUP BY 1 HAVING count(DISTINCT court_name) > 1")
def q_vote_collisions(t: Tables) -> DataFrame:
    return votes.key_collisions(event_votes(t))


LOOKUP_SQL = """
WITH courts AS (
  SELECT s_suppkey AS id, r_name AS region, n_name || CASE WHEN n_nationkey % 2 = 1 THEN ' район' ELSE '' END AS district, s_name AS court_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
probes AS (
  SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 1 THEN lower(r_name) ELSE '  ' || r_name END AS region,
    CASE WHEN c_custkey % 4 = 2 THEN lower(n_name) || ' ' ELSE n_name END AS district
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
hits AS (
  SELECT row_id, variant, court_name, row_number() OVER (PARTITION BY row_id ORDER BY variant, id) AS nth
  FROM (SELECT row_id, region, lower(trim(district)) AS d, 0 AS variant FROM probes UNION ALL SELECT row_id, region, lower(trim(district)) || ' район', 1 FROM probes) p
  JOIN courts ON lower(trim(p.region)) = lower(trim(courts.region)) AND d = lower(trim(courts.district)))
SELECT row_id, h.court_name, h.variant FROM probes LEFT JOIN (SELECT * FROM hits WHERE nth = 1) h USING (row_id)
"""


def _place(t: Tables, table: DataFrame, key: str) -> DataFrame:
    return table.join(t.nation, F.col(key) == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))


@query(LOOKUP_SQL)
def q_district_lookup(t: Tables) -> DataFrame:
    """Lookup by region and district, exact first, then with the suffix."""
    courts = _place(t, t.supplier, "s_nationkey").select(
        F.col("s_suppkey").alias("id"),
        F.col("r_name").alias("region"),
        F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 1, " район").otherwise("")).alias("district"),
        F.col("s_name").alias("court_name"),
    )
    probes = _place(t, t.customer, "c_nationkey").select(
        F.col("c_custkey").alias("row_id"),
        F.when(F.col("c_custkey") % 3 == 1, F.lower("r_name")).otherwise(F.concat(F.lit("  "), "r_name")).alias("region"),
        F.when(F.col("c_custkey") % 4 == 2, F.concat(F.lower("n_name"), F.lit(" "))).otherwise(F.col("n_name")).alias("district"),
    )
    return joins.district_lookup(probes, courts).select("row_id", "court_name", "variant")


@query(
    "SELECT c_custkey, n_name AS region FROM customer LEFT JOIN nation ON lpad(CAST(n_nationkey * 4 AS VARCHAR), 3, '0') = left(lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0'), 3)"
)
def q_prefix_map_join(t: Tables) -> DataFrame:
    prefixes = t.nation.select(F.lpad((F.col("n_nationkey") * 4).cast("string"), 3, "0").alias("prefix"), F.col("n_name").alias("region"))
    number = F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0")
    passport = F.concat(F.left(number, F.lit(2)), F.lit(" "), F.substring(number, 3, 4))
    return joins.prefix_lookup(t.customer.select("c_custkey", passport.alias("passport")), "passport", prefixes).select("c_custkey", "region")


@query(
    """SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN ' ' ELSE c_name END), ''),
  nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END), ''), s_name, 'none') AS name
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"""
)
def q_sparse_merge(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    base = {"name": F.when(k % 3 == 0, "").when(k % 3 == 1, " ").otherwise(F.col("c_name"))}
    others = [{"name": F.when(k % 2 != 0, F.col("c_mktsegment"))}, {"name": F.col("s_name")}, {"name": F.lit("none")}]
    merged = resolve.merge_sparse(base, others)
    return t.customer.join(t.supplier, F.col("s_suppkey") == k, "left").select("c_custkey", merged["name"].alias("name"))


@query(
    """WITH d AS (SELECT n_regionkey::VARCHAR || '|' || n_nationkey::VARCHAR AS k, 'ACC' || lpad(n_nationkey::VARCHAR, 4, '0') AS account FROM nation WHERE n_nationkey % 5 <> 0)
SELECT c_custkey, d.account FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN d ON d.k = n_regionkey::VARCHAR || '|' || n_nationkey::VARCHAR"""
)
def q_composite_lookup(t: Tables) -> DataFrame:
    """Payment details by region and section."""
    details = t.nation.filter("n_nationkey % 5 != 0").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("section_num"), F.concat(F.lit("ACC"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("account"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("section_num"))
    return joins.composite_lookup(rows, details).select("c_custkey", "account")


@query(
    """WITH needles AS (SELECT * FROM (VALUES (0, 'bolt', 'R1'), (1, 'red', 'R2'), (2, 'small', 'R3'), (3, 'ring', 'R4')) n(pos, needle, region))
SELECT p_partkey AS row_id, (SELECT arg_min(region, pos) FROM needles WHERE contains(lower(p_name), needle)) AS region FROM part"""
)
def q_needle_region(t: Tables) -> DataFrame:
    needles = t.spark.createDataFrame([(0, "bolt", "R1"), (1, "red", "R2"), (2, "small", "R3"), (3, "ring", "R4")], "pos int, needle string, region string")
    return joins.needle_lookup(t.part.select(F.col("p_partkey").alias("row_id"), "p_name"), "p_name", needles).select("row_id", "region")


def _courts(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("entry_id"), F.concat(F.lit("Судебный участок №"), F.col("s_suppkey").cast("string"), F.lit(" "), F.col("s_name")).alias("court_name"))


@query(
    """WITH e AS (SELECT s_suppkey AS entry_id, 'Судебный участок №' || s_suppkey::VARCHAR || ' ' || s_name AS court_name FROM supplier),
n AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 2 = 0 THEN ' СУДЕБНЫЙ УЧАСТОК №' || (c_custkey % 50)::VARCHAR || ' supplier#' || lpad((c_custkey % 50)::VARCHAR, 9, '0') ELSE 'участок № ' || (c_custkey % 70)::VARCHAR END AS name FROM customer)
SELECT row_id, coalesce(x.entry_id, y.entry_id) AS entry_id FROM n
LEFT JOIN e x ON lower(trim(name)) = lower(trim(x.court_name))
LEFT JOIN e y ON y.entry_id = CASE WHEN row_id % 2 = 0 THEN row_id % 50 ELSE row_id % 70 END
WHERE coalesce(x.entry_id, y.entry_id) IS NOT NULL"""
)
def q_name_link(t: Tables) -> DataFrame:
    """Entries by exact name, else by section number."""
    k = F.col("c_custkey")
    even = F.concat(F.lit(" СУДЕБНЫЙ УЧАСТОК №"), (k % 50).cast("string"), F.lit(" supplier#"), F.lpad((k % 50).cast("string"), 9, "0"))
    names = t.customer.select(k.alias("row_id"), F.when(k % 2 == 0, even).otherwise(F.concat(F.lit("участок № "), (k % 70).cast("string"))).alias("name"))
    return joins.name_link(names, _courts(t)).select("row_id", "entry_id")


GEO_SQL = f"""
WITH two AS (
  SELECT o_orderkey AS row_id, {sql_point('o_orderkey')}, o_orderkey % 7 AS d, o_orderkey % 4 AS c1, o_orderkey % 3 AS c2 FROM orders),
b AS (SELECT row_id, lat AS alat, lon AS alon, lat + (d - 3) * 0.0004 AS blat, lon AS blon, 4 - c1 AS r1, 4 - c2 AS r2 FROM two),
k AS (SELECT *, {SQL_KM.format(a='a', b='b')} * 1000 <= 100.0 AS agree FROM b)
SELECT row_id, {sql_round('CASE WHEN agree THEN (1.0::DOUBLE * alat + 0.9::DOUBLE * blat) / 1.9::DOUBLE WHEN r1 >= r2 THEN alat ELSE blat END', 6)} AS lat,
  agree, CASE WHEN agree OR r1 >= r2 THEN r1 ELSE r2 END AS confidence_rank,
  CASE CASE WHEN agree OR r1 >= r2 THEN r1 ELSE r2 END WHEN 4 THEN 'auto' WHEN 3 THEN 'semi' WHEN 2 THEN 'manual' ELSE 'external' END AS level
FROM k"""


@query(GEO_SQL)
def q_geocode_consensus(t: Tables) -> DataFrame:
    """Two geocoders' results averaged where they agree, else the surer one."""
    k = F.col("o_orderkey")
    level = lambda c: F.when(c == 4, "exact").when(c == 3, "street").when(c == 2, "city").otherwise("low")
    first = t.orders.select(k.alias("row_id"), F.lit("yandex").alias("source"), F.lit(1).alias("pos"), lat("o_orderkey").alias("lat"), lon("o_orderkey").alias("lon"), level(4 - k % 4).alias("confidence"))
    second = t.orders.select(k.alias("row_id"), F.lit("dadata").alias("source"), F.lit(2).alias("pos"), (lat("o_orderkey") + (k % 7 - 3) * 0.0004).alias("lat"), lon("o_orderkey").alias("lon"), level(4 - k % 3).alias("confidence"))
    out = resolve.geocode_consensus(first.union(second))
    return out.select("row_id", reports.rounded(F.col("lat"), 6).alias("lat"), "agree", grades.geocode_rank(F.col("confidence")).alias("confidence_rank"), "level")


CANDIDATES_SQL = """
WITH c AS (
  SELECT o_orderkey AS row_id, 'D' AS stage, 'dagalin' AS source, 'K' || (o_orderkey % 3)::VARCHAR AS court_name, 5 AS w, 3 AS pos FROM orders WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT o_orderkey, 'A', 'district_table', 'K' || (o_orderkey % 4)::VARCHAR, 3, 4 FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, 'B', 'dadata', 'K' || (o_orderkey % 2)::VARCHAR, 8, 2 FROM orders WHERE o_orderkey % 7 < 3),
s AS (SELECT row_id, court_name, sum(w) AS s, min(pos) AS first FROM c GROUP BY ALL),
w AS (SELECT row_id, arg_min(court_name, -s * 10 + first) AS winner, max(s) AS top FROM s GROUP BY row_id),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.row_id ORDER BY CASE stage WHEN 'D' THEN 1 WHEN 'B' THEN 2 ELSE 4 END) AS nth FROM c JOIN w ON c.row_id = w.row_id AND c.court_name = w.winner)
SELECT row_id, stage, court_name, source FROM r WHERE nth = 1"""


@query(CANDIDATES_SQL)
def q_staged_resolution(t: Tables) -> DataFrame:
    """Candidates of several sources voted on, and the winner's candidate taken by order."""
    k = F.col("o_orderkey")
    part = lambda keep, stage, source, n: t.orders.filter(keep).select(k.alias("row_id"), F.lit(stage).alias("stage"), F.lit(source).alias("source"), F.concat(F.lit("K"), (k % n).cast("string")).alias("court_name"), (k % n).cast("string").alias("section_num"))
    candidates = part(k % 5 != 0, "D", "dagalin", 3).union(part(k % 3 != 0, "A", "district_table", 4)).union(part(k % 7 < 3, "B", "dadata", 2))
    return resolve.resolve_addresses(candidates).select("row_id", "stage", F.upper("court_name").alias("court_name"), "source")


@query(
    """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 5 = 0 THEN 'a' WHEN o_orderkey % 3 = 0 THEN 'b' WHEN o_orderkey % 2 = 0 THEN 'c' END AS court_name,
  CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 2 = 0 THEN 2 END AS stage FROM orders"""
)
def q_cascade(t: Tables) -> DataFrame:
    """The first stage that has a candidate."""
    keys = t.orders.select(F.col("o_orderkey").alias("row_id"))
    stages = [keys.filter(F.col("row_id") % n == 0).withColumn("court_name", F.lit(name)) for n, name in ((5, "a"), (3, "b"), (2, "c"))]
    return resolve.cascade(keys, stages).select("row_id", "court_name", "stage")


@query(
    """SELECT p_partkey AS row_id, min(rule_order) AS rule_order FROM part JOIN
 (SELECT i AS rule_order, 'brand#' || (i % 25)::VARCHAR AS brand, 1 + i % 20 AS house_from, 10 + i % 40 AS house_to, CASE i % 3 WHEN 0 THEN 'even' WHEN 1 THEN 'odd' END AS parity, CASE WHEN i % 4 = 0 THEN 3 END AS step FROM range(200) r(i)) rules
 ON lower(p_brand) = brand AND p_size >= house_from AND p_size <= house_to AND (parity IS NULL OR (p_size % 2 = 0) = (parity = 'even')) AND (step IS NULL OR (p_size - house_from) % step = 0)
GROUP BY 1"""
)
def q_rule_range_join(t: Tables) -> DataFrame:
    """Street patterns with house ranges, parity and step; the first rule counts."""
    i = F.col("id")
    rules = t.spark.range(200).select(
        i.alias("rule_order"),
        i.cast("string").alias("section_num"),
        F.lit("").alias("region"),
        F.lit("").alias("area_text"),
        F.concat(F.lit(r"(?i)\bbrand#"), (i % 25).cast("string"), F.lit(r"\b")).alias("street_pattern"),
        (1 + i % 20).cast("int").alias("house_from"),
        (10 + i % 40).cast("int").alias("house_to"),
        F.when(i % 3 == 0, "even").when(i % 3 == 1, "odd").alias("house_parity"),
        F.lit(None).cast("string").alias("house_suffix"),
        F.when(i % 4 == 0, 3).alias("house_step"),
    )
    address = F.concat(F.col("p_brand"), F.lit(", д. "), F.col("p_size").cast("string"))
    addresses = t.part.select(F.col("p_partkey").alias("row_id"), address.alias("address"), F.array().cast("array<string>").alias("lemmas"))
    return joins.rule_match(addresses, rules).filter("section_num IS NOT NULL").select("row_id", F.col("section_num").cast("long").alias("rule_order"))


@query(
    """WITH e AS (SELECT p_brand AS entry_id, lower(p_brand || ' ' || string_agg(DISTINCT p_name, ' ' ORDER BY p_name)) AS blob FROM part GROUP BY p_brand),
p AS (SELECT DISTINCT p_name, p_type FROM part),
tok AS (SELECT p_name, p_type, list_distinct(list_filter(list_concat(string_split(lower(p_name || ' ' || p_type), ' '), [lower(p_name)]), lambda x: length(x) >= 3)) AS ts FROM p),
s AS (SELECT p_name, p_type, entry_id,
  list_sum(list_transform(ts, lambda x: CASE WHEN contains(blob, x) THEN least(length(x), 12) ELSE 0 END)) +
  CASE WHEN contains(blob, lower(p_name)) THEN 28 ELSE 0 END + CASE WHEN contains(blob, lower(p_type)) THEN 22 ELSE 0 END +
  coalesce(list_sum(list_transform(list_filter(string_split(lower(p_type), ' '), lambda x: length(x) >= 4), lambda x: CASE WHEN contains(blob, x) THEN 10 ELSE 0 END)), 0) AS score
  FROM tok, e WHERE len(list_filter(ts, lambda x: contains(blob, x))) > 0),
r AS (SELECT *, row_number() OVER w AS nth, lead(score) OVER w AS next_score FROM s WINDOW w AS (PARTITION BY p_name, p_type ORDER BY score DESC, entry_id))
SELECT p_name, p_type, entry_id, score::INTEGER AS score, coalesce(score - next_score < 8 AND next_score >= 12, false) AS needs_review FROM r WHERE nth = 1 AND score >= 12"""
)
def q_text_score_top1(t: Tables) -> DataFrame:
    """The best directory entry by text score."""
    parts = t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("jurisdiction_text"))
    entries = parts.select(F.col("p_brand").alias("entry_id"), F.lit(None).cast("string").alias("region_code"), F.col("p_brand").alias("court_name"), "jurisdiction_text")
    probes = t.part.select("p_name", "p_type").distinct().select(
        F.concat_ws("|", "p_name", "p_type").alias("row_id"), F.concat_ws(" ", "p_name", "p_type").alias("address"), F.lit(None).cast("string").alias("region_code"), F.col("p_name").alias("street"), F.col("p_type").alias("district"), F.lit(None).cast("string").alias("house")
    )
    found = joins.text_top1(probes, entries)
    parts = F.split("row_id", r"\|")
    return found.select(parts[0].alias("p_name"), parts[1].alias("p_type"), "entry_id", "score", "needs_review")
