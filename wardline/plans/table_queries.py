"""Queries of sets, dedup, upserts, windows, caches and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import grades
from wardline.operators import reports, tables

from .registry import Tables, query, sql_round


@query("SELECT n FROM range(0, 15001) r(n) WHERE n NOT IN (SELECT o_custkey FROM orders)")
def q_gaps(t: Tables) -> DataFrame:
    """Whole numbers of a range that a column lacks."""
    return tables.missing_numbers(t.orders, "o_custkey", 0, 15000)


@query("SELECT k, 'missing' AS side FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT k, 'extra' FROM (SELECT l_orderkey AS k FROM lineitem EXCEPT SELECT o_orderkey FROM orders)")
def q_two_way_diff(t: Tables) -> DataFrame:
    return tables.two_way_difference(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), "k")


@query(
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS nth FROM lineitem) WHERE nth = 1"""
)
def q_keep_first_dedup(t: Tables) -> DataFrame:
    return tables.keep_first(t.lineitem, ["l_partkey", "l_suppkey"], F.col("l_orderkey"), F.col("l_linenumber")).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), source, lang")
def q_collapsed_dedup(t: Tables) -> DataFrame:
    """Keep-first by text with white space collapsed."""
    key = F.sha2(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ").cast("binary"), 256)
    return tables.keep_first(t.documents.withColumn("key", key), ["key", "source", "lang"], F.col("doc_id")).select("source", "lang", "doc_id")


@query(
    """SELECT coalesce(n.k, o.k) AS k, coalesce(n.bal, o.bal) AS bal, CASE WHEN n.k IS NOT NULL THEN n.seg ELSE o.seg END AS seg FROM
(SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN
(SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal + 1 END AS bal, lower(c_mktsegment) AS seg FROM customer WHERE c_custkey % 2 = 0) n ON o.k = n.k"""
)
def q_upsert_partial(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    new = c.filter("k % 2 = 0").select("k", F.when(F.col("k") % 4 != 0, F.col("bal") + 1).alias("bal"), F.lower("seg").alias("seg"))
    return tables.upsert_partial(c.filter("k % 3 != 0"), new, "k", ["bal"])


UPSERT_SQL = """
WITH o AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
n AS (SELECT k, v FROM (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nth FROM orders WHERE o_orderkey % 5 = 0) WHERE nth = 1)
"""


def _upsert_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return o.filter("v % 2 = 0").groupBy("k").agg(F.max("v").alias("v")), o.filter("v % 5 = 0")


@query(UPSERT_SQL + "SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)")
def q_upsert_key(t: Tables) -> DataFrame:
    """Upsert by key; the last of several new rows wins."""
    return tables.upsert(*_upsert_sides(t), ["k"], F.col("v"))


@query(UPSERT_SQL + "SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)")
def q_insert_ignore(t: Tables) -> DataFrame:
    old, new = _upsert_sides(t)
    return tables.insert_ignore(old, tables.keep_first(new, ["k"], F.col("v").desc()), ["k"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT s_suppkey, s_name FROM supplier")
def q_replace_by_predicate(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    new = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("").alias("c_mktsegment"))
    return tables.replace_where(c, F.col("c_mktsegment") == "BUILDING", new).select("c_custkey", "c_name")


@query("SELECT p_partkey, coalesce('sec' || s_suppkey::VARCHAR, p_type) AS p_type FROM part LEFT JOIN supplier ON s_suppkey = CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT)")
def q_update_by_section(t: Tables) -> DataFrame:
    """Contacts of a section set on all rows whose first number is the section."""
    contacts = t.supplier.select(F.col("s_suppkey").cast("int").alias("section"), F.concat(F.lit("sec"), F.col("s_suppkey").cast("string")).alias("p_type"))
    section = F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("int")
    return tables.update_by_section(t.part.select("p_partkey", "p_brand", "p_type"), contacts, "p_type", section).select("p_partkey", "p_type")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def q_fill_down(t: Tables) -> DataFrame:
    rows = t.events.withColumn("section", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return tables.fill_down(rows, "section", ["user_id"], F.col("ts"), F.col("event_id")).select("event_id", "section")


@query("SELECT event_id, user_id, event_type, previous FROM (SELECT *, lag(trim(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous IS NOT NULL AND trim(event_type) <> previous")
def q_status_change(t: Tables) -> DataFrame:
    return tables.changes(t.events, "user_id", "event_type", F.col("ts"), F.col("event_id")).select("event_id", "user_id", "event_type", "previous")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events")
def q_rate_sliding(t: Tables) -> DataFrame:
    """Events of the user in the hour before each, itself included."""
    window = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return t.events.select("event_id", F.count("*").over(window).alias("n"))


@query("SELECT user_id, epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) // 1000000 AS began, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2")
def q_rate_tumbling(t: Tables) -> DataFrame:
    """Users at or over a limit in fixed windows."""
    counted = t.events.groupBy("user_id", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return counted.filter("n >= 2").select("user_id", F.unix_seconds(F.col("w.start").cast("timestamp")).alias("began"), "n")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, epoch_us(min(ts)) AS began, count(*) AS n FROM s GROUP BY user_id, session"""
)
def q_rate_session(t: Tables) -> DataFrame:
    """A counter that each hit re-arms for an hour."""
    counted = t.events.groupBy("user_id", F.session_window("ts", "3600 seconds").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return counted.select("user_id", F.unix_micros(F.col("first").cast("timestamp")).alias("began"), "n")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAYS, ts)) // 1000000 AS began, count(*) AS n, count(*) >= 100 AS alert FROM events GROUP BY ALL")
def q_threshold_alert(t: Tables) -> DataFrame:
    counted = t.events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return counted.select("event_type", F.unix_seconds(F.col("w.start").cast("timestamp")).alias("began"), "n", (F.col("n") >= 100).alias("alert"))


@query(
    """WITH newest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events)
SELECT user_id::VARCHAR AS key, event_id AS value FROM newest WHERE nth = 1 AND ts + to_seconds(CASE WHEN value >= 90 THEN 30 WHEN value >= 70 THEN 7 ELSE 1 END * 86400) > (SELECT max(ts) FROM events)"""
)
def q_ttl_cache(t: Tables) -> DataFrame:
    """Live entries of a cache whose lifetime depends on the confidence."""
    e = t.events
    now = F.lit(e.agg(F.max("ts")).first()[0])
    cache = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("value"), F.col("ts").alias("stored_at"), (grades.ttl_days(F.col("value") / 100) * 86400).alias("ttl_s"))
    return tables.live_entries(cache, now).select("key", "value")


@query(
    """SELECT k, CASE WHEN k % 4 = 0 THEN 'memory' WHEN k % 3 = 0 THEN 'shared' WHEN k % 5 = 0 THEN 'file' ELSE 'fetch' END AS from_cache FROM (SELECT DISTINCT user_id AS k FROM events)"""
)
def q_read_through_levels(t: Tables) -> DataFrame:
    keys = t.events.select(F.col("user_id").alias("k"))
    return tables.read_through(keys, [(name, keys.filter(F.col("k") % n == 0)) for name, n in (("memory", 4), ("shared", 3), ("file", 5))], "k")


@query("SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def q_purge(t: Tables) -> DataFrame:
    """What stays when old entries are deleted."""
    newest = F.lit(t.events.agg(F.max("ts")).first()[0])
    return t.events.filter(F.col("ts") > newest - F.expr("INTERVAL 7 DAYS")).select("event_id", "user_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 2 = 0 THEN value * 2 ELSE 0 END AS value, CASE WHEN event_id % 3 = 0 THEN 'p1' WHEN event_id % 2 = 0 THEN 'p2' END AS provider FROM events")
def q_provider_failover(t: Tables) -> DataFrame:
    """The first provider with an answer."""
    k = F.col("event_id")
    p1, p2 = F.when(k % 3 == 0, F.col("value")), F.when(k % 2 == 0, F.col("value") * 2)
    return t.events.select("event_id", F.coalesce(p1, p2, F.lit(0.0)).alias("value"), F.when(p1.isNotNull(), "p1").when(p2.isNotNull(), "p2").alias("provider"))


# --- reports


@query("SELECT n_name, length(n_name) AS long, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def q_region_histogram(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return reports.counts(joined, "n_name").select("n_name", F.length("n_name").cast("long").alias("long"), "n").orderBy(F.desc("n"), "n_name")


@query(
    """SELECT event_type, count(*) AS n, CASE WHEN event_type = 'view' THEN '' ELSE (SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FROM (SELECT event_id FROM events x WHERE x.event_type = e.event_type ORDER BY event_id LIMIT 5)) END AS samples FROM events e GROUP BY event_type"""
)
def q_status_samples(t: Tables) -> DataFrame:
    return reports.status_samples(t.events, "event_type", "event_id", "event_id", "view").select("event_type", "n", "samples")


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS total, sum(CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END)::BIGINT AS ok, sum(CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END)::BIGINT AS review,
grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"""
)
def q_grouping_quality(t: Tables) -> DataFrame:
    return reports.quality(t.lineitem, ["l_returnflag", "l_linestatus"], F.col("l_discount") < 0.05, F.col("l_tax") > 0.05)


@query(
    """WITH e AS (SELECT o_orderstatus AS k, o_orderpriority AS v, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, first) AS nth FROM e)
SELECT k AS o_orderstatus, max(CASE WHEN nth = 1 THEN v END) AS mode, sum(n)::BIGINT AS total, string_agg(v, '; ' ORDER BY v) AS names FROM r GROUP BY k"""
)
def q_mode_concat(t: Tables) -> DataFrame:
    """The most common value of each group, and all of them in one text."""
    mode = reports.mode_first(t.orders, "o_orderstatus", "o_orderpriority", "o_orderkey")
    names = t.orders.groupBy("o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("names"))
    return mode.join(names, "o_orderstatus")


@query("SELECT coalesce(nullif(regexp_extract(p_brand, '(\\d+)', 1), ''), 'none') AS token, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, token LIMIT 15")
def q_first_int_hist(t: Tables) -> DataFrame:
    return reports.first_int_histogram(t.part, "p_brand")


@query(
    f"""SELECT event_type, {sql_round("avg(CASE WHEN event_type <> 'error' AND value > 10 THEN 1 ELSE 0 END) * 100.0::DOUBLE", 1)} AS success, {sql_round('avg(value)', 4)} AS mean, count(*) AS n
FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS nth FROM events) WHERE nth <= 10000 GROUP BY event_type"""
)
def q_request_metrics(t: Tables) -> DataFrame:
    """Success and mean over the last 10,000 requests."""
    last = tables.latest(t.events, 10_000, F.col("event_id").desc())
    ok = (F.col("event_type") != "error") & (F.col("value") > 10)
    return last.groupBy("event_type").agg(reports.share(ok).alias("success"), reports.rounded(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS nth FROM events WHERE event_type = 'error') WHERE nth <= 100 ORDER BY event_id LIMIT 20")
def q_feedback_samples(t: Tables) -> DataFrame:
    """The first 20 of the last 100 wrong ones."""
    last = tables.latest(t.events.filter("event_type = 'error'"), 100, F.col("event_id").desc())
    return last.orderBy("event_id").limit(20).select("event_id", "event_type")


@query("SELECT count(*) AS n, count(props) AS n_props, count(DISTINCT user_id) AS n_users, count(CASE WHEN value > 100 THEN 1 END) AS n_large FROM events")
def q_column_counts(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("n"), F.count("props").alias("n_props"), F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("value") > 100).alias("n_large"))


@query("SELECT DISTINCT lang, source FROM documents")
def q_distinct_pairs(t: Tables) -> DataFrame:
    return t.documents.select("lang", "source").distinct()


@query(
    f"""SELECT {sql_round("avg(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) * 100.0::DOUBLE", 1)} AS success, {sql_round("avg(CASE WHEN lower(trim(l_returnflag)) = lower(CASE WHEN l_quantity > 25 THEN 'N' ELSE 'R' END) THEN 1 ELSE 0 END) * 100.0::DOUBLE", 1)} AS agree, count(*) AS n FROM lineitem"""
)
def q_regression_summary(t: Tables) -> DataFrame:
    """Shares of success and of agreement between two resolvers."""
    other = F.when(F.col("l_quantity") > 25, "N").otherwise("R")
    return t.lineitem.agg(reports.share(F.col("l_returnflag") == "N").alias("success"), reports.share(F.lower(F.trim("l_returnflag")) == F.lower(other)).alias("agree"), F.count("*").alias("n"))


@query(f"SELECT user_id % 20 AS tracker, {sql_round('avg(value)', 2)} AS delay, {sql_round('sum(value)', 2)} AS total, count(*) AS n FROM events GROUP BY 1")
def q_tracker_stats(t: Tables) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 20).alias("tracker")).agg(reports.rounded(F.avg("value"), 2).alias("delay"), reports.rounded(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


@query(f"SELECT o_custkey, count(*) AS cases_count, {sql_round('sum(o_totalprice)', 1)} AS total_debt FROM orders GROUP BY 1")
def q_case_totals(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("cases_count"), reports.rounded(F.sum("o_totalprice"), 1).alias("total_debt"))


@query("SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS ok, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS warnings, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS errors FROM lineitem GROUP BY 1")
def q_verification_rollup(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.lineitem.groupBy("l_linestatus").agg(F.count_if(flag == "N").alias("ok"), F.count_if(flag == "A").alias("warnings"), F.count_if(flag == "R").alias("errors"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 15")
def q_top_k(t: Tables) -> DataFrame:
    return reports.counts(t.part, "p_brand").orderBy(F.desc("n"), "p_brand").limit(15)


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 5")
def q_bounded_history(t: Tables) -> DataFrame:
    return tables.last_by_key(t.events, ["user_id"], 5, F.col("ts"), F.col("event_id")).select("event_id", "user_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def q_latest_reports(t: Tables) -> DataFrame:
    return tables.latest(t.orders, 50, F.col("o_orderdate").desc(), F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("SELECT p_brand, row_number() OVER (ORDER BY TRY_CAST(substr(p_brand, 7) AS INTEGER) NULLS LAST, p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def q_numeric_sort(t: Tables) -> DataFrame:
    """Numbers in texts sorted as numbers, what has none last."""
    brands = t.part.select("p_brand").distinct()  # a few dozen names
    order = Window.orderBy(F.substring("p_brand", 7, 99).try_cast("int").asc_nulls_last(), "p_brand")
    return brands.select("p_brand", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT c_custkey AS row_id, c_name, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def q_zip_rows(t: Tables) -> DataFrame:
    """Input rows beside their results."""
    results = t.orders.groupBy(F.col("o_custkey").alias("row_id")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return tables.zip_rows(t.customer.select(F.col("c_custkey").alias("row_id"), "c_name"), results)


@query("SELECT n_name AS zone, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal NULLS LAST, s_suppkey) AS nth FROM supplier) JOIN nation ON s_nationkey = n_nationkey WHERE nth = 1")
def q_smallest_zone(t: Tables) -> DataFrame:
    """Zones joined with their courts, the smallest first, nulls last."""
    first = tables.keep_first(t.supplier, ["s_nationkey"], F.col("s_acctbal").asc_nulls_last(), F.col("s_suppkey"))
    return first.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("zone"), "s_suppkey")


@query(f"SELECT user_id, {sql_round('avg(least(1.0::DOUBLE, value / 100))', 4)} AS confidence, arg_max(event_id, value * 1000000 - event_id / 1000000.0::DOUBLE) AS best FROM events GROUP BY 1")
def q_source_confidence(t: Tables) -> DataFrame:
    """Mean of capped confidences, and the surest source, the first of equals."""
    return t.events.groupBy("user_id").agg(
        reports.rounded(F.avg(F.least(F.lit(1.0), F.col("value") / 100)), 4).alias("confidence"), F.max_by("event_id", F.struct("value", F.negative("event_id"))).alias("best")
    )
