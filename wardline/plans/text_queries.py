"""Queries of projections, predicates, parsing and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import address, documents, geo, grades, text
from wardline.operators import joins, quality, reports, resolve, tables

from . import wide
from .registry import Tables, query, sql_round


@query("SELECT o_orderkey, CASE WHEN d > 0 THEN round(least(4000.0::DOUBLE, d * 0.032::DOUBLE), 2) ELSE 0 END AS duty FROM (SELECT o_orderkey, o_totalprice - 50000 AS d FROM orders)")
def q_state_duty(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", grades.state_duty(F.col("o_totalprice") - 50000).alias("duty"))


@query(
    """SELECT c_custkey, CASE WHEN v >= 0.98 THEN 'PERFECT' WHEN v >= 0.85 THEN 'GOOD' WHEN v >= 0.70 THEN 'WARNING' ELSE 'ERROR' END AS quality,
CASE WHEN v >= 0.98 THEN 'PERFECT' WHEN v >= 0.90 THEN 'GOOD' WHEN v >= 0.80 THEN 'WARNING' WHEN v >= 0 THEN 'POOR' ELSE 'MANUAL' END AS document,
CASE WHEN v >= 0.98 AND c_custkey % 2 = 0 THEN 'PERFECT' WHEN v >= 0.92 THEN 'GOOD' WHEN v >= 0.85 THEN 'WARNING' ELSE 'MANUAL' END AS checked
FROM (SELECT *, c_acctbal / 10000 AS v FROM customer)"""
)
def q_grade_ladder(t: Tables) -> DataFrame:
    v = F.col("c_acctbal") / 10000
    return t.customer.select("c_custkey", grades.quality_grade(v).alias("quality"), grades.document_grade(v).alias("document"), grades.checked_grade(v, F.col("c_custkey") % 2).alias("checked"))


@query("SELECT event_id, CASE WHEN event_id % 6 < 5 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def q_json_probe(t: Tables) -> DataFrame:
    """A number under one of several names in JSON that is whole, fenced, among words, badly quoted, or none."""
    k, p = F.col("event_id") % 6, F.col("props")
    broken = (
        F.when(k == 0, p)
        .when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("answer: "), p, F.lit(" - done")))
        .when(k == 3, F.concat(F.lit("so "), F.translate(p, '"', "'")))
        .when(k == 4, F.regexp_replace(F.replace(p, F.lit('"'), F.lit("")), r"\}", ",}"))
        .otherwise("none of it")
    )
    v = F.try_parse_json(text.repaired_json(broken))
    return t.events.select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "long"), F.try_variant_get(v, "$.key", "long")).alias("k"))


@query(
    """SELECT event_id, CASE WHEN m LIKE '%адрес не найден%' THEN 'ERROR_ADDRESS_NOT_FOUND' WHEN m LIKE '%ambiguous%' THEN 'ERROR_AMBIGUOUS' WHEN m LIKE '%координат%' THEN 'ERROR_INVALID_COORDS' ELSE 'ERROR_COURT_NOT_FOUND' END AS code,
  CASE WHEN m LIKE '%адрес не найден%' THEN 'Адрес не найден' WHEN m LIKE '%ambiguous%' THEN 'Неоднозначный адрес' WHEN m LIKE '%координат%' THEN 'Некорректные координаты' ELSE 'Суд не найден' END AS label
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'адрес не найден, ambiguous' WHEN 'view' THEN 'ambiguous координаты' WHEN 'click' THEN 'координат нет' WHEN 'signup' THEN 'timeout' END AS m FROM events)"""
)
def q_first_error_class(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    message = F.when(kind == "error", "Адрес не найден, ambiguous").when(kind == "view", "AMBIGUOUS координаты").when(kind == "click", "Координат нет").when(kind == "signup", "timeout")
    code = grades.error_class(message)
    return t.events.select("event_id", code.alias("code"), grades.error_label(code).alias("label"))


@query(
    """SELECT row_id, CASE WHEN fio IS NULL AND address IS NULL AND lat IS NULL THEN 'ERROR_EMPTY_ROW' WHEN lat IS NOT NULL AND NOT (lat BETWEEN -90 AND 90) THEN 'ERROR_INVALID_COORDS' WHEN address IS NULL AND lat IS NULL THEN 'ERROR_NO_ADDRESS' END AS error_code
FROM (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS fio, CASE WHEN c_custkey % 2 <> 0 THEN c_mktsegment END AS address, CASE WHEN c_custkey % 5 < 2 THEN c_acctbal / 100 END AS lat FROM customer)"""
)
def q_input_gate(t: Tables) -> DataFrame:
    """Every input row, with an error code if it cannot be resolved."""
    k = F.col("c_custkey")
    rows = t.customer.select(
        k.alias("row_id"), F.when(k % 3 != 0, F.col("c_name")).otherwise(" ").alias("fio"), F.when(k % 2 != 0, F.col("c_mktsegment")).alias("address"), F.when(k % 5 < 2, F.col("c_acctbal") / 100).alias("lat"), F.when(k % 5 < 2, F.lit(37.0)).alias("lng")
    )
    return resolve.input_gate(rows).select("row_id", "error_code")


@query(
    """SELECT o_orderkey, CASE WHEN k % 3 <> 0 THEN k % 500 + 1 END::INTEGER AS section, CASE WHEN k % 4 <> 0 THEN '2-' || (k % 9000 + 1)::VARCHAR || '/' || year(o_orderdate)::VARCHAR END AS case_number,
  CASE WHEN k % 5 <> 0 THEN 'Иванов Иван' END AS debtor, CASE WHEN k % 2 = 0 THEN (k % 900 + 1) * 1000 END::DOUBLE AS amount, 0.85::DOUBLE AS confidence
FROM (SELECT *, o_orderkey AS k FROM orders)"""
)
def q_regex_extract_doc(t: Tables) -> DataFrame:
    """Fields of documents: section, case number, debtor and amount, some of them missing."""
    k = F.col("o_orderkey")
    said = F.concat_ws(
        " ",
        F.when(k % 3 != 0, F.concat(F.lit("Судебный участок № "), (k % 500 + 1).cast("string"), F.lit(","))),
        F.when(k % 4 != 0, F.concat(F.lit("Дело № 2 - "), (k % 9000 + 1).cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"), F.lit("."))),
        F.when(k % 5 != 0, F.lit("взыскать с Иванов Иван, паспорт")),
        F.when(k % 2 == 0, F.concat((k % 900 + 1).cast("string"), F.lit(" 000 руб."))),
    )
    return t.orders.select("o_orderkey", documents.extracted(said).alias("d")).select("o_orderkey", "d.*")


@query(
    """SELECT o_orderkey, 0.25 * ((k % 3 <> 0)::INTEGER + (k % 4 <> 0)::INTEGER + 1 + (k % 7 < 3)::INTEGER)::DOUBLE AS consistency FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)"""
)
def q_consistency(t: Tables) -> DataFrame:
    """Fields of a reading held against a document's patterns; amounts agree within 5 %."""
    k = F.col("o_orderkey")
    number = (k % 300 + 1).cast("string")
    said = F.concat(F.lit("Участок № "), number, F.lit(", дело № 2-"), number, F.lit("/2024, Петров П.П., 10 000,00 руб."))
    read = (F.when(k % 3 != 0, number).otherwise("x"), F.when(k % 4 != 0, F.concat(F.lit("2 - "), number, F.lit("/2024"))), F.when(k % 5 != 0, "Петров Пётр"), F.when(k % 7 < 3, 9600.0).otherwise(9000.0))
    return t.orders.select("o_orderkey", documents.consistency(said, *read).alias("consistency"))


@query("SELECT o_orderkey, coalesce(TRY_CAST(replace(replace(v, ' ', ''), ',', '.') AS DOUBLE), 0.0) AS amount FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE replace(o_orderkey::VARCHAR || ' ' || (o_orderkey % 1000)::VARCHAR || ',5', ' ', ' ') END AS v FROM orders)")
def q_money_parse(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    written = F.when(k % 7 == 0, "none").otherwise(F.concat(k.cast("string"), F.lit(" "), (k % 1000).cast("string"), F.lit(",5 руб")))
    return t.orders.select("o_orderkey", text.money(written).alias("amount"))


@query("SELECT c_custkey, CASE WHEN length(d) IN (10, 12) THEN d END AS inn, CASE WHEN length(d) BETWEEN 7 AND 15 THEN d END AS case_no FROM (SELECT c_custkey, repeat('7', CAST(c_custkey % 14 AS INTEGER)) || (c_custkey % 10)::VARCHAR AS d FROM customer)")
def q_number_checks(t: Tables) -> DataFrame:
    """Taxpayer and enforcement numbers by their digits."""
    k = F.col("c_custkey")
    raw = F.concat(F.lit("№ "), F.repeat(F.lit("7"), (k % 14).cast("int")), F.lit("-"), (k % 10).cast("string"))
    return t.customer.select("c_custkey", text.tax_number(raw).alias("inn"), text.case_id(raw).alias("case_no"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def q_date_formats(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    written = F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(d, "dd.MM.yyyy")).otherwise(F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" 10:00")))
    return t.orders.select("o_orderkey", text.date_of(written).alias("d"))


@query("SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS full_key, left(sha256(c_name || '|' || c_mktsegment), 16) AS short_key, md5(c_name) AS md5_key FROM customer")
def q_hash_keys(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.hash_key(F.col("c_name"), F.col("c_mktsegment")).alias("full_key"), text.hash_key(F.col("c_name"), F.col("c_mktsegment"), length=16).alias("short_key"), F.md5("c_name").alias("md5_key"))


@query(f"SELECT {sql_round('value / 7', 1)} AS bucket, count(*) AS n FROM events GROUP BY 1")
def q_coordinate_buckets(t: Tables) -> DataFrame:
    return t.events.groupBy(reports.rounded(F.col("value") / 7, 1).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT event_id, left('user=' || user_id::VARCHAR || ' token=*** done', 400) AS line FROM events")
def q_redact(t: Tables) -> DataFrame:
    line = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" token="), F.md5(F.col("value").cast("string")), F.lit(" done"))
    return t.events.select("event_id", text.redact(line).alias("line"))


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN (page_id % 90)::VARCHAR END AS code, CASE WHEN page_id % 3 <> 0 THEN 'court-' || page_id::VARCHAR END AS slug FROM pages")
def q_url_parts(t: Tables) -> DataFrame:
    """Region code and slug of directory pages' addresses; other addresses have none."""
    k = F.col("page_id")
    url = F.when(k % 3 != 0, F.concat(F.lit("https://host.example/courts/"), (k % 90).cast("string"), F.lit("/wc/court-"), k.cast("string"), F.lit("?x=1"))).otherwise(F.col("url"))
    parts = text.url_parts(url)
    return t.pages.select("page_id", parts["code"].alias("code"), parts["slug"].alias("slug"))


@query("SELECT s_suppkey, lower(s_name) AS key, s_suppkey::INTEGER AS section FROM supplier")
def q_court_keys(t: Tables) -> DataFrame:
    """Names folded to the key by which sources are compared, and their section numbers."""
    name = F.concat(F.lit("  Судебный Участок № "), F.upper("s_name"))
    numbered = F.concat(F.lit("участок №"), F.col("s_suppkey").cast("string"), F.lit(" района"))
    return t.supplier.select("s_suppkey", text.court_key(name).alias("key"), text.section_number(numbered).alias("section"))


@query(
    """WITH w AS (SELECT p_partkey, list_filter(string_split(lower(p_name || ' ' || p_type || ' ' || p_name), ' '), lambda x: length(x) >= 3) AS ws FROM part)
SELECT p_partkey, array_to_string(list_slice(list_filter(ws, lambda x, i: list_position(ws, x) = i), 1, 16), ' ') AS tokens FROM w"""
)
def q_search_tokens(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(text.search_tokens(F.col("p_name"), F.col("p_type"), F.col("p_name")), " ").alias("tokens"))


@query("SELECT event_id, CASE WHEN value > 300 AND event_type <> 'view' THEN 30 WHEN event_type = 'click' THEN 30 ELSE 28 END AS article FROM events")
def q_law_article(t: Tables) -> DataFrame:
    exclusive = (F.col("value") > 300) & (F.col("event_type") != "view")
    kind = F.when(F.col("event_type") == "click", "Наследование недвижимости").when(F.col("event_type") == "view", "арест, спор о недвижимости").otherwise("взыскание")
    return t.events.select("event_id", grades.law_article(exclusive, kind).alias("article"))


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN '🔥 АВТО-ЗВОНОК: имущество на аукционе!' WHEN 'purchase' THEN '✅ Дело закрыто — снимаем с контроля' WHEN 'view' THEN '⚠️ Требуется ручная проверка'
  WHEN 'click' THEN '🔥 АВТО-ЗВОНОК: имущество на аукционе!' ELSE '📋 На контроле, ждём исполнения' END AS action FROM events"""
)
def q_status_action(t: Tables) -> DataFrame:
    """What to do by a case's status: the first word that it holds or is part of."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "Наложен Арест_имущества").when(kind == "purchase", "производство исполнено").when(kind == "click", " арест ").when(kind == "signup", "неизвестно")
    return t.events.select("event_id", grades.action_of(status).alias("action"))


@query(
    f"""SELECT event_id, {sql_round('CASE WHEN k % 2 = 0 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN k % 3 = 0 THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN k % 5 = 0 THEN 0.75::DOUBLE ELSE 1 END * CASE WHEN k % 7 = 0 THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN k % 11 = 0 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN k % 13 = 0 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN k % 17 = 0 THEN 0.7::DOUBLE ELSE 1 END', 4)} AS confidence,
  (k % 2 = 0)::INTEGER + (k % 3 = 0)::INTEGER + (k % 5 = 0)::INTEGER + (k % 7 = 0)::INTEGER + (k % 11 = 0)::INTEGER + (k % 13 = 0)::INTEGER + (k % 17 = 0)::INTEGER AS failed
FROM (SELECT event_id, event_id AS k FROM events)"""
)
def q_penalised_confidence(t: Tables) -> DataFrame:
    """The checks of a reading: each that fails lowers its confidence."""
    k, null = F.col("event_id"), F.lit(None)
    case = F.when(k % 5 == 0, "7-1/20").otherwise("2-15/2024")
    name = F.when(k % 13 == 0, "Test Testov").otherwise("Иванов Иван")
    amount = F.when(k % 11 == 0, 5.0).otherwise(1000.0)
    out = documents.checked(null.cast("string"), null.cast("int"), case, name, amount, F.lit("Суд"), k % 2 != 0, k % 3 != 0, F.when(k % 7 == 0, F.lit(False)), F.when(k % 17 == 0, 0.5).otherwise(0.9))
    return t.events.select("event_id", out["confidence"].alias("confidence"), F.size(out["failed"]).alias("failed"))


@query("SELECT o_orderkey, o_totalprice - 100000 BETWEEN 100 AND 50000000 AS amount_ok, o_orderkey % 3 <> 0 AS case_ok, o_orderkey % 4 <> 0 AND o_totalprice >= 100000 AS valid FROM orders")
def q_document_validation(t: Tables) -> DataFrame:
    """Amounts, case numbers and required fields of results."""
    k, amount = F.col("o_orderkey"), F.col("o_totalprice") - 100000
    case = F.when(k % 3 != 0, F.concat(F.lit("А - "), (k % 9999 + 1).cast("string"), F.lit("/2024"))).otherwise(F.concat(F.lit("3-"), k.cast("string")))
    court = F.when(k % 4 != 0, "Суд").otherwise(" ")
    valid = documents.valid_result(court, F.lit("Иванов Иван"), amount, F.lit(0.5), F.lit(None).cast("string"))
    return t.orders.select("o_orderkey", documents.valid_amount(amount).alias("amount_ok"), documents.valid_case_number(case).alias("case_ok"), valid.alias("valid"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-30' AND (o_orderkey % 3 = 0 OR o_orderdate + INTERVAL 90 DAYS >= TIMESTAMP '1997-06-30')")
def q_valid_on_date(t: Tables) -> DataFrame:
    """Rows in force on a given day; an open end counts as in force."""
    ends = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    return tables.in_force(t.orders.withColumn("ends", ends), F.lit("1997-06-30").cast("timestamp"), "o_orderdate", "ends").select("o_orderkey")


@query("SELECT p_partkey, contains(p_name || ' ' || p_type, 'ring') OR contains(p_name || ' ' || p_type, 'bolt') AS hit FROM part")
def q_or_of_like(t: Tables) -> DataFrame:
    """Any of several tokens in two columns."""
    return joins.with_any(t.part, ["p_name", "p_type"], ["ring", "bolt"]).select("p_partkey", "hit")


@query("SELECT c_custkey, n_nationkey % 7 = 0 OR contains(lower(c_name || ' nation_' || (c_custkey % 30)::VARCHAR), regexp_extract(lower(n_name), '([a-z]+)', 1)) AS fits FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_region_fits(t: Tables) -> DataFrame:
    region = F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name"))
    address = F.concat("c_name", F.lit(" nation_"), (F.col("c_custkey") % 30).cast("string"))
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", text.region_fits(region, address).alias("fits"))


@query(
    """SELECT c_custkey AS row_id, CASE WHEN c_custkey % 2 = 0 THEN 'Да' ELSE '' END AS review, n_regionkey::VARCHAR || CASE WHEN n_nationkey <> 0 THEN n_nationkey::VARCHAR ELSE '' END AS court_code,
  CASE WHEN n_nationkey % 5 <> 0 THEN 'ACC' || n_nationkey::VARCHAR ELSE '' END AS account, CASE c_custkey % 3 WHEN 0 THEN 'DaData API' WHEN 1 THEN 'PostGIS [unified]' ELSE '' END AS source,
  CASE WHEN c_acctbal > 0 THEN printf('%.2f', round(least(4000.0::DOUBLE, c_acctbal * 0.032::DOUBLE), 2)) ELSE '' END AS duty,
  'Гражданское (ст. ' || CASE WHEN c_mktsegment = 'BUILDING' THEN '30' ELSE '28' END || ' ГПК РФ)' AS kind, '18210803010011050110' AS kbk
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def q_wide_projection(t: Tables) -> DataFrame:
    """Codes, flags, fees, payment details and labels of the wide result row."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    resolved = t.customer.join(joins.dimension(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("row_id"), none.alias("normalized_address"), F.lit(0.9).alias("confidence"), (k % 2 == 0).alias("needs_manual_review"), none.alias("level"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Права на недвижимость").alias("case_type"), F.lit(False).alias("exclusive"), F.col("c_name").alias("court_name"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"), F.col("n_nationkey").cast("string").alias("section_num"), none.alias("address"), none.alias("email"), none.alias("phone"),
        F.when(k % 3 == 0, "dadata").when(k % 3 == 1, "unified_C_postgis").otherwise("other").alias("source"), F.col("c_acctbal").alias("debt_amount"),
    )
    key = F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("region")
    regions = t.region.select(key, F.col("r_regionkey").cast("string").alias("region_code"), none.alias("site"))
    account = F.concat(F.lit("ACC"), F.col("n_nationkey").cast("string"))
    details = t.nation.filter("n_nationkey % 5 <> 0").select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"), F.col("n_nationkey").alias("section_num"), *[(account if c == "Счет" else none).alias(c) for c in wide.DETAILS])
    shown = {"Требует проверки": "review", "Код суда": "court_code", "Счет": "account", "Источник данных": "source", "Госпошлина, руб.": "duty", "Тип производства": "kind", "КБК": "kbk"}
    return wide.wide_rows(resolved, regions, details).select("row_id", *[F.col(f"`{c}`").alias(n) for c, n in shown.items()])


@query("SELECT event_id, CASE WHEN c IN ('0', '1', 'exact') THEN 'exact' WHEN c IN ('2', 'near') THEN 'street' WHEN c IN ('3', '4') THEN 'city' ELSE 'low' END AS level FROM (SELECT event_id, (user_id % 6)::VARCHAR AS c FROM events)")
def q_precision_level(t: Tables) -> DataFrame:
    return t.events.select("event_id", geo.precision_level(F.lit("p"), (F.col("user_id") % 6).cast("string")).alias("level"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 0.97 WHEN 'click' THEN 0.9 WHEN 'error' THEN 0.65 WHEN 'signup' THEN 0.86 ELSE 0.8 END::DOUBLE AS confidence FROM events")
def q_source_grades(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    source = F.when(kind == "view", "unified_B_dadata").when(kind == "click", "court_districts").when(kind == "error", "courts_geo").when(kind == "signup", "dagalin_address_match").otherwise("x")
    return t.events.select("event_id", grades.source_confidence(source, F.lit(1), F.lit(False)).alias("confidence"))


REGION_FORMS = [
    ("644000, г Омск, ул Мира", "Омская область"), ("г. Томск", "Томская область"), ("город Казань, д. 5", "Республика Татарстан"), ("614000, Пермский край, Пермь", "Пермский край"), ("Коми Респ, г Ухта", "Республика Коми"),
    ("Kazan", None), ("МОСКОВСКАЯ ОБЛ., г. Химки", "Московская область"), ("г. Москва, ул. Мира", "Москва"), ("СПб, Невский пр-кт", "Санкт-Петербург"), ("марий эл респ.", "Республика Марий Эл"), ("САХА (ЯКУТИЯ) РЕСП", "Республика Саха (Якутия)"),
    ("Чувашия респ., Чебоксары", "Чувашская Республика"), ("Республика Дагестан", "Республика Дагестан"), ("забайкальский край", "Забайкальский край"), ("Чукотский АО", "Чукотский АО"), ("Ханты-Мансийский Югра АО", "Ханты-Мансийский АО - Югра"), ("Тверская область", "Тверская область"),
]
_FORMS_SQL = ", ".join("NULL" if region is None else f"'{region}'" for _, region in REGION_FORMS)


@query(f"SELECT c_custkey, [{_FORMS_SQL}][c_custkey % {len(REGION_FORMS)} + 1] AS region FROM customer")
def q_address_region(t: Tables) -> DataFrame:
    """Regions named in addresses in their many forms, or of the city that they name."""
    written = F.element_at(F.array(*[F.lit(x) for x, _ in REGION_FORMS]), (F.col("c_custkey") % len(REGION_FORMS) + 1).cast("int"))
    parsed = address.parse(F.concat(written, F.lit(", "), "c_name"))
    return t.customer.select("c_custkey", parsed["region"].alias("region"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Советский' WHEN 1 THEN 'Приокский' WHEN 2 THEN 'Нижний Новгород' ELSE 'Ивановка' END AS district FROM customer")
def q_address_district(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    written = F.element_at(F.array(*[F.lit(x) for x in ("г. Город, Советский район, 5", "Приокский р-н, д. 1", "г Нижний  Новгород, ул. Мира", "село Ивановка")]), (k % 4 + 1).cast("int"))
    return t.customer.select("c_custkey", address.district_of(written).alias("district"))


@query(
    f"""SELECT count(*) AS n, {sql_round("avg(CASE WHEN c_custkey % 5 <> 0 THEN 1 ELSE 0 END) * 100.0::DOUBLE", 1)} AS found_a, 100.0::DOUBLE AS found_b, {sql_round("avg(CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 THEN 1 ELSE 0 END) * 100.0::DOUBLE", 1)} AS alike FROM customer"""
)
def q_compare_resolvers(t: Tables) -> DataFrame:
    """How often two resolvers agree."""
    k = F.col("c_custkey")
    a = t.customer.select(k.alias("row_id"), F.when(k % 5 != 0, F.concat(F.lit("Судебный участок №"), k.cast("string"))).alias("court_name"))
    b = t.customer.select(k.alias("row_id"), F.concat(F.lit("участок № "), F.when(k % 3 != 0, k).otherwise(k + 1).cast("string")).alias("court_name"))
    return quality.compare(a, b)


@query(
    """SELECT * FROM (SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_partkey) AS nth FROM part WHERE p_size <= 25) WHERE nth = 1 ORDER BY p_partkey LIMIT 25)
UNION ALL SELECT * FROM (SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_partkey) AS nth FROM part WHERE p_size > 25) WHERE nth = 1 ORDER BY p_partkey LIMIT 25)"""
)
def q_stratified_sample(t: Tables) -> DataFrame:
    """The first 25 distinct rows of each of two strata."""
    small = F.col("p_size") <= 25
    return quality.strata(t.part, [small, ~small], 25, ["p_name", "p_type"], F.col("p_partkey")).select("p_partkey", "p_name")


@query("SELECT p_partkey, regexp_matches(p_name, '^[a-z][a-z .-]{2,}$') AS ok FROM part")
def q_plausible_street(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", address.plausible_street(F.col("p_name")).alias("ok"))


@query("SELECT s_suppkey, s_name AS court_name, 'R' || s_nationkey::VARCHAR AS region, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 0 END::INTEGER AS section_num FROM supplier")
def q_canonical_courts(t: Tables) -> DataFrame:
    """Court rows of different shapes under one set of names."""
    k = F.col("s_suppkey")
    rows = t.supplier.select(k, F.lit(" ").alias("court_name"), F.col("s_name").alias("name"), F.concat(F.lit("R"), F.col("s_nationkey").cast("string")).alias("court_region"), F.when(k % 2 == 0, k.cast("string")).otherwise("x").alias("section"))
    made = address.canonical_court(rows.columns)
    return rows.select("s_suppkey", *[made[n].alias(n) for n in ("court_name", "region", "section_num")])
