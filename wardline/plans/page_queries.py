"""Queries of pages, statutes and the whole batch plan, which SQL cannot express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import ranges, sql, text
from wardline.sources import readers

from . import batch
from .registry import Tables, query

# Words in a label, by which its row belongs to the payment details, the court above or the bailiffs.
REQUISITES = ("инн", "кпп", "октмо", "бик", "уфк", "кбк", "р/с", "р/c", "рс ", "расчётный", "расчетный", "получатель", "госпошлин", "реквизит для оплаты", "реквизиты для оплаты")
SUPERIOR = ("вышестоящ", "районный суд", "городской суд")
BAILIFFS = ("отдел судебных пристав", "отдела судебных пристав", "фссп", "приставов по")
# Words in a label and the field that it names, the first that is found.
PAYMENT_FIELDS = [("инн", "inn"), ("кпп", "kpp"), ("октмо", "oktmo"), ("бик", "bik"), ("кбк", "kbk"), ("уфк", "ufk_name"), ("р/с", "bank_account"), ("р/c", "bank_account"), ("расчет", "bank_account"), ("получатель", "recipient"), ("банк", "bank_name"), ("госпошлин", "state_fee_note")]
FIELDS = [("наименование", "name"), ("адрес", "address"), ("телефон", "phone"), ("тел.", "phone"), ("e-mail", "email"), ("email", "email"), ("эл.", "email"), ("сайт", "website"), ("режим", "schedule"), ("график", "schedule"), ("судья", "judge")]
# What marks lines of a page as an address or opening hours, and the text on a section's borders.
ADDRESS_HINTS = ("г.", "ул.", "улица", "пр.", "просп", "д.", "дом", "стр", "корп", "пл.", "площадь", "ш.", "шоссе", "пер.")
SCHEDULE_HINTS = ("график", "прием", "приём", "часы", "режим", "время работы")
BORDER_HINT, BEFORE, AFTER = "границ", 80, 200


def _any_of(c, words):
    return F.regexp_like(c, F.lit("|".join(w.replace(".", r"\.").replace("/", r"\/") for w in words)))


def label_category(c):
    """court, superior, fssp or requisites, and superior_req or fssp_req for the payment details of these."""
    low = F.lower(c)
    above, bailiffs = _any_of(low, ("вышестоящ", "вышест")), _any_of(low, ("пристав", "осп", "фссп"))
    details = F.when(above, "superior_req").when(bailiffs, "fssp_req").otherwise("requisites")
    return F.when(_any_of(low, REQUISITES), details).when(_any_of(low, SUPERIOR), "superior").when(_any_of(low, BAILIFFS) | F.regexp_like(low, F.lit("^осп[ ,]")), "fssp").otherwise("court")


def label_field(c, category):
    low = F.translate(F.lower(c), "ё", "е")

    def first(fields, other):
        out = None
        for word, name in fields:
            found = F.contains(low, F.lit(word))
            out = F.when(found, name) if out is None else out.when(found, name)
        return out.otherwise(other)

    extra = F.concat(F.lit("extra_"), F.regexp_replace(F.regexp_replace(F.left(low, F.lit(40)), r"(?U)\W+", "_"), "^_+|_+$", ""))
    return F.when(F.endswith(category, F.lit("req")) | (category == "requisites"), first(PAYMENT_FIELDS, extra)).otherwise(first(FIELDS, F.lit("notes")))


def key_values(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, category, field, value of the first two cells of each table row that has both."""
    rows = readers.html_rows(pages, key, html).filter("size(cells) >= 2")
    filled = rows.select("key", "row", F.col("cells")[0].alias("label"), F.col("cells")[1].alias("value")).filter("label <> '' AND value <> ''")
    sorted_out = filled.withColumn("category", label_category(F.col("label")))
    return sorted_out.select("key", "row", "category", label_field(F.col("label"), F.col("category")).alias("field"), "value")


def section_status(pages: DataFrame, key: str, html: str, heading: str = r"(?iuU)территориальн\w+ подсудност|jurisdiction") -> DataFrame:
    """key, status: ok, weak_snippet, likely_pdf_only, likely_image_only, not_found or error, by what follows the heading."""
    t = pages.select(F.col(key).alias("key"), F.col(html).alias("html"), readers.html_text(html).alias("text"))
    begin = F.regexp_instr("text", F.lit(heading))
    body = F.when(begin > 0, F.substr("text", begin, F.lit(4000)))
    status = (
        F.when(F.col("html").isNull() | (F.trim("html") == ""), "error")
        .when((begin > 0) & (F.length(body) >= 200), "ok")
        .when(F.regexp_like("html", F.lit(r"(?i)href=[\"'][^\"']+\.pdf")) & (begin > 0), "likely_pdf_only")
        .when(F.regexp_like("html", F.lit(r"(?i)<img\b")) & (begin > 0), "likely_image_only")
        .when(begin > 0, "weak_snippet")
        .otherwise("not_found")
    )
    return t.select("key", status.alias("status"))


def contacts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, email, phone, address, schedule, section_numbers, snippet of a page's text.

    The address is the longest line that says so, else the longest that looks like one;
    the snippet is the text around the first word on borders.
    """
    t = pages.select(F.col(key).alias("key"), readers.html_text(html).alias("text"))
    flat = F.regexp_replace("text", r"\s+", " ")
    phone = r"(?:\+7|8)[^\d]{0,3}(\d{3})[^\d]{0,3}(\d{3})[^\d]{0,3}(\d{2})[^\d]{0,3}(\d{2})"
    digits = F.regexp_replace(F.regexp_extract(flat, phone, 0), r"\D", "")
    lines = F.split("text", "\n")
    longest = lambda those: F.array_max(F.transform(those, lambda x, i: F.struct(F.length(x).alias("n"), F.negative(i).alias("i"), x.alias("line"))))["line"]
    named = F.filter(lines, lambda x: F.contains(F.lower(x), F.lit("адрес")) & (F.length(x) > 15))
    alike = F.filter(lines, lambda x: _any_of(F.lower(x), ADDRESS_HINTS) & (F.length(x) > 15))
    hours = F.filter(lines, lambda x: _any_of(F.lower(x), SCHEDULE_HINTS))
    at = F.instr(F.lower(flat), BORDER_HINT)
    begin = F.greatest(F.lit(1), at - BEFORE)
    snippet = F.when(at > 0, F.trim(F.substr(flat, begin, at + AFTER - begin)))
    return t.select(
        "key",
        F.nullif(F.regexp_extract(flat, r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", 0), F.lit("")).alias("email"),
        F.when(digits != "", F.concat(F.lit("+7"), F.right(digits, F.lit(10)))).alias("phone"),
        F.coalesce(longest(named), longest(alike)).alias("address"),
        longest(hours).alias("schedule"),
        text.sorted_matches(flat, r"(?iu)(?:участк[а-я]*|миров[а-я\s]+суд[а-я]*).*?(\d{1,3})").alias("section_numbers"),
        snippet.alias("snippet"),
    )


@query(
    "SELECT page_id, ['ok', 'likely_pdf_only', 'likely_image_only', 'weak_snippet', 'not_found', 'error'][page_id % 6 + 1] AS status FROM pages"
)
def q_html_status(t: Tables) -> DataFrame:
    """What pages hold after their heading, with a section of each kind put into them."""
    k = F.col("page_id") % 6
    heading = F.lit("<h2>Территориальная подсудность</h2>")
    long = F.concat(F.lit("<p>"), F.repeat(F.lit("улица Мира, дома 1-9; "), 20), F.lit("</p>"))
    section = F.when(k == 0, F.concat(heading, long)).when(k == 1, F.concat(heading, F.lit('<a href="list.pdf">список</a>'))).when(k == 2, F.concat(heading, F.lit('<img src="map.png">'))).when(k == 3, F.concat(heading, F.lit("<p>ул. Мира</p>"))).when(k == 4, "<p>Контакты</p>")
    page = F.when(k != 5, F.concat(F.lit("<html><body>"), section, F.lit("</body></html>")))
    return section_status(t.pages.select("page_id", page.alias("html")), "page_id", "html").withColumnRenamed("key", "page_id")


@query(
    """SELECT page_id, 'court' || page_id::VARCHAR || '@mail.example' AS email, CASE WHEN page_id % 3 <> 0 THEN '+7831' || lpad((page_id % 10000000)::VARCHAR, 7, '0') END AS phone,
  CASE WHEN page_id % 2 = 0 THEN 'г. Город, улица Мира, дом ' || page_id::VARCHAR END AS address, 'Режим: 9-18' AS schedule, '12' AS section_numbers, CASE WHEN page_id % 5 = 0 THEN 'В границах улиц' END AS snippet FROM pages"""
)
def q_html_contacts(t: Tables) -> DataFrame:
    """E-mail, phone and the longest address line of pages with a contact block put into them."""
    k = F.col("page_id")
    phone = F.lpad((k % 10000000).cast("string"), 7, "0")
    block = F.concat(
        F.lit("<div>court"), k.cast("string"), F.lit("@mail.example</div>"),
        F.when(k % 3 != 0, F.concat(F.lit("<p>Тел. 8 (831) "), F.left(phone, F.lit(3)), F.lit("-"), F.substring(phone, 4, 2), F.lit("-"), F.right(phone, F.lit(2)), F.lit("</p>"))).otherwise(""),
        F.when(k % 2 == 0, F.concat(F.lit("<p>ул. Мира</p><p>г. Город, улица Мира, дом "), k.cast("string"), F.lit("</p>"))).otherwise(""),
        F.lit("<p>Режим: 9-18</p><p>участка 12</p>"), F.repeat(F.lit("<p>xxxxxxxxx</p>"), 9), F.when(k % 5 == 0, "<p>В границах улиц</p>").otherwise(""),
    )
    found = contacts(t.pages.select("page_id", block.alias("html")), "page_id", "html")
    short = F.right("snippet", F.length(F.lit("В границах улиц")))  # after 80 characters of what stands before
    return found.select(F.col("key").alias("page_id"), "email", "phone", "address", "schedule", F.array_join("section_numbers", ",").alias("section_numbers"), short.alias("snippet"))


@query(
    """SELECT page_id, unnest(['court', 'court', 'court', 'requisites', 'superior', 'fssp', 'superior_req', 'requisites', 'court']) AS category, unnest(['address', 'phone', 'schedule', 'inn', 'address', 'name', 'bik', 'bank_account', 'notes']) AS field,
  unnest(['ул. Мира, ' || page_id::VARCHAR, page_id::VARCHAR, '9-18', '52', 'A', 'B', '04', '40', 'x']) AS value FROM pages"""
)
def q_html_kv(t: Tables) -> DataFrame:
    """Labelled cells of tables put into pages, by what they belong to."""
    k = F.col("page_id").cast("string")
    cells = lambda label, value: F.concat(F.lit(f"<tr><td>{label}</td><td>"), value, F.lit("</td><td>more</td></tr>"))
    labels = [("Адрес суда", F.concat(F.lit("ул. Мира, "), k)), ("Телефон:", k), ("Режим работы", "9-18"), ("ИНН", "52"), ("Адрес вышестоящего суда", "A"), ("Наименование отдела судебных приставов", "B"), ("БИК вышестоящего суда", "04"), ("Расчётный счёт", "40"), ("Прочее", "x"), ("Пусто", " ")]
    page = F.concat(F.lit("<table>"), *[cells(n, v if not isinstance(v, str) else F.lit(v)) for n, v in labels], F.lit("<tr><td>alone</td></tr></table>"))
    return key_values(t.pages.select("page_id", page.alias("html")), "page_id", "html").select(F.col("key").alias("page_id"), "category", "field", "value")


@query(
    """SELECT p_partkey, CASE WHEN k IN (0, 1) THEN p_size ELSE p_size END AS house_from, CASE k WHEN 0 THEN p_size + 10 WHEN 1 THEN p_size + 4 ELSE p_size END AS house_to,
  CASE k WHEN 0 THEN 'odd' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END END AS house_parity, CASE WHEN k < 2 THEN 2 END AS house_step
FROM (SELECT *, p_partkey % 3 AS k FROM part)"""
)
def q_house_ranges(t: Tables) -> DataFrame:
    """Cells of house numbers to ranges: a span with its parity, a list in steps of two, a single number."""
    k = F.col("p_partkey")
    cell = F.when(k % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 10).cast("string"), F.lit(" нечет"))).when(k % 3 == 1, F.concat_ws(", ", F.col("p_size").cast("string"), (F.col("p_size") + 2).cast("string"), (F.col("p_size") + 4).cast("string"))).otherwise(F.col("p_size").cast("string"))
    return t.part.select("p_partkey", F.explode(ranges.house_ranges(cell)).alias("r")).select("p_partkey", "r.*")


@query(
    """SELECT o_orderkey, unnest([1, 2]) - 1 AS pos, unnest(['Мира', 'Ленина']) AS street, unnest([k % 9 + 1, k % 50 + 2]) AS house_from, unnest([k % 9 + 21, k % 50 + 8]) AS house_to, unnest(['odd', 'even']) AS house_parity, 2 AS house_step,
  unnest([CASE WHEN k % 2 = 0 THEN 'а' END, NULL]) AS house_suffix FROM (SELECT o_orderkey, (o_orderkey % 1000)::INTEGER AS k FROM orders)"""
)
def q_statute_rules(t: Tables) -> DataFrame:
    """Sentences of a statute to street rules with houses, parity, step and suffix."""
    k = (F.col("o_orderkey") % 1000).cast("int")
    number = lambda c: c.cast("string")
    suffix = F.when(k % 2 == 0, "а").otherwise("")
    said = F.concat(F.lit("Улицы: Мира, дома "), number(k % 9 + 1), suffix, F.lit("-"), number(k % 9 + 21), suffix, F.lit(" нечетные; ул. Ленина, дома "), number(k % 50 + 2), F.lit("-"), number(k % 50 + 8), F.lit(" четные."))
    return t.orders.select("o_orderkey", F.posexplode(ranges.statute_rules(said)).alias("pos", "rule")).select("o_orderkey", "pos", "rule.street", "rule.houses.*")


@query(
    """SELECT k AS row_id, CASE WHEN k % 6 = 5 THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN k % 12 = 5 THEN 'ERROR_ADDRESS_NOT_FOUND' WHEN k % 12 = 11 THEN 'ERROR_EMPTY_ROW' END AS error_code,
  CASE WHEN k % 6 = 5 THEN NULL WHEN k % 30 = 0 THEN 'B' WHEN k % 6 < 2 THEN 'A' WHEN k % 6 = 2 THEN 'D' ELSE 'C' END AS stage,
  CASE WHEN k % 6 = 5 THEN NULL WHEN k % 30 = 0 THEN 'unified_B_dadata' ELSE ['law_rules', 'unified_A_district', 'dagalin_address_match', 'court_districts', 'courts_nearest'][k % 6 + 1] END AS source,
  CASE k % 6 WHEN 0 THEN k % 25 WHEN 1 THEN 100 + k % 5 WHEN 2 THEN 201 + k % 4 WHEN 3 THEN k % 25 WHEN 4 THEN k % 20 END::VARCHAR AS selected_court_id,
  CASE WHEN k % 6 = 5 THEN NULL WHEN k % 30 = 0 THEN 1.1 ELSE [0.3, 0.3, 0.5, 1.0, 0.5][k % 6 + 1] END::DOUBLE AS confidence_score, CASE WHEN k % 6 <> 5 THEN true END AS needs_manual_review
FROM (SELECT c_custkey AS k FROM customer)"""
)
def q_batch_pipeline(t: Tables) -> DataFrame:
    """Gate, candidates of every stage, votes and selection: each customer is found by another stage, or not at all."""
    k, none = F.col("c_custkey"), F.lit(None)
    case = lambda *values: F.when(k % 6 == 0, values[0]).when(k % 6 == 1, values[1]).when(k % 6 == 2, values[2]).when(k % 6 == 3, values[3]).when(k % 6 == 4, values[4]).otherwise(values[5])
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (k % by + 1).cast("int"))
    named, streets = ("Приокский", "Советский", "Ленинский", "Кировский", "Заводской"), ("Лесная", "Садовая", "Речная", "Полевая")
    n = k % 25
    written = case(
        F.concat(F.lit("Brand#"), n.cast("string"), F.lit(", д. "), (k % 40 + 1).cast("string")),
        F.concat(F.lit("Самарская область, "), pick(named, 5), F.lit(" район, д. 5")),
        F.concat(F.lit("ул. "), pick(streets, 4), F.lit(", д. 3")),
        none, none, F.when(k % 12 == 5, "неведомо"),
    )
    rows = t.customer.select(
        k.alias("row_id"), F.when(k % 12 != 11, F.col("c_name")).alias("fio"), written.alias("address"),
        case(none, none, none, 55.0755 + F.floor(n / 5) * 0.2, 10.001 + (k % 20) * 0.5, none).alias("lat"), case(none, none, none, 37.0755 + (n % 5) * 0.2, F.lit(20.0), none).alias("lng"),
    )
    section = lambda c: F.concat(F.lit("Судебный участок №"), c.cast("string"))
    places = t.spark.range(20).select(F.col("id").alias("place_id"), (F.col("id") * 0.5 + 10).alias("plat"), F.lit(20.0).alias("plon"), section(F.col("id")).alias("court_name"), F.col("id").alias("section_num"))
    m = F.col("n_nationkey")
    x, y = 37.0005 + (m % 5) * 0.2, 55.0005 + F.floor(m / 5) * 0.2
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    areas = t.nation.select(m.alias("area_id"), (m % 3).alias("kind"), section(m).alias("court_name"), m.alias("section_num"), F.array(corner(x, y), corner(x + 0.15, y), corner(x + 0.15, y + 0.15), corner(x, y + 0.15)).alias("ring"))
    districts = t.spark.createDataFrame([(i, "Самарская область", d, f"Судебный участок №{100 + i}") for i, d in enumerate(named)], "id long, region string, district string, court_name string")
    entries = t.spark.createDataFrame([(i, None, f"Судебный участок №{201 + i}", f"{s} улица, дома 1-9") for i, s in enumerate(streets)], "entry_id long, region_code string, court_name string, jurisdiction_text string")
    text_, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    rules = t.nation.select(m.alias("rule_order"), m.cast("string").alias("section_num"), F.lit("").alias("region"), text_.alias("area_text"), F.concat(F.lit(r"brand#"), m.cast("string"), F.lit(r"\b")).alias("street_pattern"), F.lit(1).alias("house_from"), F.lit(40).alias("house_to"), text_.alias("house_parity"), text_.alias("house_suffix"), number.alias("house_step"))
    provider = t.customer.filter(k % 30 == 0).select(k.alias("row_id"), section(n).alias("court_name"), n.alias("section_num"))
    candidates = batch.point_candidates(rows, areas, places).union(batch.address_candidates(rows, districts, entries, rules, provider))
    return batch.resolve_rows(rows, candidates).select("row_id", "status", "error_code", "stage", "source", "selected_court_id", "confidence_score", "needs_manual_review")


@query(
    """WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [[p_size, p_size + 4]] WHEN 1 THEN [[p_size, p_size], [p_size + 7, p_size + 7]] ELSE [[p_size, p_size + 6]] END AS r FROM part)
SELECT p_partkey, x[1]::INTEGER AS house_from, x[2]::INTEGER AS house_to, CASE p_partkey % 3 WHEN 0 THEN 'odd' WHEN 2 THEN CASE WHEN x[1] % 2 = 0 THEN 'even' ELSE 'odd' END END AS house_parity,
  CASE WHEN p_partkey % 3 <> 1 THEN 2 END::INTEGER AS house_step FROM (SELECT p_partkey, unnest(r) AS x FROM c)"""
)
def q_sql_house_ranges(t: Tables) -> DataFrame:
    """House ranges of cells by a row-maker in SQL."""
    sql.register(t.spark)
    return t.spark.sql(
        """SELECT p_partkey, r.* FROM (
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_size, '-', p_size + 4, ' нечет') WHEN 1 THEN concat(p_size, ' и ', p_size + 7) ELSE concat_ws(', ', p_size, p_size + 2, p_size + 4, p_size + 6) END AS cell FROM {part}
), LATERAL house_ranges(cell) r""",
        part=t.part,
    )


@query(
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, len(regexp_extract_all(html, '<a href=')) AS n_links,
  len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS text_sha256 FROM pages"""
)
def q_page_texts(t: Tables) -> DataFrame:
    """Title, host, links, paragraphs and plain text of whole pages as they were crawled."""
    html = F.col("html")
    plain = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    return t.pages.select(
        "page_id",
        F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_count(html, F.lit("<a href=")).cast("long").alias("n_links"),
        F.regexp_count(html, F.lit("<p[ >]")).cast("long").alias("n_paragraphs"),
        F.sha2(F.trim(F.regexp_replace(plain, r"[ \t\r\n]+", " ")), 256).alias("text_sha256"),
    )
