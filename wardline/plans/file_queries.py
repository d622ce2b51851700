"""Queries that write tables in the formats of files and read them again, and those of the output formats.

Files go to the shared folder. Where a format is one document a file, rows are written as
many files, by groups of keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text
from wardline.operators.shared import shared_folder
from wardline.sources import readers, writers
from wardline.streaming import stateful

from .registry import Tables, lat, lon, query, sql_point

#: Keys whose rows share a file.
EACH = 500


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


def _by_file(df: DataFrame, group: Column, path: str) -> str:
    """Texts (column value) written as one file for each group."""
    df.select(group.cast("long").alias("file"), "value").repartition("file").write.partitionBy("file").text(path)
    return path


def _collections(features: DataFrame, group: Column) -> DataFrame:
    """Features (JSON, column value) to collections, one for each group of EACH keys at most."""
    grouped = features.groupBy(group.cast("long").alias("file")).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("all"))
    return grouped.select("file", F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}")).alias("value"))


@query(
    """SELECT c_custkey::VARCHAR AS contract_number, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS fio, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment || '; "x"' END AS address, c_acctbal::DOUBLE AS debt_amount, c_mktsegment AS case_type
FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 7 <> 0"""
)
def q_debtor_csv(t: Tables) -> DataFrame:
    """Lists of debtors out as files with a byte order mark and in again, under other names of the columns."""
    k = F.col("c_custkey")
    path = _folder(t)
    rows = t.customer.select(
        k.alias("Номер договора"), F.when(k % 5 != 0, F.col("c_name")).alias("ФИО"), F.when(k % 7 != 0, F.concat("c_mktsegment", F.lit('; "x"'))).alias("Адрес регистрации"),
        F.concat(F.lit(" "), F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))).alias("Сумма долга"), F.col("c_mktsegment").alias("Тип дела"),
    )
    quoted = rows.withColumn("Адрес регистрации", F.replace("Адрес регистрации", F.lit('"'), F.lit("'")))
    writers.result_csv(quoted, path, ["Номер договора", "ФИО", "Адрес регистрации", "Сумма долга", "Тип дела"])
    read = readers.debtors_csv(t.spark, path)
    return read.select("contract_number", "fio", F.replace("address", F.lit("'"), F.lit('"')).alias("address"), "debt_amount", "case_type")


@query(
    f"""WITH p AS (SELECT c_custkey, c_custkey // {EACH} AS file, {sql_point('c_custkey')}, c_custkey % 11 = 0 AS bad, row_number() OVER (PARTITION BY c_custkey // {EACH} ORDER BY c_custkey) + 1 AS row_number FROM customer)
SELECT c_custkey::VARCHAR AS id, row_number, lat, lon AS lng FROM p WHERE NOT bad"""
)
def q_points_csv(t: Tables) -> DataFrame:
    """Points of files with comma or semicolon, their rows numbered file by file; rows without valid coordinates go."""
    k = F.col("c_custkey")
    sep = F.when(F.floor(k / EACH) % 2 == 0, ",").otherwise(";")
    line = F.concat(k.cast("string"), sep, F.lit('"'), F.when(k % 11 == 0, "x").otherwise(lat("c_custkey").cast("string")), F.lit('"'), sep, lon("c_custkey").cast("string"))
    files = t.customer.groupBy(F.floor(k / EACH).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda r: r["line"]), "\n").alias("lines"), F.first(sep).alias("sep"))
    head = F.concat(F.lit("ID дела"), "sep", F.lit("Широта"), "sep", F.lit("Долгота\n"))
    path = _by_file(files.select("file", F.concat(head, "lines").alias("value")), F.col("file"), _folder(t))
    return readers.points_csv(t.spark, path).select("id", "row_number", "lat", "lng")


@query(f"SELECT c_name AS fio, c_mktsegment AS address, lat, lon AS lng, CASE WHEN k % 3 = 0 THEN c_mktsegment ELSE '' END AS case_type FROM (SELECT *, c_custkey AS k, {sql_point('c_custkey')} FROM customer) WHERE k % 13 <> 0")
def q_geojson_points(t: Tables) -> DataFrame:
    """Points of feature collections; other geometries and points off the map are left out."""
    k = F.col("c_custkey")
    at = F.array(F.when(k % 26 == 0, 999.0).otherwise(lon("c_custkey")), lat("c_custkey"))
    geometry = F.struct(F.when(k % 26 == 13, "LineString").otherwise("Point").alias("type"), at.alias("coordinates"))
    properties = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("address"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("тип_дела"))
    features = t.customer.select("c_custkey", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))
    path = _by_file(_collections(features, F.floor(k / EACH)), F.col("file"), _folder(t))
    return readers.geojson_points(t.spark, path).select("fio", "address", "lat", "lng", "case_type")


@query("SELECT 'Участок № ' || c_custkey::VARCHAR AS name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000 END::INTEGER AS section_num, 5 AS corners, (c_custkey % 170)::DOUBLE AS x FROM customer")
def q_geojson_areas(t: Tables) -> DataFrame:
    """Areas out as features, in collections, and in again: rings are closed, a section is named or read from the title."""
    k = F.col("c_custkey")
    x = (k % 170).cast("double")
    corner = lambda a, b: F.struct((x + a).alias("x"), F.lit(float(b)).alias("y"))
    areas = t.customer.select(F.concat(F.lit("Участок № "), k.cast("string")).alias("title"), F.when(k % 2 != 0, k + 1_000_000).alias("section_num"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    features = writers.geojson_features(areas).withColumn("file", F.pmod(F.xxhash64("value"), F.lit(8)))
    path = _by_file(_collections(features, F.col("file")), F.col("file"), _folder(t))
    read = readers.geojson_areas(t.spark, path)
    return read.select("name", "section_num", F.size("ring").alias("corners"), F.col("ring")[0]["x"].alias("x"))


@query(f"SELECT c_name AS name, lat, lon AS lng FROM (SELECT c_name, c_custkey, {sql_point('c_custkey')} FROM customer) WHERE c_custkey % 9 <> 0")
def q_kml_points(t: Tables) -> DataFrame:
    """Placemarks; those without a point go."""
    k = F.col("c_custkey")
    point = F.when(k % 9 != 0, F.concat(F.lit("<Point><coordinates>"), F.concat_ws(",", lon("c_custkey").cast("string"), lat("c_custkey").cast("string"), F.lit("0")), F.lit("</coordinates></Point>"))).otherwise("")
    mark = F.concat(F.lit("<Placemark><name>"), "c_name", F.lit("</name>"), point, F.lit("</Placemark>"))
    files = t.customer.groupBy(F.floor(k / EACH).alias("file")).agg(F.concat(F.lit("<kml>"), F.array_join(F.collect_list(mark), "\n"), F.lit("</kml>")).alias("value"))
    path = _by_file(files, F.col("file"), _folder(t))
    return readers.kml_points(t.spark, path)


@query("SELECT s_name AS fio, CASE WHEN s_suppkey % 4 <> 0 THEN s_name || ' & <Б>' END AS address, s_acctbal::DOUBLE AS debt_amount FROM supplier")
def q_workbook(t: Tables) -> DataFrame:
    """A workbook of several sheets out and the first of them in again."""
    from pyarrow import fs

    rows = t.supplier.select(F.col("s_name").alias("ФИО"), F.when(F.col("s_suppkey") % 4 != 0, F.concat("s_name", F.lit(" & <Б>"))).alias("Адрес"), F.col("s_acctbal").cast("string").alias("Сумма"))
    path = _folder(t)
    store, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/results.xlsx") as out:
        writers.xlsx({"results": rows, "statistics": writers.statistics(t.supplier.select(F.lit("OK").alias("status")))}, out)
    return readers.debtors(t.spark, f"{path}/results.xlsx").select("fio", "address", "debt_amount")


@query("SELECT n_name AS region, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS district, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey END::INTEGER AS section_num, c_name AS court_name, c_name AS coordinates FROM customer JOIN nation ON n_nationkey = c_nationkey")
def q_courts_csv(t: Tables) -> DataFrame:
    """A list of courts: columns in either language, blanks are nulls, and so are sections that are no numbers."""
    k = F.col("c_custkey")
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("n_name").alias("Регион"), F.when(k % 4 != 0, F.col("c_mktsegment")).otherwise("").alias("район"), F.when(k % 6 != 0, k.cast("string")).otherwise("б/н").alias("Участок"), F.col("c_name").alias("court_name"), F.col("c_name").alias("Координаты")
    )
    path = _folder(t)
    rows.write.csv(path, sep=";", header=True)
    return readers.courts_csv(t.spark, path).select("region", "district", "section_num", "court_name", "coordinates")


@query("SELECT p_partkey::VARCHAR AS section_num, p_brand AS street_pattern, CASE WHEN p_size % 3 <> 0 THEN p_size END AS house_from, 'odd' AS house_parity FROM part WHERE p_partkey % 4 < 2")
def q_law_rules_csv(t: Tables) -> DataFrame:
    """Rules of a file: blank rows go, and those whose pattern is no regular expression."""
    k = F.col("p_partkey")
    pattern = F.when(k % 4 < 2, F.col("p_brand")).when(k % 4 == 2, "ул[")
    none = lambda n: F.lit(None).cast("string").alias(n)
    rows = t.part.select(k.cast("string").alias("section_num"), none("region"), none("area_text"), pattern.alias("street_pattern"), F.when(F.col("p_size") % 3 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("house_from"), none("house_to"), F.lit("odd").alias("house_parity"), none("house_suffix"), none("house_step"), none("law_reference"))
    path = _folder(t)
    rows.write.csv(path, sep=";", header=True)
    return readers.law_rules_csv(t.spark, path).select("section_num", "street_pattern", "house_from", "house_parity")


@query("SELECT 'Участок ' || n_nationkey::VARCHAR AS name, n_name || ', 1' AS address, '8312-' || n_nationkey::VARCHAR || CASE WHEN n_nationkey % 2 = 0 THEN ', 55' ELSE '' END AS phone FROM nation")
def q_positional_csv(t: Tables) -> DataFrame:
    """Columns by their place, phones of two columns joined."""
    n = F.col("n_nationkey").cast("string")
    lines = t.nation.select(F.concat(F.lit('"Участок '), n, F.lit('";"'), "n_name", F.lit(', 1";8312-'), n, F.when(F.col("n_nationkey") % 2 == 0, ";55").otherwise(";")).alias("value"))
    path = _folder(t)
    lines.write.text(path)
    return readers.positional_csv(t.spark, path, {"name": 0, "address": 1, "phone": [2, 3]})


@query("SELECT n_nationkey::INTEGER + 1 AS section, lower(replace(n_name, ' ', '')) || '@court.example' AS email, '+7 (831) ' || (100 + n_nationkey)::VARCHAR || '-22' AS phone FROM nation")
def q_contact_files(t: Tables) -> DataFrame:
    """Files of one record each."""
    n = F.col("n_nationkey")
    record = F.concat(F.lit("Участок № "), (n + 1).cast("string"), F.lit("\nТелефон: +7 (831) "), (n + 100).cast("string"), F.lit("-22\n"), F.lower(F.replace("n_name", F.lit(" "), F.lit(""))), F.lit("@court.example"))
    path = _by_file(t.nation.select("n_nationkey", record.alias("value")), n, _folder(t))
    return readers.contact_files(t.spark, f"{path}/*/*.txt").select("section", "email", "phone")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0")
def q_seed_priority(t: Tables) -> DataFrame:
    """The named objects of the newest dump where the catalogue's file isn't there."""
    path = _folder(t)
    k = F.col("s_suppkey")
    items = t.supplier.select(F.to_json(F.struct(k.alias("id"), F.when(k % 5 != 0, F.col("s_name")).otherwise(" ").alias("name"))).alias("value"))
    dump = items.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]")).alias("value"))  # a file is one list
    dump.coalesce(1).write.text(f"{path}/dump_1")
    return readers.seed_priority(t.spark, f"{path}/catalogue.json", f"{path}/dump_*/*.txt", "id long, name string")


@query(
    """WITH RECURSIVE tree AS (SELECT 1::BIGINT AS id, 0 AS depth UNION ALL SELECT c_custkey, depth + 1 FROM customer JOIN tree ON c_custkey // 6 = id AND c_custkey > 1)
SELECT id, depth FROM tree"""
)
def q_resource_tree(t: Tables) -> DataFrame:
    """All under a root."""
    k = F.col("c_custkey")
    nodes = t.customer.filter(k >= 1).select(k.alias("id"), F.when(k > 1, F.floor(k / 6)).alias("parent"))
    return readers.resource_tree(t.spark, nodes, 1).select("id", "depth")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS n FROM orders"""
)
def q_unwrapped(t: Tables) -> DataFrame:
    """Items of an API's answers, as a list or under one of several names."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    said = F.when(k % 4 == 0, F.concat(F.lit('{"data": ['), n, F.lit(', {"a": 1}]}'))).when(k % 4 == 1, F.concat(F.lit('{"features": [{"id": '), n, F.lit("}]}"))).when(k % 4 == 2, F.concat(F.lit("[1, 2, "), n, F.lit("]"))).otherwise(F.concat(F.lit("error "), n))
    return t.orders.select("o_orderkey", F.size(readers.unwrapped(said)).alias("n"))


@query(
    """SELECT c_custkey AS doc, i AS section, CASE WHEN i <= 2 THEN 'Советский район' ELSE 'Приокский район' END AS district, 'улица ' || (c_custkey + i)::VARCHAR AS street FROM customer, range(1, 4) r(i) WHERE i <= 1 + c_custkey % 3"""
)
def q_section_texts(t: Tables) -> DataFrame:
    """Documents cut at their sections, with the district heading above."""
    k = F.col("c_custkey")
    part = lambda i: F.concat(F.lit(f"Участок № {i} улица "), (k + i).cast("string"), F.lit("\n"))
    said = F.concat(F.lit("Советский район\n"), part(1), F.when(k % 3 > 0, part(2)).otherwise(""), F.when(k % 3 > 1, F.concat(F.lit("Приокский район\n"), part(3))).otherwise(""))
    cut = readers.section_texts(t.customer.select(k.alias("doc"), said.alias("text")))
    return cut.select("doc", "section", "district", F.regexp_extract("body", r"(улица \d+)", 1).alias("street"))


@query(
    """SELECT c_custkey::VARCHAR AS contract, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS inn, CASE WHEN c_custkey % 2 = 0 THEN '18210803010011050110' ELSE 'K' || c_custkey::VARCHAR END AS kbk, 'Казначейство России (ФНС России)' AS recipient FROM customer"""
)
def q_payment_rows(t: Tables) -> DataFrame:
    """The payment format with its defaults."""
    k = F.col("c_custkey")
    rows = writers.payment_rows(t.customer.select(F.when(k % 4 == 0, k.cast("string")).alias("id"), k.cast("string").alias("contract_number"), F.when(k % 3 != 0, F.col("c_name")).alias("ИНН"), F.when(k % 2 == 0, " ").otherwise(F.concat(F.lit("K"), k.cast("string"))).alias("КБК")))
    return rows.select(F.col("№ Договора").alias("contract"), F.col("ИНН").alias("inn"), F.col("КБК").alias("kbk"), F.col("Наименование получателя платежа").alias("recipient"))


@query("SELECT c_custkey, ['C6EFCE', 'FFF2CC', 'F4B084', 'FF9999', 'FFE6CC', 'FFE6CC'][c_custkey % 6 + 1] AS color FROM customer")
def q_coloured(t: Tables) -> DataFrame:
    grade = F.element_at(F.array(*map(F.lit, ["PERFECT", "GOOD", "WARNING", "POOR", "MANUAL", "?"])), (F.col("c_custkey") % 6 + 1).cast("int"))
    return writers.coloured(t.customer.select("c_custkey", grade.alias("grade")), "grade").select("c_custkey", "color")


@query(
    """SELECT c_custkey AS row_id, c_name AS fio, CASE WHEN c_custkey % 2 = 0 THEN '2201' ELSE '' END AS series, c_acctbal::DOUBLE AS price, 'дистанционно' AS way, 7 AS enclosed FROM customer"""
)
def q_claims(t: Tables) -> DataFrame:
    """Claims as nested documents, read again by their paths."""
    k = F.col("c_custkey")
    rows = t.customer.select(k.alias("row_id"), F.col("c_name").alias("fio"), F.when(k % 2 == 0, F.lit("22 01 № 123456")).alias("passport"), F.col("c_acctbal").cast("double").alias("debt_amount"))
    v = F.parse_json("claim")
    at = lambda path, kind: F.variant_get(v, path, kind)
    made = writers.claims(rows)
    return made.select("row_id", at("$.defendant.fio", "string").alias("fio"), at("$.defendant.passport_series", "string").alias("series"), at("$.claim.price", "double").alias("price"), at("$.contract.way_of_conclusion", "string").alias("way"), F.size(at("$.attachments", "array<string>")).alias("enclosed"))


@query("SELECT o_orderkey, o_orderkey % 60 AS section, 'ул. Мира, ' || o_orderkey::VARCHAR AS light, 'Участок № ' || o_orderkey::VARCHAR || chr(10) || 'дом 5' AS lines FROM orders")
def q_light_texts(t: Tables) -> DataFrame:
    """Addresses tidied lightly, sections from the first column that has one, scanned lines without strange signs."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    section = text.first_section(F.when(k % 2 == 0, "без номера").otherwise(F.concat(F.lit("№"), (k % 60).cast("string"), F.lit(" и 7"))), k % 60)
    return t.orders.select(
        "o_orderkey", section.cast("long").alias("section"), text.light_normalize(F.concat(F.lit(" ул.  Мира., "), n)).alias("light"),
        text.clean_lines(F.concat(F.lit("Участок № "), n, F.lit(" §\n~ab\nдом 5*"))).alias("lines"),
    )


@query("SELECT event_id::VARCHAR AS mmsi, value::DOUBLE AS lat, (value * 2)::DOUBLE AS lon FROM events WHERE event_id % 4 <> 3")
def q_positions(t: Tables) -> DataFrame:
    """Ship positions from messages of several shapes; those without coordinates are none."""
    k, v = F.col("event_id"), F.col("value").cast("double")
    flat = F.to_json(F.struct(k.alias("mmsi"), v.alias("lat"), (v * 2).alias("lon")))
    deep = F.to_json(F.struct(F.struct(k.cast("string").alias("MMSI"), v.alias("latitude"), (v * 2).alias("longitude")).alias("vessel")))
    data = F.to_json(F.struct(F.struct(k.alias("mmsi"), v.alias("lat"), (v * 2).alias("lng")).alias("data")))
    said = F.when(k % 4 == 0, flat).when(k % 4 == 1, deep).when(k % 4 == 2, data).otherwise(F.concat(F.lit("ping "), k.cast("string")))
    return stateful.positions(t.events.select(said.alias("value"))).select("mmsi", "lat", "lon")
