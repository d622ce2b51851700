"""Readers and writers on files made here, and the streaming forms."""

import datetime
import json
import time

from pyspark.sql import functions as F

from wardline.functions import grades
from wardline.plans import batch, wide
from wardline.sources import readers, writers
from wardline.streaming import stateful


def test_csv_and_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ФИО;Адрес;Широта;Долгота;Сумма долга\nA;;55,5;37,6;1 000,5\n;;1;2;3\n;Мира 5;;;x\n", encoding="utf-8")
    rows = readers.debtors(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.fio, r.address, r.lat, r.debt_amount) for r in rows] == [("A", None, 55.5, 1000.5), (None, "Мира 5", None, None)]
    (tmp_path / "b.csv").write_text("lat,lon\n55.1,37.1\nx,1\n91,1\n-5,5\n")
    assert sorted((r.row_number, r.lat) for r in readers.points_csv(spark, str(tmp_path / "b.csv")).collect()) == [(2, 55.1), (5, -5.0)]


def test_headers_of_debtor_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffID;Номер договора;ФИО;Адрес регистрации;Сумма долга;Тип дела\n7;Д-1; Иванов Иван ;г. Нижний Новгород, ул. Мира, д. 5;1 000,5;спор\n", encoding="utf-8")
    (r,) = readers.debtors(spark, str(tmp_path / "a.csv")).collect()
    assert (r.id, r.contract_number, r.fio, r.address, r.debt_amount, r.case_type) == ("7", "Д-1", "Иванов Иван", "г. Нижний Новгород, ул. Мира, д. 5", 1000.5, "спор")
    names = {"ф.и.о": "fio", "адрес": "address", "сумма": "debt_amount", "сумма иска": "debt_amount", "claim_amount": "debt_amount", "дата": "contract_date", "дата договора": "contract_date", "паспорт": "passport", "id дела": "id", "широта": "lat", "долгота": "lng", "longitude": "lng"}
    for header, name in names.items():
        df = readers.canonical(spark.createDataFrame([("5",)], f"`{header.upper()}` string"))
        assert df.columns == list(readers.DEBTOR) and df.first()[name] in ("5", 5.0)
    assert readers.canonical(spark.createDataFrame([("x",)], "name string")).first().fio is None


def test_row_numbers_of_several_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for i, sep in enumerate(";,"):
        lines = [f"lat{sep}lon{sep}сумма"] + [f'"{55 + j / 100}"{sep}37.5{sep}"{j}"' if j % 3 else f"x{sep}1{sep}2" for j in range(40)]
        (tmp_path / "d" / f"{i}.csv").write_text("\ufeff" * i + "\n".join(lines) + "\n", encoding="utf-8")
    got = readers.points_csv(spark, str(tmp_path / "d")).select("row_number", "lat", "debt_amount").collect()
    assert sorted(tuple(r) for r in got) == sorted(2 * [(j + 2, 55 + j / 100, float(j)) for j in range(40) if j % 3])


def test_row_numbers_of_a_file_in_blocks(spark, tmp_path):
    """A file that is read by several tasks is numbered like one that isn't."""
    (tmp_path / "big.csv").write_text("lat,lon,сумма\n" + "".join("\n" if i % 50 == 7 else f"{10 + i % 70},{i % 100},{i}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.points_csv(spark, str(tmp_path / "big.csv"))
        assert spark.read.text(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 5
        got = sorted((r.row_number, int(r.debt_amount)) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i + 2, i) for i in range(4000) if i % 50 != 7]


def test_positional_lists_and_seeds(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes('"Участок 5";"Мира, 1";831;111-22\r\nБ;;;\n'.encode("windows-1251"))
    got = readers.positional_csv(spark, str(tmp_path / "p.csv"), {"name": 0, "address": 1, "phone": [2, 3], "none": 9}).collect()
    assert [tuple(r) for r in got] == [("Участок 5", "Мира, 1", "831, 111-22", ""), ("Б", "", "", "")]
    (tmp_path / "dump_1.json").write_text('[{"name": "old"}]')
    time.sleep(1.1)
    (tmp_path / "dump_2.json").write_text('[{"name": "new"}, {"name": " "}]')
    catalogue, dumps = str(tmp_path / "catalogue.json"), str(tmp_path / "dump_*.json")
    assert [r.name for r in readers.seed_priority(spark, catalogue, dumps, "name string").collect()] == ["new"]
    (tmp_path / "catalogue.json").write_text('[{"name": "first"}]')
    assert [r.name for r in readers.seed_priority(spark, catalogue, dumps, "name string").collect()] == ["first"]
    assert readers.seed_priority(spark, str(tmp_path / "none.json"), str(tmp_path / "none_*.json"), "name string").count() == 0
    assert readers.latest_file(spark, dumps).endswith("dump_2.json")
    assert [r.x for r in readers.json_list(spark, str(tmp_path / "catalogue.json"), "name string").selectExpr("name AS x").collect()] == ["first"]
    answers = spark.createDataFrame([('{"items": [1, 2]}',), ('[3]',), ("x",)], "r string")
    assert [r.n for r in answers.select(F.size(readers.unwrapped(F.col("r"))).alias("n")).collect()] == [2, 1, 0]


def test_geojson_and_kml(spark, tmp_path):
    point = lambda c, **p: {"type": "Feature", "geometry": {"type": "Point", "coordinates": c}, "properties": p}
    square = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    areas = [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [square]}, "properties": {"title": "Участок № 7"}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}, "properties": {"name": "b", "section_num": 9}},
        point([1, 2]),
    ]
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [point([37.5, 55.5], name="n"), point([200, 5]), areas[0]]}))
    assert [tuple(r) for r in readers.debtors(spark, str(tmp_path / "p.geojson")).collect()] == [("n", None, 55.5, 37.5, "", None, 1)]
    (tmp_path / "a.json").write_text(json.dumps({"features": areas}))
    got = readers.geojson_areas(spark, str(tmp_path / "a.json"))
    assert sorted((r.name, r.section_num, len(r.ring)) for r in got.collect()) == [("b", 9, 5), ("Участок № 7", 7, 5)]
    back = [json.loads(r.value) for r in writers.geojson_features(got).collect()]
    assert {f["geometry"]["type"] for f in back} == {"Polygon"}
    (tmp_path / "k.kml").write_text("<kml><Placemark><name>x</name><Point><coordinates>37.5,55.5,0</coordinates></Point></Placemark><Placemark><name>y</name></Placemark></kml>")
    assert [tuple(r) for r in readers.kml_points(spark, str(tmp_path / "k.kml")).collect()] == [("x", 55.5, 37.5)]


def test_workbooks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A & Б", "Мира, 5", "10,5"), ("B", None, None)], "fio string, address string, debt_amount string")
    writers.xlsx({"results": df, "statistics": df.limit(1)}, str(tmp_path / "w.xlsx"))
    rows = readers.debtors(spark, str(tmp_path / "w.xlsx")).collect()
    assert [(r.fio, r.address, r.debt_amount) for r in rows] == [("A & Б", "Мира, 5", 10.5), ("B", None, None)]


def test_other_readers(spark, tmp_path):
    (tmp_path / "courts.csv").write_text("Регион;Участок;Название\nR; 5 ;N\nR;x; \n")
    assert [(r.region, r.section_num, r.court_name) for r in readers.courts_csv(spark, str(tmp_path / "courts.csv")).collect()] == [("R", 5, "N"), ("R", None, None)]
    (tmp_path / "rules.csv").write_text("s;r;a;p;f;t;y;x;z;l\n1;;;ул[;1;2;;;;\n2;;;мира;1;x;odd;;2;ref\n;;;;;;;;;\n")
    assert [(r.section_num, r.house_from, r.house_to) for r in readers.law_rules_csv(spark, str(tmp_path / "rules.csv")).collect()] == [("2", 1, None)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.txt").write_bytes("Участок № 12\nТел.: +7 (831) 111-22-33\nx@y.ru".encode())
    assert [(r.section, r.email, r.phone) for r in readers.contact_files(spark, str(tmp_path / "c")).collect()] == [(12, "x@y.ru", "+7 (831) 111-22-33")]
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9)], "id int, parent int")
    assert sorted((r.id, r.depth) for r in readers.resource_tree(spark, nodes, 1).collect()) == [(1, 0), (2, 1), (3, 2)]
    pages = spark.createDataFrame([(1, "<table><tr><th>Тел</th><td> 5 <b>6</b></td></tr></table><script>x</script><p>Hi</p>"), (2, None)], "id long, html string")
    assert [(r.key, r.cells) for r in readers.html_rows(pages, "id", "html").collect()] == [(1, ["Тел", "5 6"])]
    assert pages.select(readers.html_text("html").alias("t")).first().t == "Тел 5 6\nHi"
    texts = spark.createDataFrame([(1, "Советский район\nУчасток № 1 улица А\nПриокский район\nУчасток № 2 улица Б")], "doc int, text string")
    assert [(r.section, r.district) for r in readers.section_texts(texts).orderBy("section").collect()] == [(1, "Советский район"), (2, "Приокский район")]


def test_files_in_windows_1251(spark, tmp_path):
    (tmp_path / "c").mkdir()
    contact, area = "Участок № 12\nТелефон: +7 (831) 111-22-33\nx@y.ru", {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}, "properties": {"title": "Участок № 7"}}
    (tmp_path / "c" / "1.txt").write_bytes(contact.encode("windows-1251"))
    (tmp_path / "c" / "2.txt").write_bytes(b"\xef\xbb\xbf" + contact.encode())
    (tmp_path / "c" / "3.txt").write_bytes(b"\x98 z@y.ru")  # no character of windows-1251
    got = readers.contact_files(spark, str(tmp_path / "c")).orderBy("path").collect()
    assert [(r.section, r.email, r.phone) for r in got] == [(12, "x@y.ru", "+7 (831) 111-22-33")] * 2 + [(None, "z@y.ru", None)]
    (tmp_path / "a.json").write_bytes(json.dumps({"features": [area]}, ensure_ascii=False).encode("windows-1251"))
    assert [(r.name, r.section_num) for r in readers.geojson_areas(spark, str(tmp_path / "a.json")).collect()] == [("Участок № 7", 7)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", "Мира", None, "ERROR", "ERROR_NO_ADDRESS", 1000.0, "c", "d")], "row_id int, fio string, address string, inn string, status string, error_code string, debt_amount double, court_name string, court_address string")
    writers.result_csv(df, str(tmp_path / "out"), ["fio", "inn", "other"])
    assert spark.read.text(str(tmp_path / "out")).filter("value LIKE 'A;%'").first().value.startswith("A;")
    first = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert first.startswith("\ufefffio;inn;other\n".encode())
    paid = spark.createDataFrame([("7", None, "1", " "), (None, "Д-1", None, "99")], "id string, contract_number string, `ИНН` string, `КБК` string")
    columns = ["№ Договора", "Банк получателя", "БИК", "ИНН", "КПП", "№ Счета", "Наименование получателя платежа", "КБК", "ОКТМО", "№ казначейского счета"]
    assert writers.payment_rows(paid).columns == columns
    assert [(r["№ Договора"], r["ИНН"], r["КБК"], r["Наименование получателя платежа"], r["БИК"]) for r in writers.payment_rows(paid).collect()] == [("7", "1", "18210803010011050110", "Казначейство России (ФНС России)", ""), ("Д-1", "", "99", "Казначейство России (ФНС России)", "")]
    (e,) = writers.error_rows(df).collect()
    assert (e.label, e.recommendation) == ("Адрес не указан", "Укажите адрес регистрации.")
    claim = json.loads(writers.claims(df.withColumn("passport", F.lit("22 01 123456"))).first().claim)
    assert list(claim) == ["court", "plaintiff", "defendant", "claim", "contract", "facts", "attachments"]
    assert (claim["defendant"]["passport_series"], claim["defendant"]["passport_number"], claim["defendant"]["address_residence"]) == ("2201", "123456", "Мира")
    assert (claim["claim"]["price"], claim["claim"]["state_duty"], claim["contract"]["way_of_conclusion"], len(claim["attachments"])) == (1000.0, 32.0, "дистанционно", 7)
    colours = writers.coloured(spark.createDataFrame([("PERFECT",), ("POOR",), ("?",)], "g string"), "g").collect()
    assert [r.color for r in colours] == ["C6EFCE", "FF9999", "FFE6CC"]


def test_error_codes(spark):
    said = {"Адрес не найден": "ERROR_ADDRESS_NOT_FOUND", "неоднозначный": "ERROR_AMBIGUOUS", "low_precision": "ERROR_LOW_PRECISION", "вне границы": "ERROR_COURT_NOT_FOUND", "Пустая строка": "ERROR_EMPTY_ROW", "адрес не указан": "ERROR_NO_ADDRESS", "Некорректная широта": "ERROR_INVALID_COORDS", "timeout": "ERROR_COURT_NOT_FOUND", None: "ERROR_COURT_NOT_FOUND"}
    rows = spark.createDataFrame([(k,) for k in said], "m string").select("m", grades.error_class(F.col("m")).alias("code")).collect()
    assert {r.m: r.code for r in rows} == said


def test_batch_plan(spark):
    rows = spark.createDataFrame(
        [(1, "a", "город, Мира, д. 5", 0.5, 0.5), (2, "b", None, 50.0, 50.0), (3, None, None, None, None), (4, "c", "неведомо", None, None)],
        "row_id int, fio string, address string, lat double, lng double",
    ).withColumns({c: F.lit(None).cast("string") for c in ("region", "district", "street", "house")})
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]
    areas = spark.createDataFrame([(1, 0, "Судебный участок №3", 3, ring)], "area_id int, kind int, court_name string, section_num int, ring array<struct<x:double,y:double>>")
    courts = spark.createDataFrame([(1, 80.0, 80.0, "far", 1)], "place_id int, plat double, plon double, court_name string, section_num int")
    districts = spark.createDataFrame([(1, "r", "d", "x")], "id int, region string, district string, court_name string")
    entries = spark.createDataFrame([(1, "52", "Судебный участок №3", "мира город")], "entry_id int, region_code string, court_name string, jurisdiction_text string")
    from .test_joins import RULES

    rules = spark.createDataFrame([(1, "3", "", None, "мира", 1, 9, None, None, None)], RULES)
    candidates = batch.point_candidates(rows, areas, courts).union(batch.address_candidates(rows, districts, entries, rules))
    got = {r.row_id: r for r in batch.resolve_rows(rows, candidates).collect()}
    assert (got[1].status, got[1].selected_court_id, got[1].confidence_score) == ("OK", "3", 1.3)
    assert [got[i].error_code for i in (2, 3, 4)] == ["ERROR_COURT_NOT_FOUND", "ERROR_EMPTY_ROW", "ERROR_ADDRESS_NOT_FOUND"]


def at(minute):
    return datetime.datetime(2024, 1, 1, 12, 0) + datetime.timedelta(minutes=minute)


def run_stream(spark, tmp_path, rows, plan, name):
    source = tmp_path / name
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "key string, status string, at timestamp").coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.05)
    stream = spark.readStream.schema("key string, status string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = plan(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name).collect()


def test_streamed_changes(spark, tmp_path):
    rows = [[("a", "new", at(0)), ("b", "new", at(1))], [("a", "new ", at(2)), ("a", "paid", at(3))], [("b", None, at(4)), ("a", "closed", at(5))]]
    got = run_stream(spark, tmp_path, rows, stateful.status_changes, "changed")
    assert sorted((r.key, r.previous, r.status) for r in got) == [("a", "new", "paid"), ("a", "paid", "closed"), ("b", "new", "")]


def test_streamed_windows_drop_late_rows(spark, tmp_path):
    rows = [[("a", "", at(1)), ("a", "", at(2))], [("a", "", at(90))], [("a", "", at(200))], [("a", "", at(3)), ("a", "", at(300))], [("a", "", at(500))]]
    got = run_stream(spark, tmp_path, rows, lambda s: stateful.tumbling_counts(s, "key", "at", "1 hour"), "counted")
    assert (at(0), 2) in {(r.began, r.n) for r in got}
    sessions = run_stream(spark, tmp_path, rows, lambda s: stateful.session_counts(s, "key", "at", "30 minutes"), "sessions")
    assert (at(1), 2) in {(r.began, r.n) for r in sessions}


def test_streamed_sliding_minute(spark, tmp_path):
    rows = [[("a", "", at(0)), ("a", "", at(0.5))], [("a", "", at(30))], [("a", "", at(60))]]
    got = run_stream(spark, tmp_path, rows, lambda s: stateful.sliding_counts(s, "key", "at", "60 seconds", "30 seconds"), "slid")
    assert {(r.ended, r.n) for r in got} >= {(at(0.5), 1), (at(1), 2), (at(1.5), 1)}


def test_positions(spark):
    messages = ['{"mmsi": 1, "lat": 0, "lon": 5}', '{"data": {"MMSI": "2", "latitude": 1.5, "longitude": 2.5}}', "nonsense", '{"mmsi": 3}']
    df = spark.createDataFrame([(m,) for m in messages], "value string")
    assert [(r.mmsi, r.lat, r.lon) for r in stateful.positions(df).collect()] == [("1", 0.0, 5.0), ("2", 1.5, 2.5)]


def test_wide_rows(spark):
    resolved = spark.createDataFrame(
        [(1, "Мира, 5", 0.9, True, "auto", "спор", False, "С1", "R", "3", "A", None, " ", "postgis", 1000.0), (2, None, None, False, None, None, None, None, "X", "y", None, None, None, "?", None)],
        "row_id int, normalized_address string, confidence double, needs_manual_review boolean, level string, case_type string, exclusive boolean, court_name string, region string, section_num string, address string, email string, phone string, source string, debt_amount double",
    )
    regions = spark.createDataFrame([("R", "52MS", "http://r")], "region string, region_code string, site string")
    details = spark.createDataFrame([("R", 3, *"1234567")], "region string, section_num int, " + ", ".join(f"`{c}` string" for c in wide.DETAILS))
    out = {r.row_id: r.asDict() for r in wide.wide_rows(resolved, regions, details).collect()}
    assert len(out[1]) == 50 and all(isinstance(v, str) for k, v in out[2].items() if k != "row_id")
    assert (out[1]["Код суда"], out[1]["Требует проверки"], out[1]["Госпошлина, руб."], out[1]["Банк"], out[1]["Телефон суда"]) == ("52MS3", "Да", "32.00", "7", "")
    assert out[2]["Код суда"] == "" and out[2]["Источник данных"] == ""
