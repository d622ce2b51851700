"""The vote aggregate's contract, case by case."""

import pytest
from pyspark.sql import functions as F

from wardline.operators import resolve, tables, votes

N1, N2, N3 = (f"Мировой судебный участок №{i}" for i in (1, 2, 3))
CASES = [
    ("polygon and street", [("polygon", N1, 1.0), ("dadata", N1, 0.8)], N1, 1.8, False, False),
    ("street and houses", [("dadata", N1, 0.8), ("dagalin", N1, 0.5)], N1, 1.3, True, False),
    ("street only", [("dagalin", N1, 0.5)], N1, 0.5, True, False),
    ("polygon against other sources", [("polygon", N1, 1.0), ("dadata", N2, 0.8)], N1, 1.0, True, True),
    ("all sources differ", [("polygon", N1, 1.0), ("dadata", N2, 0.8), ("dagalin", N3, 0.5), ("district_db", "№4", 0.3)], N1, 0.3, True, True),
    ("street and houses", [("dadata", "МСУ №5 Советского района", 0.8), ("dagalin", "МСУ №5 Приокского района", 0.5)], "МСУ №5 Советского района", 0.8, True, True),
    ("polygon and street", [("polygon", "Участок 2 (чёт)", 1.0), ("dadata", "Участок 2 (чет)", 0.8)], "Участок 2 (чёт)", 1.8, False, False),
    ("street and houses", [("dagalin", N1, 0.5), ("district_db", N1, 0.3)], N1, 0.8, True, False),
    ("no data", [("dagalin", "  ", 0.5)], None, 0.0, True, False),
    ("polygon and street", [("polygon", N1, 1.0), ("dadata", N1, 0.8), ("dagalin", N2, 0.5)], N1, 1.8, False, False),
    ("street and houses", [("dadata", N2, 0.8), ("dagalin", N1, 0.5), ("district_db", N1, 0.3)], N2, 0.8, True, True),
]


def test_cases(spark):
    rows = [(i, p, s, n, w) for i, case in enumerate(CASES) for p, (s, n, w) in enumerate(case[1])]
    from wardline.functions.text import court_key

    table = spark.createDataFrame(rows, "probe int, pos int, source string, court_name string, weight double").withColumn("court_key", court_key(F.col("court_name")))
    got = {r.probe: r for r in votes.resolve(table).collect()}
    for i, (reason, _, name, score, manual, conflict) in enumerate(CASES):
        r = got[i]
        assert (r.reason, r.court_name, r.confidence_score, r.needs_manual_review, r.conflict) == (reason, name, score, manual, conflict), CASES[i]


def test_threshold(spark):
    table = spark.createDataFrame([(1, 0, "dadata", "A", "a", 0.8), (1, 1, "dagalin", "A", "a", 0.5)], "probe int, pos int, source string, court_name string, court_key string, weight double")
    assert votes.resolve(table, min_sum=2.0).first().needs_manual_review
    assert not votes.resolve(table, min_sum=1.2).first().needs_manual_review


@pytest.mark.parametrize("weights,score", [((0.95,), 0.9), ((0.45, 0.8), 1.2), ((0.45, 0.5, 0.5), 1.4), ((0.45,), 0.5), ((0.95, 0.8), 1.8), ((1.0, 0.8, 0.5), 2.0)])
def test_score_rounds_as_the_binary_value_does(spark, weights, score):
    table = spark.createDataFrame([(1, i, "s", "A", "a", w) for i, w in enumerate(weights)], "probe int, pos int, source string, court_name string, court_key string, weight double")
    assert votes.resolve(table).first().confidence_score == score


def test_selection_prefers_the_winner_and_keeps_the_point_when_strict(spark):
    rows = [(1, "D", "dagalin", "A", "1"), (1, "B", "dadata", "A", "01"), (1, "A", "district_table", "B", "2"), (2, "C", "courts_nearest", "C", "3"), (3, "C", "court_districts", "P", "4"), (3, "B", "dadata", "Q", "5"), (3, "D", "dagalin", "Q", "5")]
    table = spark.createDataFrame(rows, "row_id int, stage string, source string, court_name string, section_num string")
    got = {r.row_id: r for r in resolve.resolve_addresses(table).collect()}
    assert (got[1].stage, got[1].selected_court_id) == ("D", "1")
    assert got[2].needs_manual_review
    assert got[3].court_name == "Q"
    strict = {r.row_id: r for r in resolve.resolve_addresses(table, strict=True).collect()}
    assert (strict[3].court_name, strict[3].spatial_override, strict[3].needs_manual_review) == ("P", True, True)


def test_input_gate_drops_nothing(spark):
    rows = [(1, "a", "b", None, None), (2, " ", None, None, None), (3, "a", None, 91.0, 10.0), (4, "a", "", None, None), (5, None, None, 55.0, 37.0)]
    table = spark.createDataFrame(rows, "row_id int, fio string, address string, lat double, lng double")
    assert [r.error_code for r in resolve.input_gate(table).orderBy("row_id").collect()] == [None, "ERROR_EMPTY_ROW", "ERROR_INVALID_COORDS", "ERROR_NO_ADDRESS", None]


def test_rounding_is_that_of_the_exact_value(spark):
    import itertools

    values = {sum(c) for n in range(1, 5) for c in itertools.combinations([1.0, 0.95, 0.45, 0.8, 0.5, 0.3, 0.35, 0.05, 0.15, 0.25, 0.65, 0.75], n)} | {i / 20 for i in range(41)} | {i / 997 for i in range(1990)}
    rows = spark.createDataFrame([(v,) for v in values if v <= 2], "v double").select("v", votes.round_half_even_1(F.col("v")).alias("r")).collect()
    assert [r.r for r in rows] == [round(r.v, 1) for r in rows]


def test_geocoders_weigh_as_they_are_marked(spark):
    table = spark.createDataFrame([(1, "Yandex", 1, 55.0, 37.0, "city"), (1, "nominatim", 2, 55.0005, 37.0, "exact")], "row_id int, source string, pos int, lat double, lon double, confidence string")
    r = resolve.geocode_consensus(table).first()
    assert r.agree and abs(r.lat - (55.0 * 1.0 + 55.0005 * 0.7) / 1.7) < 1e-12


def test_cache_prefixes_and_null_keys(spark):
    cache = spark.createDataFrame([("a:1",), ("b:1",), (None,)], "key string")
    assert sorted(str(r.key) for r in tables.drop_prefix(cache, "a:").collect()) == ["None", "b:1"]
    old = spark.createDataFrame([(1, 5, "x"), (None, 6, "y")], "k int, bal int, seg string")
    new = spark.createDataFrame([(None, None, "z"), (1, None, None)], "k int, bal int, seg string")
    got = sorted(map(str, map(tuple, tables.upsert_partial(old, new, "k", ["bal"]).collect())))
    assert got == sorted(map(str, [(1, 5, None), (None, 6, "y"), (None, None, "z")]))
