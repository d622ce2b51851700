"""Rules, points and text: literal fixtures in Cyrillic, and points near the poles."""

import math
import random

from pyspark.sql import functions as F

from wardline.functions import address, documents, geo, ranges, text
from wardline.operators import joins, quality, rings, tables

RULES = "rule_order int, section_num string, region string, area_text string, street_pattern string, house_from int, house_to int, house_parity string, house_suffix string, house_step int"
ONE = (1, "1", "Нижегородская область", "Нижний Новгород", r"ул\.\s*Ватутина", 1, 20, None, None, None)


def match(spark, address, *rules, mode="fixed", lemmas=()):
    addresses = spark.createDataFrame([(1, address, list(lemmas))], "row_id int, address string, lemmas array<string>")
    r = joins.rule_match(addresses, spark.createDataFrame(list(rules), RULES), mode).first()
    return r.section_num, r.source


def test_rule_by_street_and_house(spark):
    assert match(spark, "603950, г. Нижний Новгород, ул. Ватутина, д. 10А", ONE) == ("1", "law_rules")
    # the older way takes the postcode's first digits for the house, so only the area is left
    assert match(spark, "603950, г. Нижний Новгород, ул. Ватутина, д. 10А", ONE, mode="compat") == ("1", "law_rules_area")
    assert match(spark, "г. Нижний Новгород, ул. Ватутина, д. 25", ONE[:3] + (None,) + ONE[4:]) == (None, None)


def test_rule_parity_step_suffix_region_and_order(spark):
    odd = (2, "2", "", None, r"(?i)ильича", 1, 99, "odd", None, 2)
    even = (3, "3", "", None, r"(?i)ильича", 2, 98, "even", None, 2)
    assert match(spark, "пр. ИЛЬИЧА, д. 7", even, odd) == ("2", "law_rules")
    assert match(spark, "пр. Ильича, д. 8", even, odd) == ("3", "law_rules")
    assert match(spark, "пр. Ильича", even, odd) == ("2", "law_rules")
    suffix = (1, "9", "", None, "ильича", None, None, None, "А", None)
    assert match(spark, "пр. Ильича, д. 8", suffix, even) == ("3", "law_rules")
    assert match(spark, "пр. Ильича, д. 8а", suffix, even) == ("9", "law_rules")
    other = (0, "5", "Самарская область", None, "ильича", None, None, None, None, None)
    assert match(spark, "пр. Ильича, д. 8", other, even) == ("3", "law_rules")
    lemma = (0, "6", "", None, "октябрьск", None, None, None, None, None)
    assert match(spark, "ул. Октябрской, 5", lemma, lemmas=["улица", "октябрьский"]) == ("6", "law_rules_nlp_fuzzy")


def brute_match(spark, addresses, rules):
    """The first rule by comparing every address with every rule, without keys."""
    probes = addresses.crossJoin(rules)
    n, suffix = text.house_of(F.lower("address"))["num"], text.house_of(F.lower("address"))["suffix"]
    fits = (
        (n.isNull() | F.col("house_from").isNull() | (n >= F.col("house_from"))) & (n.isNull() | F.col("house_to").isNull() | (n <= F.col("house_to")))
        & (n.isNull() | F.col("house_parity").isNull() | ((n % 2 == 0) == (F.col("house_parity") == "even")))
    )
    by_pattern = F.coalesce(F.regexp_like("address", F.concat(F.lit("(?iu)"), F.regexp_replace("street_pattern", r"^\(\?i\)", ""))), F.lit(False))
    by_area = F.coalesce(F.contains(F.lower("address"), F.lower("area_text")), F.lit(False))
    rank = F.when(by_pattern & F.coalesce(fits, F.lit(True)), 0).when(by_area, 1)
    hits = probes.filter(text.region_fits(F.col("region"), F.col("address"))).withColumn("rank", rank).filter("rank IS NOT NULL")
    return {r.row_id: r.hit for r in hits.groupBy("row_id").agg(F.min_by("section_num", F.struct("rank", "rule_order")).alias("hit")).collect()}


def test_rules_by_keys_find_what_all_pairs_find(spark):
    draw = random.Random(11)
    streets = ["Ватутина", "Гагарина", "Большая Покровская", "Мира", "Ильича", "Октябрьская", "пр. Ленина", "ул Яр"]
    patterns = [r"ул\.\s*ватутина", r"(?:гагарина|мира)", r"(?i)покровск", r"\bмира\b", r"октябрьск(ой|ая)?", r"яр", r"л[ео]нина", r"ильича.*д", r"ё?ватутин", None, r"(мира|яр)\s*,"]
    regions = [None, "", "Нижегородская область", "Самарская область", "область"]
    rules = [(i, str(i), draw.choice(regions), draw.choice([None, None, "Нижний Новгород", "Яр", "ул"]), draw.choice(patterns), draw.choice([None, 1, 5]), draw.choice([None, 9, 20]), draw.choice([None, "even", "odd"]), None, None) for i in range(120)]
    heads = ["г. Нижний Новгород, ", "Самарская обл., ", "", "603950, НИЖЕГОРОДСКАЯ область, "]
    rows = [(i, draw.choice(heads) + draw.choice(["ул. ", "улица ", ""]) + draw.choice(streets) + f", д. {draw.randint(1, 25)}", []) for i in range(150)]
    addresses = spark.createDataFrame(rows, "row_id int, address string, lemmas array<string>")
    table = spark.createDataFrame(rules, RULES)
    got = {r.row_id: r.section_num for r in joins.rule_match(addresses, table).filter("section_num IS NOT NULL").collect()}
    assert got == brute_match(spark, addresses, table) and len(got) > 100


def test_no_nested_loops_in_plans(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    addresses = spark.createDataFrame([(1, "ул. Ватутина, д. 5", [])], "row_id int, address string, lemmas array<string>")
    rules = spark.createDataFrame([ONE, (2, "2", None, None, "гагарина", 1, 9, None, None, None)], RULES)
    needles = spark.createDataFrame([(0, "ват", "R")], "pos int, needle string, region string")
    probes = spark.createDataFrame([(1, "ул. Мира, 5", None, "Мира", None, "5")], "row_id int, address string, region_code string, street string, district string, house string")
    entries = spark.createDataFrame([(1, None, "С", "мира")], "entry_id int, region_code string, court_name string, jurisdiction_text string")
    names = spark.createDataFrame([(1, "Суд")], "row_id int, name string")
    catalogue = spark.createDataFrame([("Суд", 1)], "court_name string, section_num int")
    for df in (joins.rule_match(addresses, rules), joins.needle_lookup(addresses, "address", needles), joins.text_top1(probes, entries), joins.known_names(names, catalogue)):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_text_score_and_tokens(spark):
    blob = "судебный участок №5 проспект ильича, дома четные; дом 8"
    lit = lambda x: F.lit(x).cast("string")
    score = lambda house, b=blob: one(spark, text.text_score(F.lit(b), F.array().cast("array<string>"), lit(None), lit(None), F.lit(house)))
    assert score("8") == 40 + 55 and score("7") == -52 and score("8", "ильича дома нечетные") == -52 and score("7", "ильича дома нечетные") == 55 and score("7", "мира") == 0
    tokens = one(spark, text.address_tokens(F.lit("Гагарина"), F.lit("г. Пермь, пр-кт Гагарина, д. 5"), lit(None), F.lit("Гагарина")))
    assert tokens == ["проспект", "гагарин", "пермь", "гагарина"]


def test_texts_meet_inside_words(spark):
    probes = spark.createDataFrame([(1, "ул. Гагарина, д. 5", None, "Гагарина", None, "5"), (2, "ул. Гагарина, д. 5", None, "Гагарина", None, "5")], "row_id int, address string, region_code string, street string, district string, house string")
    entries = spark.createDataFrame([(1, None, "Участок 1", "по гагаринской улице"), (2, None, "Участок 2", "мира")], "entry_id int, region_code string, court_name string, jurisdiction_text string")
    assert [(r.row_id, r.entry_id, r.score) for r in joins.text_top1(probes, entries).orderBy("row_id").collect()] == [(1, 1, 21), (2, 1, 21)]


def test_names_link_to_the_likest(spark):
    entries = spark.createDataFrame([(1, "Судебный участок № 5 Приокского района"), (2, "Судебный участок № 5 Советского района города"), (3, "Участок №7 А")], "entry_id int, court_name string")
    names = spark.createDataFrame([(1, " судебный участок № 5 приокского РАЙОНА", None), (2, "участок № 5 советского района", 5), (3, "что-то", 7), (4, "что-то", 8), (5, None, 7)], "row_id int, name string, section_num int")
    assert {r.row_id: r.entry_id for r in joins.name_link(names, entries).collect()} == {1: 1, 2: 2, 3: 3, 5: 3}


def test_names_are_known_if_the_catalogue_is_empty(spark):
    names = spark.createDataFrame([(1, "Суд"), (2, " ")], "row_id int, name string")
    empty = spark.createDataFrame([], "court_name string, section_num int")
    assert {r.row_id: r.known for r in joins.known_names(names, empty).collect()} == {1: True, 2: False}


def test_nearest_across_the_180th_meridian(spark):
    points = spark.createDataFrame([(1, 66.0, 179.99), (2, 66.0, -179.99), (3, 89.99, 10.0)], "point_id int, lat double, lon double")
    places = spark.createDataFrame([(1, 66.0, -179.99), (2, 66.0, 179.97), (3, 89.99, -170.0)], "place_id int, plat double, plon double")
    got = joins.nearest(points, places, top=None).collect()
    assert sorted((r.point_id, r.place_id) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def shared_area(a, b):
    return rings.shared_area(*(rings.edges_of([{"x": x, "y": y} for x, y in ring]) for ring in (a, b)))


def test_shared_area_of_concave_rings(spark):
    notch = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    assert shared_area(notch, [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (0.0, 1.0)]) == 4.0
    assert shared_area(notch, notch) == 10.0
    assert shared_area([(1.9, 2.0), (2.1, 2.0), (2.1, 3.0), (1.9, 3.0)], notch) == 0.0
    draw = random.Random(5)
    for _ in range(50):  # against convex clipping
        box = [(x + draw.uniform(0, 0.5), y + draw.uniform(0, 0.5)) for x, y in ((0, 0), (3, 0), (3, 3), (0, 3))]
        moved = [(x + draw.uniform(-2, 2), y + draw.uniform(-2, 2)) for x, y in notch[:3]]
        assert math.isclose(shared_area(notch, box), clip_area(notch, box), abs_tol=1e-9)
        assert math.isclose(shared_area(moved, notch), clip_area(notch, moved), abs_tol=1e-9)


def test_nearest_finds_what_brute_force_finds(spark):
    draw = random.Random(8)
    for centre in (0.0, 59.9, -60.0, 84.0):
        points = [(i, centre + draw.uniform(-0.2, 0.2), 30 + draw.uniform(-0.8, 0.8)) for i in range(80)]
        places = [(i, centre + draw.uniform(-0.2, 0.2), 30 + draw.uniform(-0.8, 0.8)) for i in range(80)]

        def km(a, b):
            p, q = math.radians(a[1]), math.radians(b[1])
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
            return 2 * 6371 * math.asin(math.sqrt(h))

        want = {(a[0], b[0]) for a in points for b in places if km(a, b) <= 5}
        got = joins.nearest(spark.createDataFrame(points, "point_id int, lat double, lon double"), spark.createDataFrame(places, "place_id int, plat double, plon double"), top=None)
        assert sorted((r.point_id, r.place_id) for r in got.collect()) == sorted(want)


def test_rings(spark):
    shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in shape],)], "ring array<struct<x:double,y:double>>")
    r = df.select(
        geo.in_ring(F.col("ring"), F.lit(2.0), F.lit(0.5)).alias("a"),
        geo.in_ring(F.col("ring"), F.lit(2.0), F.lit(2.0)).alias("b"),
        geo.ring_area(F.col("ring")).alias("area"),
        geo.border_metres(F.col("ring"), F.lit(3.99), F.lit(1.0)).alias("m"),
    ).first()
    assert r.a and not r.b and r.area == 10.0 and abs(r.m - 1113.2) < 0.1
    assert clip_area(shape, [(0.0, 0.0), (0.0, 1.0), (4.0, 1.0), (4.0, 0.0)]) == 4.0


def clip_area(ring, convex):
    """Area of a ring inside a convex ring, half plane by half plane."""
    turn = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1])) / 2
    convex = convex[::-1] if turn(convex) < 0 else convex
    for (x1, y1), (x2, y2) in zip(convex, convex[1:] + convex[:1]):
        side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x, y in ring]
        out = []
        for i, (p, s) in enumerate(zip(ring, side)):
            q, t = ring[i - 1], side[i - 1]
            if (s >= 0) != (t >= 0):
                k = t / (t - s)
                out.append((q[0] + k * (p[0] - q[0]), q[1] + k * (p[1] - q[1])))
            if s >= 0:
                out.append(p)
        ring = out
        if len(ring) < 3:
            return 0.0
    return abs(turn(ring))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.ru_lower(lit("Ёлка"))) == "елка"
    assert one(spark, text.normalize_address(lit("681035, , Край ,гор. Пермь, ул Дагестанская, д.5"))) == "681035, Край, г. Пермь, улица Дагестанская, д. 5"
    assert "д. агестанская" in one(spark, text.normalize_address(lit("ул Дагестанская"), mode="compat"))
    assert one(spark, text.court_key(lit("Судебный участок № 5  г. Нижний"))) == one(spark, text.court_key(lit("Мировой судебный участок №5 г. Нижний"))) == "5 г. нижний"
    assert one(spark, text.section_number(lit("12-й участок"))) is None and one(spark, text.section_number(lit("12 участок"))) == 12
    assert one(spark, text.same_court(lit("участок №7 А"), lit("№ 7 Б")))
    assert one(spark, text.house_of(lit("603950, ул. Мира, д. 10а"))).asDict() == {"num": 10, "suffix": "а"}
    assert one(spark, text.house_of(lit("603950, ул. Мира"), mode="compat")).num == 6039
    assert one(spark, text.number(lit("1 234,5"))) == 1234.5 and one(spark, text.number(lit("x"))) is None
    assert one(spark, text.repaired_json(lit("so: {a: 'b', }"))) == '{"a": "b"}'
    assert one(spark, text.redact(lit("token=abc x Bearer q1"))) == "token=*** x Bearer ***"
    assert str(one(spark, text.date_of(lit("05.03.2024 10:00")))) == "2024-03-05"
    doc = one(spark, documents.extracted(lit("Судебный участок № 7, дело № 2-15/2024, взыскать с Иванов Иван, 1 500 руб.")))
    assert (doc.section, doc.case_number, doc.debtor, doc.amount, doc.confidence) == (7, "2-15/2024", "Иванов Иван", 1500.0, 0.85)
    assert one(spark, text.light_normalize(lit("  ул. Мира., 5 "))) == "ул. Мира, 5" and one(spark, text.first_section(lit("x"), lit("участок 7"))) == 7
    assert one(spark, text.clean_lines(lit("ab\n§§ Дело № 5 §\n"))) == "Дело № 5"
    assert one(spark, text.url_parts(lit("https://h/courts/52/wc/one?x"))).asDict() == {"code": "52", "slug": "one"}
    assert one(spark, text.region_fits(lit("Нижегородская область"), lit("г. Нижний Новгород")))
    assert not one(spark, text.region_fits(lit("Самарская область"), lit("г. Нижний Новгород")))


def test_house_ranges(spark):
    def got(cell):
        return [tuple(r) for r in one(spark, ranges.house_ranges(F.lit(cell)))]

    assert got("1-15 нечетные") == [(1, 15, "odd", 2)]
    assert got("2, 4, 6, 8") == [(2, 8, "even", 2)]
    assert got("3, 10") == [(3, 3, None, None), (10, 10, None, None)]
    assert got("5") == [(5, 5, None, None)] and got("") == []
    assert [r.street for r in one(spark, ranges.statute_rules(F.lit("Улицы: Мира, дома 1-9 нечет; ул. Ленина 2-8. ")))] == ["Мира", "Ленина"]


def test_addresses(spark):
    def parsed(value, mode="fixed"):
        return one(spark, address.parse(F.lit(value), mode))

    assert parsed("634000, г. Томск, ул Ленина, д 5").region == "Томская область"
    assert parsed("634000, г. Томск", "compat").region == "Омская область"
    for value, region in (("г. Москва", "Москва"), ("Московская обл., г. Химки", "Московская область"), ("Удмуртия Респ, Ижевск", "Удмуртская Республика"), ("Республика Крым", "Республика Крым"), ("Чукотский АО", "Чукотский АО"), ("Алтайский край", "Алтайский край"), ("nowhere", None)):
        assert parsed(value).region == region, value
    p = parsed("603950, Нижегородская обл, г. Нижний Новгород, ул. Ватутина, д. 10А")
    assert (p.region, p.district, p.street, p.house) == ("Нижегородская область", "Нижний Новгород", "Ватутина", "10")
    assert one(spark, address.plausible_street(F.lit("Мира"))) and not one(spark, address.plausible_street(F.lit("д. 5")))


def test_ring_faults_and_verification(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    bow = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]
    shift = [(x + 1, y + 1) for x, y in square]
    rings = [(1, square), (2, shift), (3, bow), (4, None), (5, square[:2]), (6, [(x + 9, y) for x, y in square])]
    areas = spark.createDataFrame([(i, r and [{"x": x, "y": y} for x, y in r]) for i, r in rings], "area_id int, ring array<struct<x:double,y:double>>")
    got = {r.area_id: (r.fault, r.overlaps, r.status) for r in quality.verification(areas).collect()}
    assert got == {1: (None, 1, "warning"), 2: (None, 1, "warning"), 3: ("crosses itself", 0, "error"), 4: ("missing", 0, "error"), 5: ("too few corners", 0, "error"), 6: (None, 0, "ok")}


def counted(spark, monkeypatch, module, name, value):
    """How often a column function of a module is worked out, in place of which value stands."""
    times = spark.sparkContext.accumulator(0)

    @F.udf(type(value).__name__.replace("float", "double").replace("bool", "boolean"))
    def one(*_):
        times.add(1)
        return value

    monkeypatch.setattr(module, name, lambda *columns: one.asNondeterministic()(*columns))
    return times


def test_radius_list_of_points_at_one_position(spark, monkeypatch):
    points = spark.range(200).select(F.col("id").alias("point_id"), F.lit(55.0).alias("lat"), F.lit(37.0).alias("lon"), F.when(F.col("id") < 2, "R").alias("region"))
    places = spark.range(3).select(F.col("id").alias("place_id"), F.lit(55.0).alias("plat"), (37 + F.col("id") / 100).alias("plon"), F.lit("Мировой суд").alias("name"), F.when(F.col("id") == 2, "край r").alias("place_region"))
    got = joins.radius_list(points, places).collect()
    assert sorted((r.point_id, r.nth, r.place_id) for r in got) == [(0, 1, 2), (1, 1, 2)] + [(i, n + 1, n) for i in range(2, 200) for n in range(3)]
    times = counted(spark, monkeypatch, geo, "haversine_km", 1.0)
    assert joins.radius_list(points, places).count() == 2 + 198 * 3 and times.value <= 20  # 600 pairs of points and places


def test_nearest_of_places_at_one_position(spark, monkeypatch):
    points = spark.range(100).select(F.col("id").alias("point_id"), F.lit(55.0).alias("lat"), F.lit(37.0).alias("lon"))
    places = spark.range(100).select((F.col("id") + 7).alias("place_id"), F.lit(55.01).alias("plat"), F.lit(37.0).alias("plon"))
    assert {(r.place_id, r.nth) for r in joins.nearest(points, places).collect()} == {(7, 1)}
    assert sorted({(r.place_id, r.nth) for r in joins.nearest(points, places, top=2).collect()}) == [(7, 1), (8, 2)]
    times = counted(spark, monkeypatch, geo, "haversine_km", 1.0)
    assert joins.nearest(points, places).count() == 100 and times.value <= 3  # 10,000 pairs


def test_addresses_are_parsed_once_by_many_tasks(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") > 0, F.concat(F.lit("Самарская область, Приокский район, д. "), (F.col("id") % 100).cast("string"))).alias("address")).coalesce(1)
    got = joins.parsed_parts(rows, "region", "district").collect()
    assert {(r.id > 0, r.region, r.district) for r in got} == {(True, "Самарская область", "Приокский"), (False, None, None)} and len(got) == 300
    plan = joins.parsed_parts(rows, "region")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [address" in plan and "Repartition" in plan


def test_a_filter_on_a_parsed_part_is_not_worked_out_for_each_row(spark):
    rows = spark.range(300).select("id", F.concat(F.lit("Самарская область, Приокский район, д. "), (F.col("id") % 3).cast("string")).alias("address"))
    plan = joins.parsed_parts(rows, "region", "district").filter(text.not_blank(F.col("region")))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Aggregate [address", 1)
    assert "(?iuU)" in above and "(?iuU)" not in below


def test_two_way_difference_takes_nulls_as_equal_and_joins_nothing(spark):
    numbers = lambda *n: spark.createDataFrame([(x,) for x in n], "k int")
    got = tables.two_way_difference(numbers(1, 2, 2, None), numbers(2, 3, 3, None), "k")
    assert sorted(map(tuple, got.collect())) == [(1, "missing"), (3, "extra")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
