"""Region, district, street and house of a text address, as ordered rules on a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import text

# Cities that stand for their region, in the order in which they are looked for.
CITY_REGIONS = {
    "нижний новгород": "Нижегородская область",
    "казань": "Республика Татарстан",
    "самара": "Самарская область",
    "екатеринбург": "Свердловская область",
    "новосибирск": "Новосибирская область",
    "красноярск": "Красноярский край",
    "челябинск": "Челябинская область",
    "ростов-на-дону": "Ростовская область",
    "уфа": "Республика Башкортостан",
    "пермь": "Пермский край",
    "волгоград": "Волгоградская область",
    "краснодар": "Краснодарский край",
    "воронеж": "Воронежская область",
    "саратов": "Саратовская область",
    "тольятти": "Самарская область",
    "тюмень": "Тюменская область",
    "ижевск": "Удмуртская Республика",
    "барнаул": "Алтайский край",
    "иркутск": "Иркутская область",
    "ульяновск": "Ульяновская область",
    "хабаровск": "Хабаровский край",
    "ярославль": "Ярославская область",
    "омск": "Омская область",
    "томск": "Томская область",
    "кемерово": "Кемеровская область",
    "рязань": "Рязанская область",
    "астрахань": "Астраханская область",
    "пенза": "Пензенская область",
    "липецк": "Липецкая область",
    "киров": "Кировская область",
    "чебоксары": "Чувашская Республика",
    "калининград": "Калининградская область",
    "тула": "Тульская область",
    "курск": "Курская область",
    "сочи": "Краснодарский край",
    "ставрополь": "Ставропольский край",
    "тверь": "Тверская область",
    "брянск": "Брянская область",
    "иваново": "Ивановская область",
    "белгород": "Белгородская область",
    "архангельск": "Архангельская область",
    "владимир": "Владимирская область",
    "калуга": "Калужская область",
    "смоленск": "Смоленская область",
    "мурманск": "Мурманская область",
    "владивосток": "Приморский край",
    "санкт-петербург": "Санкт-Петербург",
    "спб": "Санкт-Петербург",
}
# Republics whose full name is not "Республика" and their own.
REPUBLIC_NAMES = {"удмуртия": "Удмуртская Республика", "чувашия": "Чувашская Республика"}
# Autonomous districts by the name before "АО".
DISTRICT_NAMES = {"ханты-мансийский": "Ханты-Мансийский АО - Югра", "ямало-ненецкий": "Ямало-Ненецкий АО", "ненецкий": "Ненецкий АО", "чукотский": "Чукотский АО"}

# Regions by their first word, written as they are called.
REPUBLICS = ["Башкортостан", "Татарстан", "Мордовия", "Марий Эл", "Коми", "Карелия", "Дагестан", "Бурятия", "Алтай", "Тыва", "Хакасия", "Саха (Якутия)", "Крым"]
LANDS = ["Хабаровский", "Краснодарский", "Красноярский", "Приморский", "Ставропольский", "Алтайский", "Пермский", "Камчатский", "Забайкальский"]
AREAS = ["Московская", "Ленинградская", "Нижегородская", "Свердловская", "Самарская", "Ростовская", "Краснодарская", "Воронежская", "Волгоградская", "Оренбургская", "Челябинская", "Новосибирская"]

NAME = r"[А-Яа-яёЁ\-]+"


def _named(c: Column, names: dict[str, str], other: Column) -> Column:
    """The full name under a word in any case, else other."""
    if not names:
        return other
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_replace(c, r"\s+", " "))), other)


def region_of(c: Column) -> Column:
    """The region that an address names, in its full form; null if it names none."""
    has = lambda pattern: F.regexp_like(c, F.lit(f"(?iuU){pattern}"))
    part = lambda pattern: text.first_group(c, f"(?iuU){pattern}")
    republics = {n.lower(): f"Республика {n}" for n in REPUBLICS} | REPUBLIC_NAMES
    lands, areas = {n.lower(): f"{n} край" for n in LANDS}, {n.lower(): f"{n} область" for n in AREAS}
    full = lambda pattern, names, before, after: text.let(part(pattern), lambda x: _named(x, names, F.concat(F.lit(before), x, F.lit(after))))
    return F.coalesce(
        F.when(has(r"\bмосква\b(?!\s+обл)"), "Москва"),
        F.when(has(r"\b(?:санкт-петербург|спб|петербург)\b(?!\s+обл)"), "Санкт-Петербург"),
        full(rf"\b({NAME}(?:\s*эл|\s*\(якутия\))?)\s+респ(?:ублика)?\b", republics, "Республика ", ""),
        full(rf"\bреспублика\s+({NAME})", {}, "Республика ", ""),
        full(rf"\b({NAME})\s+край\b", lands, "", " край"),
        full(rf"\b({NAME})(?:\s*\(?\s*югра\s*\)?)?\s+ао\b", DISTRICT_NAMES, "", " АО"),
        full(rf"\b({NAME})\s+обл(?:асть|\.|\b)", areas, "", " область"),
    )


def region_of_city(c: Column, mode: str = "fixed") -> Column:
    """The region of the first known city in an address.

    In mode 'compat' a city's name also counts inside another word, so Томск is found as
    Омск; 'fixed' wants it to begin there.
    """
    cities = F.array(*[F.struct(F.lit(city).alias("city"), F.lit(region).alias("region")) for city, region in CITY_REGIONS.items()])
    found = lambda low, x: F.contains(low, x["city"]) if mode == "compat" else F.regexp_like(low, F.concat(F.lit("(?<![а-яё])"), x["city"]))
    return text.let(F.lower(c), lambda low: F.get(F.filter(cities, lambda x: found(low, x)), F.lit(0))["region"])


def district_of(c: Column) -> Column:
    """The district or else the town, settlement or village that an address names, else its second or third part."""
    part = lambda pattern: text.first_group(c, f"(?iuU){pattern}")
    pieces = F.transform(F.slice(F.split(c, "[,;]"), 2, 2), lambda p: F.trim(F.regexp_replace(p, r"^\s*\d{6}\s*", "")))
    plain = F.filter(pieces, lambda p: F.regexp_like(p, F.lit(r"^[А-Яа-яЁё\-\s]{3,}$")) & ~F.regexp_like(p, F.lit(r"(?iu)(^|\s)(обл|край|респ|ао|область|р-н)$")))
    city = F.regexp_replace(part(r"(?:^|[,;\s])(?:город|гор\.?|г\.?)\s+([^,;]{3,})"), r"\s+", " ")
    return F.coalesce(
        part(rf"(?:^|[,;\s])({NAME}(?:ов|ев|ий|ой|ый))\s+(?:судебный\s+)?район"),
        part(rf"({NAME}(?:ов|ев|ий|ой|ый))\s+р-н\b"),
        F.when(~F.lower(city).isin("обл", "край", "респ"), city),
        part(rf"(?:^|[,;\s])(?:посёлок|пос\.?|рп\.?|п\.?)\s+({NAME})"),
        part(rf"(?:^|[,;\s])(?:село|с\.?)\s+({NAME})"),
        F.get(plain, F.lit(0)),
    )


def parse(c: Column, mode: str = "fixed") -> Column:
    """struct(raw, normalized, region, district, street, house)."""
    region = F.coalesce(region_of(c), region_of_city(c, mode))
    both = lambda normal: F.struct(normal.alias("normalized"), text.street_of(normal).alias("street"), text.house_of(normal, mode)["num"].cast("string").alias("house"))
    return text.let(
        text.let(text.normalize_address(c, mode), both),
        lambda n: F.struct(c.alias("raw"), n["normalized"].alias("normalized"), region.alias("region"), district_of(c).alias("district"), n["street"].alias("street"), n["house"].alias("house")),
    )


def plausible_street(c: Column) -> Column:
    """Whether a token may be a street's name: letters only, three or more."""
    return F.coalesce(F.regexp_like(F.trim(c), F.lit(r"(?U)^[\p{L}][\p{L}\s.\-]{2,}$")), F.lit(False))


def canonical_court(df_columns: list[str]) -> dict[str, Column]:
    """Court rows under one set of names, of whichever of their aliases they have."""
    have = lambda *names: [F.col(n).cast("string") for n in names if n in df_columns]
    pick = lambda *names: text.first_filled(*have(*names)) if have(*names) else F.lit(None).cast("string")
    return {
        "court_name": F.coalesce(pick("court_name", "name"), F.lit("")),
        "address": F.coalesce(pick("address", "court_address"), F.lit("")),
        "region": F.coalesce(pick("region", "court_region"), F.lit("")),
        "section_num": F.coalesce(pick("section_num", "section", "district_number").try_cast("int"), F.lit(0)),
        "phone": F.coalesce(pick("phone", "phones"), F.lit("")),
        "email": F.coalesce(pick("email"), F.lit("")),
    }


# How the name of a court tells its region, and the words and names that go with it.
OF_REPUBLIC = r"(?iu)Республики\s+([^»]+?)(?:\s*-?\s*Алания)?(?:\s*$|,)"
OF_STEM = r"(?iuU)(\w+)(?:ский|кой)\s+"
STEM_KINDS = [("областной", "область"), ("краевой", "край")]
REPUBLIC_WORD, BY_BRACKETS = "Республика ", " (Якутия)"
COURT_REPUBLICS = {("Алания", "Осетия"): "Республика Северная Осетия", ("Якутия",): "Республика Саха (Якутия)"}
COURT_CITIES = {"Москва": "Москва", "Петербург": "Санкт-Петербург"}
# How addresses in lists of courts write their region.
LIST_AREA = rf"({NAME}\s+обл\.?)"
LIST_CITIES = [(("г Москва", ", Москва,"), "Москва"), (("Санкт-Петербург", "СПб"), "Санкт-Петербург")]
LIST_OTHERS = [rf"({NAME}\s+край)", rf"(Республика {NAME})", rf"({NAME}\s+АО)"]


def region_of_court(name: Column, regions: list[str]) -> Column:
    """The region that a court's name stands for, among regions written in full; null if it names none.

    A region named outright, then "... Республики X", "X-ский областной", "X-ский краевой",
    and the cities that are regions.
    """
    first = lambda test: F.coalesce(*[F.when(test(r), r) for r in regions])
    low = F.lower(name)
    outright = first(lambda r: F.contains(low, F.lit(r.lower())))
    of_republic = text.first_group(name, OF_REPUBLIC)
    short = F.replace(of_republic, F.lit(BY_BRACKETS), F.lit(""))
    alike = first(lambda r: F.contains(F.lit(r), of_republic) | F.contains(of_republic, F.lit(r)) | F.contains(F.lit(r), short))
    (north, yakutia), (alania, ossetia) = COURT_REPUBLICS.items(), next(iter(COURT_REPUBLICS))
    known = [
        F.when(F.contains(name, F.lit(alania)) | F.contains(of_republic, F.lit(ossetia)), north[1]),
        F.when(F.contains(of_republic, F.lit(yakutia[0][0])), yakutia[1]),
    ]
    republic = F.when(of_republic.isNotNull(), F.coalesce(alike, *known, F.concat(F.lit(REPUBLIC_WORD), of_republic)))
    stems = {kind: text.first_group(name, OF_STEM + kind) for kind, _ in STEM_KINDS}
    by_stem = [first(lambda r: F.startswith(F.lit(r), stems[kind]) & F.lit(word in r)) for kind, word in STEM_KINDS]  # noqa: B023
    moscow, petersburg = COURT_CITIES
    cities = [
        F.when(F.contains(name, F.lit(moscow)) & ~F.contains(low, F.lit(STEM_KINDS[0][1])), COURT_CITIES[moscow]),
        F.when(F.contains(name, F.lit(petersburg)), COURT_CITIES[petersburg]),
    ]
    return F.coalesce(outright, republic, *by_stem, *cities)


def region_of_list(c: Column) -> Column:
    """The region of an address in a list of courts, by the first of some ways to write it; empty if none."""
    has_any = lambda words: reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])
    area = F.replace(F.regexp_replace(text.first_group(c, LIST_AREA), r"\.$", ""), F.lit(" обл"), F.lit(" область"))
    cities = [F.when(has_any(words), region) for words, region in LIST_CITIES]
    return F.coalesce(area, *cities, *[text.first_group(c, p) for p in LIST_OTHERS], F.lit(""))
