"""Text functions on columns: normalising addresses and names, tokens, and parsing.

Patterns fold case with (?iu) and take \\w in the Unicode sense with (?U), which Java
needs for Cyrillic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of address parts, in the order in which they are replaced.
ABBREVIATIONS = [
    ("гор\\.\\s*", "г. "),
    ("гор\\s+", "г. "),
    ("г\\s+", "г. "),
    ("ул\\.?\\s*", "улица "),
    ("пр-кт\\.?\\s*", "проспект "),
    ("пр\\.\\s+", "проспект "),
    ("пер\\.?\\s*", "переулок "),
    ("д\\.?\\s*", "д. "),
    ("кв\\.?\\s*", "кв. "),
    ("корп\\.?\\s*", "корп. "),
    ("стр\\.?\\s*", "стр. "),
    ("обл\\.?\\s*", "область "),
    ("респ\\b", "Республика "),
]
# The same in the service's normaliser, whose rules for avenues and republics are older.
SERVICE_ABBREVIATIONS = [
    ("гор\\.\\s*", "г. "),
    ("гор\\s+", "г. "),
    ("г\\s+", "г. "),
    ("ул\\.?\\s*", "улица "),
    ("пр\\.?\\s*", "проспект "),
    ("пер\\.?\\s*", "переулок "),
    ("д\\.?\\s*", "д. "),
    ("кв\\.?\\s*", "кв. "),
    ("корп\\.?\\s*", "корп. "),
    ("стр\\.?\\s*", "стр. "),
    ("обл\\.?\\s*", "область "),
    ("Респ\\.?\\s*", "Республика "),
    ("респ\\.?\\s*", "республика "),
]
# What the service says of addresses that it refuses.
NO_ADDRESS, SHORT_ADDRESS, SHORTEST_ADDRESS = "Адрес не указан", "Адрес слишком короткий", 5
# Words that carry no weight in a search.
STOP_WORDS = ["г", "дом", "д", "обл", "край", "респ", "город", "проспект", "улица", "переулок"]
# Generic words in the names of regions.
REGION_WORDS = ["область", "республика", "автономная", "округ", "федерации", "край", "края", "округа"]


def let(c: Column, f) -> Column:
    """f of a column that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def not_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def first_filled(*columns: Column) -> Column:
    """The first of the columns that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def ru_lower(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")


def number(c: Column) -> Column:
    """A decimal comma or point, blanks inside allowed; null if it is none."""
    return F.regexp_replace(F.translate(c, ",", "."), r"[\s ]", "").try_cast("double")


def whole_number(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def money(c: Column) -> Column:
    """Digits, blanks and a decimal comma to a number, 0 if there is none."""
    kept = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), ",", "."), r"[^0-9.]", "")
    return F.coalesce(kept.try_cast("double"), F.lit(0.0))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")


def tax_number(c: Column) -> Column:
    """The digits of a taxpayer's number if they are 10 or 12, else null."""
    d = digits(c)
    return F.when(F.length(d).isin(10, 12), d)


def case_id(c: Column) -> Column:
    """The digits of an enforcement number if they are 7 to 15, else null."""
    d = digits(c)
    return F.when(F.length(d).between(7, 15), d)


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the pattern's first match, null if there is none or it is blank."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def first_int(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def tidy_commas(c: Column) -> Column:
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s*,(\s*,)*\s*", ", ")
    s = F.regexp_replace(s, r"\s{2,}", " ")
    return F.regexp_replace(s, r"^[\s,]+|[\s,]+$", "")


def normalize_address(c: Column, mode: str = "fixed") -> Column:
    """Commas and blanks tidied and abbreviations written out.

    In mode 'compat' an abbreviation is also replaced at the start of a longer word, as
    the older rules did; 'fixed' wants the word to end there.
    """
    s = tidy_commas(c)
    for pattern, text in ABBREVIATIONS:
        end = "" if mode == "compat" else r"(?![\p{L}])" if pattern.endswith("\\s*") else ""
        body = pattern if not end else pattern.replace("\\s*", "") + end + "\\s*"
        s = F.regexp_replace(s, rf"(?iuU)\b{body}", text)
    return F.trim(F.regexp_replace(s, r"(?U)\b([\p{IsCyrillic}])\s*\.\s*", "$1. "))


def service_normalize(c: Column, mode: str = "fixed") -> Column:
    """struct(address, error): an address as the service writes it, or why it is refused.

    In mode 'compat' an abbreviation is also replaced at the start of a longer word; 'fixed'
    wants the word to end there.
    """
    s = F.trim(c)
    error = F.when(F.coalesce(c, F.lit("")) == "", NO_ADDRESS).when(F.length(s) < SHORTEST_ADDRESS, SHORT_ADDRESS)
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r",\s*,+", ","), r"\s*,\s*", ", "), r"\s{2,}", " ")
    s = F.trim(F.regexp_replace(F.trim(s), "^,+|,+$", ""))
    for pattern, word in SERVICE_ABBREVIATIONS:
        body = pattern if mode == "compat" or not pattern.endswith("\\s*") else pattern.removesuffix("\\s*") + r"(?![\p{L}])\s*"
        s = F.regexp_replace(s, rf"(?iuU)\b{body}", word)
    return F.struct(F.when(error.isNull(), F.trim(s)).alias("address"), error.alias("error"))


def sorted_matches(c: Column, pattern: str, group: int = 1) -> Column:
    """The distinct matches of a pattern in the order of text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group))))


def light_normalize(c: Column) -> Column:
    return F.trim(F.replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit(".,"), F.lit(",")), F.lit("  "), F.lit(" ")))


def court_key(c: Column) -> Column:
    """The name by which sources are compared: lower case, generic words at the start and more than one blank dropped."""
    # The generic words.
    start = r"(?iu)^\s*(судебный\s+участок|мировой\s+судебный\s+участок|мировой\s+судья|участок\s+мирового\s+судьи)\s*[№n]?\s*"
    return F.trim(F.regexp_replace(F.regexp_replace(ru_lower(c), start, ""), r"\s+", " "))


def section_number(c: Column) -> Column:
    # How a section's number is written.
    return F.coalesce(
        F.regexp_extract(c, r"(?iu)№\s*(\d+)", 1).try_cast("int"),
        F.regexp_extract(c, r"(?iu)(\d+)\s*[-–]?\s*участ", 1).try_cast("int"),
    )


def same_court(a: Column, b: Column) -> Column:
    by_key = (court_key(a) == court_key(b)) & (court_key(a) != "")
    by_number = section_number(a) == section_number(b)
    return F.coalesce(not_blank(a) & not_blank(b) & (by_key | F.coalesce(by_number, F.lit(False))), F.lit(False))


def section_text(c: Column) -> Column:
    """A section's number as text without leading zeros, other text trimmed."""
    s = c.cast("string")
    return F.coalesce(F.trim(s).try_cast("int").cast("string"), blank_to_null(s))


def first_section(*columns: Column) -> Column:
    return F.coalesce(*[first_int(c.cast("string")) for c in columns])


# How a street is written.
STREET = r"(?iuU)\b(?:улица|ул\.?|проспект|пр-кт\.?|переулок|пер\.?|шоссе|бульвар|набережная|площадь)\s+([^,;\d]+?)\s*(?:,|;|\d|$)"


def street_of(c: Column) -> Column:
    return first_group(c, STREET)


def house_of(c: Column, mode: str = "fixed") -> Column:
    """Number and suffix of the house: struct(num, suffix).

    'compat' takes the first number of up to four digits, so the start of a postcode;
    'fixed' prefers a number after д. or дом, then one that is not part of a longer number.
    """
    any_ = r"(?iuU)\b(\d{1,4})([а-яa-z\-]*)"
    marked = r"(?iuU)\b(?:д|дом)\.?\s*(\d{1,4})(?!\d)([а-яa-z\-]*)"
    alone = r"(?iuU)(?<!\d)(\d{1,4})(?!\d)([а-яa-z\-]*)"
    patterns = [any_] if mode == "compat" else [marked, alone]

    # the first pattern that is met, and its match taken apart
    found = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x, p, 0), F.lit("")) for p in patterns])
    number = r"(?iuU)(\d{1,4})([а-яa-z\-]*)$"
    return let(let(c, found), lambda m: F.struct(F.regexp_extract(m, number, 1).try_cast("int").alias("num"), F.nullif(F.lower(F.trim(F.regexp_extract(m, number, 2))), F.lit("")).alias("suffix")))


def search_tokens(*parts: Column, most: int = 16) -> Column:
    """Distinct words of three letters or more without stop words, in order of first sight."""
    words = F.split(ru_lower(F.concat_ws(" ", *parts)), r"(?U)[^\w]+")
    kept = F.filter(F.array_distinct(words), lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))
    return F.slice(kept, 1, most)


def address_tokens(street: Column, *parts: Column, most: int = 16) -> Column:
    """search_tokens of the parts of an address, with the street's stems before them, and before those "проспект" where one is named."""
    # How an avenue is written short.
    avenue = F.regexp_like(ru_lower(F.concat_ws(" ", *parts)), F.lit(r"пр[-.\s]*кт|проспект"))
    words = search_tokens(*parts, most=1 << 20)
    every = F.array_distinct(F.split(ru_lower(F.concat_ws(" ", *parts)), r"(?U)[^\w]+"))
    stems = F.reverse(F.filter(street_stems(street), lambda x: ~F.array_contains(every, x)))  # each goes to the front
    front = F.when(avenue & ~F.array_contains(every, F.lit("проспект")), F.array(F.lit("проспект"))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(front, stems, words), 1, most)


def parity_points(house: Column, blob: Column) -> Column:
    """Points for the one street whose even and odd houses belong to different sections."""
    # The street, the words for even and odd houses after it, and the points.
    after = lambda word: F.regexp_like(blob, F.lit(rf"(?U)ильича[^.;]{{0,48}}дома\s+{word}"))
    n = F.regexp_extract(F.trim(house), r"^(\d+)", 1).try_cast("decimal(38,0)")
    even, odd = after("чет"), after("нечет")
    points = F.when(n % 2 == 1, F.when(odd, 55).when(even, -52)).otherwise(F.when(even, 55).when(odd, -52))
    return F.when(n.isNotNull() & F.contains(blob, F.lit("ильич")), F.coalesce(points, F.lit(0))).otherwise(0)


def street_stems(c: Column) -> Column:
    """A street's name and the name without its case ending."""
    # The endings.
    s = ru_lower(F.trim(c))
    one = F.when((F.length(s) >= 5) & F.substring(s, -1, 1).isin(list("аяуюеоыи")), F.expr("1"))
    two = F.when((F.length(s) >= 6) & F.substring(s, -2, 2).isin("ого", "его", "ому", "ему"), F.expr("1"))
    stems = F.array(s, F.when(one.isNotNull(), F.left(s, F.length(s) - 1)), F.when(two.isNotNull(), F.left(s, F.length(s) - 2)))
    return F.when(not_blank(c), F.array_distinct(F.filter(stems, lambda x: F.length(x) >= 3))).otherwise(F.array().cast("array<string>"))


# Endings of Russian adjectives and nouns.
ENDINGS = ["ыми", "ими", "ого", "его", "ому", "ему", "ая", "яя", "ое", "ее", "ый", "ий", "ой", "ые", "ие", "ых", "их", "ым", "им", "ую", "юю", "ом", "ем", "ей", "иями", "ями", "ами", "иях", "ях", "ах", "ием", "ям", "ам", "ов", "ев", "ия", "ию", "ья", "ью", "ье", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я"]


def stem(word: Column) -> Column:
    """A Russian word in lower case without its longest ending, of which three letters at least are left."""
    return F.regexp_replace(ru_lower(word), rf"^(\p{{L}}{{3,}}?)(?:{'|'.join(ENDINGS)})$", "$1")


def stems(c: Column) -> Column:
    """The distinct stems of a text's words of three letters or more, in order of first sight."""
    words = F.regexp_extract_all(ru_lower(c), F.lit(r"(\p{L}{3,})"), 1)
    return F.array_distinct(F.transform(words, stem))


def text_score(blob: Column, tokens: Column, street: Column, district: Column, house: Column) -> Column:
    """How well a directory entry's text fits an address; the parts of the address may be null."""
    held = lambda word: F.coalesce(F.contains(blob, word), F.lit(False))
    by_token = F.aggregate(tokens, F.lit(0), lambda n, t: n + F.when(held(t), F.least(F.length(t), F.lit(12))).otherwise(0))
    st, d, h = ru_lower(street), ru_lower(district), F.trim(house)
    by_street = F.when(not_blank(street) & held(st), 28).otherwise(0)
    by_stem = F.aggregate(F.filter(street_stems(street), lambda x: x != st), F.lit(0), lambda n, x: n + F.when(held(x), 14).otherwise(0))
    by_district = F.when(not_blank(district) & held(d), 22).otherwise(0)
    parts = F.filter(F.split(d, r"\s+"), lambda x: F.length(x) >= 4)
    by_part = F.aggregate(parts, F.lit(0), lambda n, x: n + F.when(held(x), 10).otherwise(0))
    marked = F.regexp_like(blob, F.concat(F.lit(r"(?U)(?:д\.?|дом|№)\s*\Q"), h, F.lit(r"\E\b")))
    by_house = F.when(not_blank(house) & marked, 40).when(not_blank(house) & (F.length(h) <= 5) & held(h), 18).otherwise(0)
    return by_token + by_street + by_stem + by_district + by_part + by_house + parity_points(house, blob)


def region_tokens(region: Column) -> Column:
    words = F.regexp_extract_all(ru_lower(region), F.lit(r"([а-яa-z]{4,})"), 1)
    return F.filter(words, lambda w: ~w.isin(REGION_WORDS))


def region_fits(region: Column, address: Column) -> Column:
    """Whether an address may lie in a rule's region; a blank region fits all."""
    r, a = ru_lower(F.trim(region)), ru_lower(address)
    city = F.contains(r, F.lit("нижегородск")) & F.contains(a, F.lit("нижний")) & F.contains(a, F.lit("новгород"))
    word = F.exists(region_tokens(region), lambda w: F.contains(a, w))
    return ~not_blank(region) | city | word | ((F.length(r) >= 10) & F.contains(a, r))


def redact(c: Column, most: int = 400) -> Column:
    """Secrets in key=value pairs and bearer tokens masked, cut to a length."""
    s = F.regexp_replace(c, r"(?i)\b(api[_-]?key|token|secret|password|authorization)\b(\s*[=:]\s*)\S+", "$1$2***")
    return F.left(F.regexp_replace(s, r"(?i)\bbearer\s+\S+", "Bearer ***"), F.lit(most))


def date_of(c: Column) -> Column:
    s = F.left(F.trim(c), F.lit(10))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")])


def repaired_json(c: Column) -> Column:
    """The JSON in a text: all of it, of a code fence or between braces, with quotes, commas and keys mended; null if none parses."""
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(F.regexp_replace(F.translate(braces, "'", '"'), r",\s*([}\]])", "$1"), r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":')
    whole = lambda s: F.when(F.try_parse_json(s).isNotNull() & F.regexp_like(s, F.lit(r"(?s)^\s*[\[{]")), s)
    return F.coalesce(whole(c), whole(fence), whole(braces), whole(mended))


def clean_lines(c: Column, shortest: int = 4) -> Column:
    """Lines of a scanned text without strange signs; lines that get too short are dropped."""
    kept = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)[^\w\s.,:;№/()\-]", "")))
    return F.array_join(F.filter(kept, lambda x: F.length(x) >= shortest), "\n")


def url_parts(c: Column) -> Column:
    """Region code and slug of a directory page: /courts/<code>/wc/<slug>."""
    path = F.try_parse_url(c, F.lit("PATH"))
    pattern = r"^/courts/([^/]+)/wc/([^/]+)"
    return F.struct(first_group(path, pattern).alias("code"), first_group(path, pattern, 2).alias("slug"))


def hash_key(*parts: Column, length: int = 64) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(length))
