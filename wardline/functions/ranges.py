"""House ranges in rules: from cell text to rows of from, to, parity and step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parity(c: Column) -> Column:
    """odd or even as a text says; the word for odd holds the one for even."""
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("нечет")) | F.contains(low, F.lit("нечёт")), "odd").when(F.contains(low, F.lit("чет")) | F.contains(low, F.lit("чёт")), "even")


def boundary(c: Column) -> Column:
    """struct(house_from, house_to, house_parity, house_step, house_suffix) over all numbers of a text.

    The suffix is the letter that all numbers with one share.
    """
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)")), lambda x: x.try_cast("int"))
    suffixes = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\d+([а-яёa-z])(?!\w)"), F.lit(1)), lambda x: x != ""))
    p = parity(c)
    return F.struct(F.array_min(numbers).alias("house_from"), F.array_max(numbers).alias("house_to"), p.alias("house_parity"), F.when(p.isNotNull(), 2).alias("house_step"), F.when(F.size(suffixes) == 1, F.get(suffixes, F.lit(0))).alias("house_suffix"))


def house_ranges(c: Column) -> Column:
    """Ranges of a cell: 'a-b' with parity, a list that runs in steps of two as one range, else each number alone."""
    fields = "array<struct<house_from:int,house_to:int,house_parity:string,house_step:int>>"
    span = F.regexp_extract_all(c, F.lit(r"(\d+)\s*[-–—]\s*(\d+)"), 0)
    p = parity(c)
    step = F.when(p.isNotNull(), 2)
    one = lambda a, b, q, s: F.struct(a.cast("int").alias("house_from"), b.cast("int").alias("house_to"), q.cast("string").alias("house_parity"), s.cast("int").alias("house_step"))
    spans = F.transform(span, lambda x: one(F.regexp_extract(x, r"^(\d+)", 1), F.regexp_extract(x, r"(\d+)$", 1), p, step))
    rest = F.regexp_replace(c, r"\d+\s*[-–—]\s*\d+", " ")
    numbers = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(r"(\d+)")), lambda x: x.try_cast("int"))))
    evenly = (F.size(numbers) > 2) & F.forall(F.sequence(F.lit(1), F.greatest(F.size(numbers) - 1, F.lit(1))), lambda i: F.coalesce(F.get(numbers, i) - F.get(numbers, i - 1) == 2, F.lit(False)))
    run = F.array(one(F.array_min(numbers), F.array_max(numbers), F.when(F.array_min(numbers) % 2 == 0, "even").otherwise("odd"), F.lit(2)))
    none = F.lit(None)
    singles = F.transform(numbers, lambda n: one(n, n, none, none))
    return F.concat(spans.cast(fields), F.when(F.coalesce(evenly, F.lit(False)), run.cast(fields)).otherwise(singles.cast(fields)))


def statute_rules(c: Column) -> Column:
    """Rules of a statute's text: the streets named in each sentence, with its house ranges."""
    pieces = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(c, r"(?iu)улицы\s*:", ". "), r"(?iu)\bул\.\s*", "улица "), r"[.;](?=\s|$)"), lambda x: F.trim(x)), lambda x: x != "")
    street = lambda x: F.nullif(F.trim(F.regexp_extract(x, r"(?iu)^(?:ул(?:ица|\.)?\s+)?([А-Яа-яЁёA-Za-z][А-Яа-яЁёA-Za-z\s\-]+?)\s*(?:,|:|\(|дома|д\.|№|\d|$)", 1)), F.lit(""))
    rules = F.transform(pieces, lambda x: F.struct(street(x).alias("street"), boundary(x).alias("houses"), x.alias("source_text")))
    return F.filter(rules, lambda r: r["street"].isNotNull())
