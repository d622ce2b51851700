"""Set operations, keep-first dedup, upserts, fills and changes over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dealt


def keep_first(df: DataFrame, keys: list[str | Column], *order: Column) -> DataFrame:
    """Of rows alike in the keys the first by an explicit order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """New rows replace old ones of the same key; of several new ones the last by order."""
    latest = keep_first(new, keys, *[c.desc() for c in order]) if order else new
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*old.columns))


def upsert_partial(old: DataFrame, new: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Upsert in which a null among the kept columns leaves the old value."""
    o, n = old.alias("o"), new.withColumn("_present", F.lit(True)).alias("n")  # also of a null key
    present = F.coalesce("n._present", F.lit(False))
    columns = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in old.columns:
        if c in kept:
            columns.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        elif c != key:
            columns.append(F.when(present, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_where(old: DataFrame, gone: Column, new: DataFrame) -> DataFrame:
    """Rows for which the predicate holds are replaced by new."""
    return old.filter(~F.coalesce(gone, F.lit(False))).unionByName(new.select(*old.columns))


def update_by_section(rows: DataFrame, contacts: DataFrame, value: str, section: Column) -> DataFrame:
    """Set a column of all rows of a section where the contacts have it; contacts: section, and the column."""
    right = contacts.select(F.col("section").alias("_section"), F.col(value).alias("_new"))
    joined = rows.withColumn("_key", section).join(right, F.col("_key") == F.col("_section"), "left")
    return joined.withColumn(value, F.coalesce("_new", value)).drop("_key", "_section", "_new")


def missing_numbers(present: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """The whole numbers low..high that a column lacks; what is not a number doesn't count."""
    spark = present.sparkSession
    have = present.select(F.trim(F.col(column).cast("string")).try_cast("long").alias("n")).filter("n IS NOT NULL")
    return spark.range(low, high + 1).withColumnRenamed("id", "n").join(have, "n", "left_anti")


def two_way_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, side: what is expected and missing, and what is there in excess; nulls are equal."""
    of = lambda df, there: df.select(key, F.lit(there).alias("_expected"))
    # keys are dealt once, so a task holds its share of them and nothing else
    both = dealt(of(expected, True).unionByName(of(actual, False)), key).groupBy(key).agg(F.max("_expected").alias("_e"), F.min("_expected").alias("_a"))
    side = F.when(F.col("_a"), "missing").when(~F.col("_e"), "extra")
    return both.select(key, side.alias("side")).filter("side IS NOT NULL")


def fill_down(df: DataFrame, value: str, by: list[str], *order: Column) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(window))


def changes(df: DataFrame, key: str, status: str, *order: Column) -> DataFrame:
    """Rows whose trimmed status differs from the key's one before; the first is silent."""
    before = F.lag(F.trim(status)).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("previous", before).filter(F.col("previous").isNotNull() & (F.trim(status) != F.col("previous")))


def latest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_by_key(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The last n rows of each key."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*[c.desc() for c in order]))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")


def zip_rows(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Input and result rows side by side, by their number."""
    return left.join(right, key, "left")


def read_through(probes: DataFrame, levels: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Look keys up level by level; from_cache names the first level that has a key, 'fetch' if none."""
    found, rest = None, probes.select(key).distinct()
    for name, table in levels:
        hit = rest.join(table.select(key), key, "left_semi").withColumn("from_cache", F.lit(name))
        rest = rest.join(table.select(key), key, "left_anti")
        found = hit if found is None else found.union(hit)
    last = rest.withColumn("from_cache", F.lit("fetch"))
    return last if found is None else found.union(last)


def live_entries(cache: DataFrame, now: Column) -> DataFrame:
    """The newest entry of each key, if it has not expired."""
    newest = keep_first(cache, ["key"], F.col("stored_at").desc(), F.col("value").desc())
    return newest.filter(F.col("stored_at") + F.make_dt_interval(secs=F.col("ttl_s").cast("decimal(18,6)")) > now)


def in_force(df: DataFrame, day: Column, begins: str, ends: str) -> DataFrame:
    """Rows in force on a day: begun, and not ended before it; an open end counts as in force."""
    return df.filter((F.col(begins) <= day) & (F.col(ends).isNull() | (F.col(ends) >= day)))


def union_numbered(parts: list[DataFrame], name: str, *order: Column) -> DataFrame:
    """The rows of several sources, numbered on from one to the next; each source's by its order.

    Numbers are taken in one window over each source; sources are layers of a map, of some
    thousands of rows.
    """
    out, before = None, 0
    for part in parts:
        numbered = part.withColumn(name, (F.row_number().over(Window.orderBy(*order)) + before).cast("long"))
        out = numbered if out is None else out.unionByName(numbered)
        before += part.count()
    return out


def dedup_courts(courts: DataFrame, *order: Column) -> DataFrame:
    """Courts once for each name and address, with the region that the address names, if it names one."""
    from wardline.functions import address

    named = F.nullif(address.region_of_list(F.col("address")), F.lit(""))
    return keep_first(courts.withColumn("region", F.coalesce(named, "region")), ["court_name", "address"], *order)


def feedback_summary(feedback: DataFrame, column: str = "verdict") -> DataFrame:
    """How often each verdict was given, in lower case; blank ones are unknown."""
    from wardline.functions import text

    verdict = F.coalesce(text.blank_to_null(F.lower(column)), F.lit("unknown"))
    return feedback.groupBy(verdict.alias(column)).agg(F.count("*").alias("n"))


def drop_prefix(cache: DataFrame, prefix: str) -> DataFrame:
    """The cache without the entries whose keys begin with a prefix."""
    return cache.filter(~F.startswith("key", F.lit(prefix)) | F.col("key").isNull())
