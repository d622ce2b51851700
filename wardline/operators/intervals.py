"""Interval joins by bins of powers of two.

An interval of whole numbers is covered by at most two aligned bins of each size, and a
number lies in one bin of each size, so a join of numbers with intervals is one of equal
keys (size, bin): an interval has a logarithmic number of rows, a number one for each
size that occurs among the intervals of its key, and no row meets an interval that
doesn't hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = "struct<level:int,bin:bigint>"


def covers(low: Column, high: Column, top: int) -> Column:
    """The fewest aligned bins of 1, 2, ... 2**top numbers that together are low..high, both included.

    An empty or null interval has none. Larger intervals take several bins of the largest size.
    """
    one = F.lit(1).cast("long")
    low, high = low.cast("long"), high.cast("long")

    def of_level(k: Column) -> Column:
        size = F.call_function("shiftleft", one, k)
        first, last = F.call_function("shiftright", low + size - 1, k), F.call_function("shiftright", high + 1, k) - 1
        within = lambda b: (F.call_function("shiftleft", F.call_function("shiftright", b, F.lit(1)), k + 1) >= low) & (F.call_function("shiftleft", F.call_function("shiftright", b, F.lit(1)) + 1, k + 1) - 1 <= high)
        ends = F.array_distinct(F.array(first, last))
        ends = F.when(k < top, F.filter(ends, lambda b: ~within(b))).otherwise(F.sequence(first, last))
        return F.when(first <= last, F.transform(ends, lambda b: F.struct(k.cast("int").alias("level"), b.alias("bin")))).otherwise(F.array().cast(f"array<{BIN}>"))

    bins = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), of_level))
    return F.when(low <= high, bins).otherwise(F.array().cast(f"array<{BIN}>"))


def bin_of(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value.cast("long"), level)


def _binned(probes: DataFrame, intervals: DataFrame, value: str, low: str, high: str, top: int) -> tuple[DataFrame, int, int]:
    """intervals with _level and _bin for each of their bins, and the smallest and largest value; bins are counted from the smallest."""
    n = F.col(value).cast("long")
    least, most = probes.agg(F.min(n), F.max(n)).first()
    least, most = least or 0, most or 0
    # counted from the smallest value, so that bins begin at zero
    begin = F.greatest(F.coalesce(F.col(low).cast("long"), F.lit(least)), F.lit(least)) - least
    end = F.least(F.coalesce(F.col(high).cast("long"), F.lit(most)), F.lit(most)) - least
    return intervals.withColumn("_bin", F.explode(covers(begin, end, top))).select("*", "_bin.level", "_bin.bin").drop("_bin").withColumnsRenamed({"level": "_level", "bin": "_bin"}), least, most


def interval_join(probes: DataFrame, intervals: DataFrame, on: list[str], value: str, low: str = "low", high: str = "high", top: int = 20, how: str = "inner") -> DataFrame:
    """probes with the intervals (columns of on, low, high and more) whose low..high holds their value, both included.

    Equal in on, where nulls are equal to nothing; a null low or high is open. how: inner, or left
    to keep probes without intervals. Numbers below an open interval's other end are bound
    by the smallest and largest value of the probes, which are looked up once.
    """
    binned, least, _ = _binned(probes, intervals, value, low, high, top)
    n = F.col(value).cast("long")
    keys = [F.col(c).alias(f"_{c}") for c in on]
    same = lambda df: [F.col(c) == F.col(f"_{c}") for c in on]
    levels = binned.groupBy(*on).agg(F.array_sort(F.collect_set("_level")).alias("_levels")).select(*keys, "_levels")
    numbered = probes.withColumn("_row", F.monotonically_increasing_id()) if how == "left" else probes
    pathed = numbered.join(levels, same(levels)).drop(*[f"_{c}" for c in on]).withColumn("_level", F.explode("_levels")).withColumn("_bin", bin_of(n - least, F.col("_level"))).drop("_levels")
    right = binned.withColumnsRenamed({c: f"_{c}" for c in on})
    met = pathed.join(right, [*same(right), pathed["_level"] == right["_level"], pathed["_bin"] == right["_bin"]]).drop("_level", "_bin", *[f"_{c}" for c in on])
    if how == "inner":
        return met
    extra = [c for c in intervals.columns if c not in on]
    hits = met.select("_row", *extra).withColumnRenamed("_row", "_of")
    return numbered.join(hits, F.col("_row") == F.col("_of"), "left").drop("_row", "_of")


def interval_totals(probes: DataFrame, intervals: DataFrame, on: list[str], value: str, first: str, low: str = "low", high: str = "high", top: int = 20) -> DataFrame:
    """probes with n_ranges, how many intervals hold their value, and first, the least of their column first; equal in on.

    What interval_join and a count give, without its pairs: intervals are counted by their ends
    and then by bin, and each value of a key adds up one row of a bin for each size. Probes without intervals drop out.
    """
    alike = intervals.groupBy(*on, low, high).agg(F.count("*").alias("_n"), F.min(first).alias("_first"))
    binned, least, most = _binned(probes, alike, value, low, high, top)
    bins = binned.groupBy(*on, "_level", "_bin").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    levels = range(min(top, (most - least).bit_length()) + 1)
    values = probes.select(*on, F.col(value).cast("long").alias("_value")).distinct()
    tried = values.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", bin_of(F.col("_value") - least, F.col("_level")))
    totals = tried.join(bins, [*on, "_level", "_bin"]).groupBy(*on, "_value").agg(F.sum("_n").alias("n_ranges"), F.min("_first").alias("first"))
    return probes.withColumn("_value", F.col(value).cast("long")).join(totals, [*on, "_value"]).drop("_value")
