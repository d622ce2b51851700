"""Checks of areas and comparisons of resolvers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text
from wardline.operators import joins, rings
from wardline.operators.reports import share
from wardline.operators.shared import dealt


def ring_faults(areas: DataFrame) -> DataFrame:
    """area_id, fault: rings that are missing, have fewer than three corners, or cross themselves."""

    @F.pandas_udf("boolean")
    def crosses(column):
        return column.map(lambda ring: ring is not None and len(ring) > 3 and rings.crosses_itself(rings.edges_of(ring)))

    fault = F.when(F.col("ring").isNull(), "missing").when(F.size("ring") < 3, "too few corners").when(crosses("ring"), "crosses itself")
    return areas.select("area_id", fault.alias("fault")).filter("fault IS NOT NULL")


def repaired(areas: DataFrame) -> DataFrame:
    """area_id, rings, area, changed: each area as rings that don't cross themselves.

    They bound the points that an even-odd count of the sides finds inside: outer rings turn
    left, holes right, and area is the sum of both. A ring that is valid as it is stays one ring,
    with repeated corners left out; changed tells whether there were crossings. Null rings
    and those of no area, or with null corners, have no rings.
    """

    signed = lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), F.lit(0.0), lambda s, i: s + r[i]["x"] * r[(i + 1) % F.size(r)]["y"] - r[(i + 1) % F.size(r)]["x"] * r[i]["y"]) / 2
    return rings.rebuilt(dealt(areas)).select("area_id", "rings", F.aggregate("rings", F.lit(0.0), lambda s, r: s + signed(r)).alias("area"), "changed")


def verification(areas: DataFrame) -> DataFrame:
    """area_id, faults, overlaps, status: each area's own faults and its overlaps with others."""
    faults = ring_faults(areas)
    good = areas.join(faults.select("area_id"), "area_id", "left_anti")
    pairs = joins.overlapping_rings(good.select("area_id", "ring"))
    both = pairs.select(F.col("a_id").alias("area_id")).union(pairs.select(F.col("b_id").alias("area_id")))
    counted = both.groupBy("area_id").agg(F.count("*").alias("overlaps"))
    out = areas.select("area_id").join(faults, "area_id", "left").join(counted, "area_id", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))
    return out.withColumn("status", F.when(F.col("fault").isNotNull(), "error").when(F.col("overlaps") > 0, "warning").otherwise("ok"))


def compare(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Shares of rows that each of two resolvers found, and that they found alike; both: key, court_name."""
    joined = a.select(key, F.col("court_name").alias("a")).join(b.select(key, F.col("court_name").alias("b")), key)
    same = text.same_court(F.col("a"), F.col("b"))
    return joined.agg(F.count("*").alias("n"), share(text.not_blank(F.col("a"))).alias("found_a"), share(text.not_blank(F.col("b"))).alias("found_b"), share(same).alias("alike"))


def strata(df: DataFrame, strata_of: list[Column], each: int, keys: list[str], *order: Column) -> DataFrame:
    """The first rows of each stratum, of rows alike in the keys one; no chance in it."""
    from wardline.operators.tables import keep_first

    parts = [keep_first(df.filter(s), keys, *order).orderBy(*order).limit(each) for s in strata_of]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
