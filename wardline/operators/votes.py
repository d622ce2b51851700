"""Weighted vote resolution: sum the sources' weights by court and say how sure the winner is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SUM, DISAGREEMENT, CLOSE, STRONG = 1.5, 0.3, 0.5, 0.8
POLYGON_SOURCES = ("polygon", "postgis")
# Weights of the candidate sources, in the order in which they vote.
WEIGHTS = {"polygon": 1.0, "coordinates_district": 0.95, "spatial": 0.45, "dadata": 0.8, "dagalin": 0.5, "district_db": 0.3}


def round_half_even_1(c: Column) -> Column:
    """One decimal, as the exact binary value rounds; for values from 0 to 2.

    Twenty times the value is split into an upper and a lower part by Veltkamp's constant,
    whose products are exact, so the remainder against the tie has its true sign; a true
    tie goes to the even digit.
    """
    down = F.floor(c * 10)
    tie = (down.cast("double") + 0.5) / 10
    # c is on one side of the decimal tie or the other: the tie's own binary value may be off by its last bit,
    # so c is compared with it exactly, by what c * 20 leaves over an odd whole number
    big = c * 134217729.0
    high = big - (big - c)
    low = c - high
    over = (high * 20 - (down * 2 + 1)) + low * 20
    near = F.abs(c - tie) < 1e-9
    up = F.when(near, F.when(over > 0, 1).when(over < 0, 0).otherwise(down % 2)).otherwise(F.when(c * 10 - down > 0.5, 1).otherwise(0))
    return ((down + up) / 10).cast("double")


def resolve(votes: DataFrame, by: str = "probe", min_sum: float = MIN_SUM, disagreement: float = DISAGREEMENT) -> DataFrame:
    """(by, pos, source, court_name, court_key, weight) to one row for each value of by.

    Votes without key or of no weight don't count; a value of by that has no other votes
    gets no court. Weights are summed in the order of pos, and of equal sums the key met
    first wins, its longest name first. Votes of one probe are few (one for each source),
    so each probe's are gathered.
    """
    counts = (F.coalesce(F.col("court_key"), F.lit("")) != "") & (F.col("weight") > 0)
    vote = F.struct("pos", "source", "court_name", "court_key", "weight")
    grouped = votes.groupBy(by).agg(F.array_sort(F.collect_list(F.when(counts, vote))).alias("votes"))
    key_sums = F.transform(
        F.array_distinct(F.transform("votes", lambda v: v["court_key"])),
        lambda k, i: F.struct(
            F.negative(F.aggregate(F.filter("votes", lambda v: v["court_key"] == k), F.lit(0.0), lambda s, v: s + v["weight"])).alias("minus"),
            i.alias("i"),
            k.alias("key"),
        ),
    )
    sums = grouped.withColumn("sums", F.array_sort(key_sums)).withColumns(
        {
            "winner": F.try_element_at("sums", F.lit(1)),
            "second": F.coalesce(F.negative(F.try_element_at("sums", F.lit(2))["minus"]), F.lit(0.0)),
            "polygon_key": F.try_element_at(F.filter("votes", lambda v: F.lower(v["source"]).isin(*POLYGON_SOURCES)), F.lit(1))["court_key"],
        }
    )
    top, key, n = F.negative(F.col("winner")["minus"]), F.col("winner")["key"], F.size("sums")
    all_differ = (n == F.size("votes")) & (n >= 3)
    against = F.col("polygon_key").isNotNull() & F.exists("votes", lambda v: (v["court_key"] != F.col("polygon_key")) & (v["weight"] >= STRONG))
    conflict = ((n > 1) & (top - F.col("second") <= CLOSE)) | against | ((n > 1) & (F.col("second") >= STRONG))
    on_polygon = F.coalesce(key == F.col("polygon_key"), F.lit(False))
    names = F.transform(F.filter("votes", lambda v: v["court_key"] == key), lambda v, i: F.struct(F.length(v["court_name"]).alias("long"), F.negative(i).alias("i"), v["court_name"].alias("name")))
    reason = (
        F.when(n == 0, "no data")
        .when(all_differ, "all sources differ")
        .when(against & on_polygon, "polygon against other sources")
        .when((top >= 1.0) & on_polygon, "polygon and street")
        .when(top >= 0.8, "street and houses")
        .when(top >= 0.5, "street only")
        .otherwise("low sum")
    )
    return sums.select(
        by,
        F.array_max(names)["name"].alias("court_name"),
        key.alias("court_key"),
        F.when(n == 0, 0.0).when(all_differ, disagreement).otherwise(round_half_even_1(F.least(top, F.lit(2.0)))).alias("confidence_score"),
        reason.alias("reason"),
        F.coalesce((n == 0) | all_differ | (top < min_sum) | conflict, F.lit(True)).alias("needs_manual_review"),
        F.coalesce((n > 0) & (all_differ | conflict), F.lit(False)).alias("conflict"),
        F.size("votes").cast("long").alias("n_votes"),
    )


def key_collisions(votes: DataFrame) -> DataFrame:
    """Keys to which more than one raw name was folded."""
    return votes.groupBy("court_key").agg(F.countDistinct("court_name").alias("n_names")).filter("n_names > 1")


def candidate_votes(candidates: DataFrame) -> DataFrame:
    """row_id, stage (C, B, D or A), source, court_name to votes; blank names give none."""
    from wardline.functions.text import court_key, not_blank

    s = F.col("source")
    tag = (
        F.when(F.col("stage") == "C", F.when((s == "court_districts") | F.contains(s, F.lit("postgis")), "polygon").when(s == "coordinates_district", "coordinates_district").otherwise("spatial"))
        .when(F.col("stage") == "B", "dadata")
        .when(F.col("stage") == "D", "dagalin")
        .otherwise("district_db")
    )
    weight = None
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("tag") == name, w) if weight is None else weight.when(F.col("tag") == name, w)
    pos = F.array_position(F.array(*[F.lit(x) for x in "CBDA"]), F.col("stage"))
    shown = F.when(F.col("tag") == "coordinates_district", "polygon").otherwise(F.col("tag"))
    return (
        candidates.filter(not_blank(F.col("court_name")))
        .withColumn("tag", tag)
        .select(F.col("row_id"), pos.alias("pos"), shown.alias("source"), "court_name", court_key(F.col("court_name")).alias("court_key"), weight.alias("weight"))
    )
