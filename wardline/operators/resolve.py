"""Resolving addresses and points to courts: staged candidates, votes, selection and enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import geo, grades, text
from wardline.operators import votes
from wardline.operators.joins import best

NEAREST_SOURCES = ("courts_nearest", "courts_geo_nearest")


def cascade(probes: DataFrame, stages: list[DataFrame], key: str = "row_id") -> DataFrame:
    """The first stage's candidate for each probe.

    Stages are tables of the key and the same other columns, one row for each key; a row
    is taken from the first stage that has one, so a stage only counts for what those
    before it left.
    """
    tagged = [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)]
    every = reduce(DataFrame.unionByName, tagged)
    return probes.select(key).join(best(every, key, F.col("stage")), key, "left")


def resolve_addresses(candidates: DataFrame, strict: bool = False, prefer_provider: bool = False, min_sum: float = votes.MIN_SUM) -> DataFrame:
    """One court for each row from its candidates D (directory), A (district), B (provider) and C (point).

    candidates: row_id, stage, source, court_name, section_num. The vote's winner is
    taken by the first of D, B, C, A that names it; under strict a point's court stays
    and a differing other court calls for review. Without a winner the order is D, then
    B if preferred, then A, B, C. A court found as the nearest one always calls for review.
    """
    resolved = votes.resolve(votes.candidate_votes(candidates), "row_id", min_sum)
    keyed = candidates.filter(text.not_blank(F.col("court_name"))).withColumn("court_key", text.court_key(F.col("court_name")))
    joined = keyed.join(resolved.select("row_id", F.col("court_key").alias("winner_key"), "confidence_score", "reason", "needs_manual_review", "conflict"), "row_id")
    wins = joined["court_key"] == joined["winner_key"]
    order = lambda letters: F.array_position(F.array(*[F.lit(x) for x in letters]), F.col("stage"))
    plain = order("DBAC" if prefer_provider else "DABC")
    by_point = F.lit(strict) & (F.col("stage") == "C")
    rank = F.when(by_point, 0).when(wins, order("DBCA")).otherwise(10 + plain)
    chosen = best(joined.withColumn("rank", rank), "row_id", F.col("rank"), F.col("source"))
    override = F.lit(strict) & (F.col("stage") == "C") & (F.col("court_key") != F.col("winner_key"))
    return chosen.select(
        "row_id",
        "stage",
        "source",
        "court_name",
        text.section_text(F.col("section_num")).alias("selected_court_id"),
        "confidence_score",
        "reason",
        (F.col("needs_manual_review") | override | F.col("source").isin(*NEAREST_SOURCES)).alias("needs_manual_review"),
        override.alias("spatial_override"),
        "conflict",
    )


def merge_sparse(base: dict[str, Column], alternates: list[dict[str, Column]]) -> dict[str, Column]:
    """Each field of base, or the first filled one of the alternates (C, B, A)."""
    return {name: text.first_filled(c, *[a[name] for a in alternates if name in a]) for name, c in base.items()}


def overlay_card(courts: DataFrame, cards: DataFrame, key: str = "row_id") -> DataFrame:
    """courts with what a directory's card says where it says something.

    cards: key, name, address, phone, email, schedule, section_numbers (array of text) and
    the blocks superior_court, state_fee_requisites, bailiffs (JSON text, empty if not
    there). The section counts only where the card has exactly one.
    """
    one = F.when(F.size("section_numbers") == 1, F.get("section_numbers", F.lit(0)).try_cast("int"))
    card = cards.select(key, *[F.col(c).alias(f"_{c}") for c in cards.columns if c != key and c != "section_numbers"], one.alias("_section_num"))
    joined = courts.join(card, key, "left")
    over = {"court_name": "_name", "section_num": "_section_num"} | {c: f"_{c}" for c in ("address", "phone", "email", "schedule", "superior_court", "state_fee_requisites", "bailiffs")}
    filled = lambda c: F.col(c) if c == "_section_num" else F.nullif(F.col(c), F.lit(""))
    return joined.select(*[F.coalesce(filled(over[c]), F.col(c)).alias(c) if c in over and over[c] in joined.columns else F.col(c) for c in courts.columns])


def geocode_consensus(results: DataFrame, metres: float = 100.0) -> DataFrame:
    """row_id, source, pos, lat, lon, confidence to one point for each row.

    Results within metres of each other are averaged by the sources' weights and keep
    the first one's confidence; else the best by confidence, then order, is taken. Each
    row has one result for each provider, so they are gathered.
    """
    r = F.struct("pos", "source", "lat", "lon", "confidence", grades.geocode_weight(F.col("source")).alias("w"))
    grouped = results.filter(geo.valid_point(F.col("lat"), F.col("lon"))).groupBy("row_id").agg(F.array_sort(F.collect_list(r)).alias("rs"))
    apart = F.transform("rs", lambda a: F.array_max(F.transform("rs", lambda b: geo.haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]))))
    agree = F.array_max(apart) * 1000 <= metres
    total = F.aggregate("rs", F.lit(0.0), lambda s, x: s + x["w"])
    mean = lambda f: F.aggregate("rs", F.lit(0.0), lambda s, x: s + x["w"] * x[f]) / total
    top = F.array_max(F.transform("rs", lambda x: F.struct(grades.geocode_rank(x["confidence"]).alias("rank"), F.negative(x["pos"]).alias("minus"), x["lat"].alias("lat"), x["lon"].alias("lon"), x["confidence"].alias("confidence"))))
    both = agree & (F.size("rs") > 1)
    confidence = F.when(both, F.get("rs", F.lit(0))["confidence"]).otherwise(top["confidence"])
    return grouped.select(
        "row_id",
        F.when(both, mean("lat")).otherwise(top["lat"]).alias("lat"),
        F.when(both, mean("lon")).otherwise(top["lon"]).alias("lon"),
        agree.alias("agree"),
        confidence.alias("confidence"),
        grades.geocode_level(confidence).alias("level"),
    )


def input_gate(rows: DataFrame) -> DataFrame:
    """Rows with status OK or ERROR and an error code; none is dropped."""
    lat, lon = F.col("lat"), F.col("lng")
    has_point = lat.isNotNull() & lon.isNotNull()
    code = (
        F.when(~text.not_blank(F.col("fio")) & ~text.not_blank(F.col("address")) & ~has_point, "ERROR_EMPTY_ROW")
        .when(has_point & ~geo.valid_point(lat, lon), "ERROR_INVALID_COORDS")
        .when(~text.not_blank(F.col("address")) & ~has_point, "ERROR_NO_ADDRESS")
    )
    return rows.withColumn("error_code", code).withColumn("status", F.when(code.isNull(), "OK").otherwise("ERROR"))
