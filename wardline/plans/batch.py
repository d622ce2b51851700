"""The batch pipeline as one plan: input rows, gate, candidates, votes, selection, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import text
from wardline.operators import joins, resolve
from wardline.operators.shared import settle


def point_candidates(rows: DataFrame, areas: DataFrame, courts: DataFrame) -> DataFrame:
    """Candidates C: the area that holds the point, else the nearest court within 5 km.

    areas: area_id, ring, court_name, section_num, kind; courts: place_id, plat, plon, court_name, section_num.
    """
    points = rows.select(F.col("row_id").alias("point_id"), "lat", F.col("lng").alias("lon"))
    hits = joins.best(joins.points_in_rings(points, areas), "point_id", F.col("kind"), F.col("area_id"))
    inside = hits.select(F.col("point_id").alias("row_id"), "court_name", F.col("section_num").cast("string").alias("section_num"), F.lit("court_districts").alias("source"))
    near = joins.nearest(points, courts)
    nearest = near.select(F.col("point_id").alias("row_id"), "court_name", F.col("section_num").cast("string").alias("section_num"), F.lit("courts_nearest").alias("source"))
    found = resolve.cascade(rows, [inside, nearest]).filter("court_name IS NOT NULL")
    return found.select("row_id", F.lit("C").alias("stage"), "source", "court_name", "section_num")


def parsed_rows(rows: DataFrame) -> DataFrame:
    """rows with region, district, street and house of their address, where they don't have these columns."""
    return joins.parsed_parts(rows, *[c for c in ("region", "district", "street", "house") if c not in rows.columns])


def address_candidates(rows: DataFrame, districts: DataFrame, entries: DataFrame, rules: DataFrame, provider: DataFrame | None = None) -> DataFrame:
    """Candidates A by rule or district, B of the provider and D by the directory's text.

    provider: row_id, court_name, section_num. Rows may bring region, district, street,
    house and lemmas; what they lack is read from the address.
    """
    filled = settle(parsed_rows(rows.filter(text.not_blank(F.col("address")))))  # addresses are parsed once for all stages
    lemmas = F.col("lemmas") if "lemmas" in rows.columns else F.array().cast("array<string>")
    by_rule = joins.rule_match(filled.select("row_id", "address", lemmas.alias("lemmas")), rules).filter("section_num IS NOT NULL")
    ruled = by_rule.select("row_id", F.concat(F.lit("Судебный участок №"), "section_num").alias("court_name"), "section_num", "source")
    looked = joins.district_lookup(filled.select("row_id", "region", "district"), districts).filter("court_name IS NOT NULL")
    named = looked.select("row_id", "court_name", text.section_number(F.col("court_name")).cast("string").alias("section_num"), F.lit("unified_A_district").alias("source"))
    first = resolve.cascade(filled, [ruled, named]).filter("court_name IS NOT NULL").select("row_id", F.lit("A").alias("stage"), "source", "court_name", "section_num")
    best = joins.text_top1(filled.select("row_id", "address", F.lit(None).cast("string").alias("region_code"), "street", "district", "house"), entries)
    directory = best.select("row_id", F.lit("D").alias("stage"), F.lit("dagalin_address_match").alias("source"), "court_name", text.section_number(F.col("court_name")).cast("string").alias("section_num"))
    out = first.union(directory)
    if provider is not None:
        asked = provider.join(filled.select("row_id"), "row_id", "left_semi").filter(text.not_blank(F.col("court_name")))
        out = out.union(asked.select("row_id", F.lit("B").alias("stage"), F.lit("unified_B_dadata").alias("source"), "court_name", F.col("section_num").cast("string")))
    return out


def resolve_rows(rows: DataFrame, candidates: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Every input row with its court or its error; rows: row_id, fio, address, lat, lng.

    A row with an error in its input takes no candidates. A row without a court is in
    error too: ERROR_COURT_NOT_FOUND if it has a point, else ERROR_ADDRESS_NOT_FOUND.
    """
    gated = resolve.input_gate(rows)
    good = settle(candidates.join(gated.filter("status = 'OK'").select("row_id"), "row_id", "left_semi"))  # votes and selection read them
    out = gated.join(resolve.resolve_addresses(good), "row_id", "left")
    missing = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), "ERROR_COURT_NOT_FOUND").otherwise("ERROR_ADDRESS_NOT_FOUND")
    code = F.coalesce("error_code", F.when(F.col("court_name").isNull(), missing))
    out = out.withColumn("error_code", code).withColumn("status", F.when(code.isNull(), "OK").otherwise("ERROR"))
    return joins.composite_lookup(out, details, ("selected_court_id",)) if details is not None else out
