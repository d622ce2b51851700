"""Cascades that find a court for a point, an address or a person, each stage a table of its candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import text
from wardline.operators import joins, resolve
from wardline.operators.shared import settle

FOUND = ("row_id", "court_name", "section_num", "source", "needs_review")
BORDER_METRES, RADIUS_KM = 50.0, 5.0
# What stands where no court is found for a person.
FALLBACK_NAME, FALLBACK_SOURCE = "Районный суд по месту жительства ответчика", "fallback_rule"


def _found(rows: DataFrame, source: str, review=None) -> DataFrame:
    """Candidates of one stage; review: whether they call for review."""
    no = F.lit(False) if review is None else review
    return rows.select("row_id", "court_name", F.col("section_num").cast("string").alias("section_num"), F.lit(source).alias("source"), no.alias("needs_review"))


def _by_district(probes: DataFrame, districts: DataFrame, source: str) -> DataFrame:
    """probes: row_id, region, district; districts: id, region, district, court_name."""
    filled = probes.filter(text.not_blank(F.col("region")) & text.not_blank(F.col("district")))
    found = joins.district_lookup(filled, districts).filter("court_name IS NOT NULL")
    return _found(found.withColumn("section_num", text.section_number(F.col("court_name"))), source)


def by_point(points: DataFrame, areas: DataFrame, courts: DataFrame, districts: DataFrame, reverse: DataFrame | None = None, spatial: DataFrame | None = None, more_courts: DataFrame | None = None) -> DataFrame:
    """FOUND, one row for each point with a court: the first stage that has one.

    points: row_id, lat, lon. The stages: areas of the spatial store (spatial) and then of
    the district table (areas; both: area_id, ring, court_name, section_num, kind), with a
    review near the border; region and district of a reverse geocoder (reverse: row_id,
    pos, region, district, locality), the first by pos, where the second and later ones
    also try the locality; the nearest court within 5 km of courts, then of more_courts
    (place_id, plat, plon, court_name, section_num).
    """
    located = points.select(F.col("row_id").alias("point_id"), "lat", "lon")
    stages = []
    for source, rings in (("postgis", spatial), ("court_districts", areas)):
        if rings is not None:
            hit = joins.best(joins.points_in_rings(located, rings), "point_id", F.col("kind"), F.col("area_id")).withColumnRenamed("point_id", "row_id")
            stages.append(_found(hit, source, F.col("border_m") < BORDER_METRES if source == "court_districts" else None))
    if reverse is not None:
        stages.append(_by_district(reverse.filter("pos = 1"), districts, "coordinates_district"))
        for column in ("district", "locality"):
            later = joins.best(reverse.filter("pos > 1").filter(text.not_blank(F.col(column))), "row_id", F.col("pos"))
            stages.append(_by_district(later.select("row_id", "region", F.col(column).alias("district")), districts, "coordinates_district_osm"))
    for source, places in (("courts_nearest", courts), ("courts_geo", more_courts)):
        if places is not None:
            stages.append(_found(joins.nearest(located, places, RADIUS_KM).withColumnRenamed("point_id", "row_id"), source))
    return resolve.cascade(points, stages).filter("court_name IS NOT NULL").select(*FOUND)


def by_address(rows: DataFrame, rules: DataFrame, districts: DataFrame, provider: DataFrame | None = None, geocoded: DataFrame | None = None, point_tables: dict | None = None) -> DataFrame:
    """FOUND and level, one row for each address with a court: the first stage that has one.

    rows: row_id, address, lemmas. The stages: rules; region and district of the address;
    the provider's answer (row_id, court_name, section_num); the point of a geocoder
    (geocoded: row_id, lat, lon, needs_review, level) by by_point with point_tables.
    """
    filled = rows.filter(text.not_blank(F.col("address"))).select("row_id", F.trim("address").alias("address"), "lemmas")
    ruled = joins.rule_match(filled, rules).filter("section_num IS NOT NULL").withColumn("court_name", F.concat(F.lit("Судебный участок №"), "section_num"))
    stages = [ruled.select("row_id", "court_name", "section_num", "source", F.lit(False).alias("needs_review"))]
    parsed = settle(joins.parsed_parts(filled.select("row_id", "address"), "region", "district").select("row_id", "region", "district"))  # the lookup reads it twice
    stages.append(_by_district(parsed, districts, "address_district"))
    if provider is not None:
        stages.append(_found(provider.filter(text.not_blank(F.col("court_name"))), "dadata"))
    stages = [s.withColumn("level", F.lit(None).cast("string")) for s in stages]
    if geocoded is not None:
        located = by_point(geocoded.select("row_id", "lat", "lon"), **(point_tables or {}))
        seen = located.join(geocoded.select("row_id", F.col("needs_review").alias("_review"), "level"), "row_id")
        stages.append(seen.select(*FOUND[:4], (F.col("needs_review") | F.coalesce("_review", F.lit(False))).alias("needs_review"), "level"))
    return resolve.cascade(filled, stages).filter("court_name IS NOT NULL").select(*FOUND, "level")


def by_person(rows: DataFrame, districts: DataFrame, prefixes: DataFrame, provider: DataFrame | None = None, located: DataFrame | None = None, registry: DataFrame | None = None) -> DataFrame:
    """row_id, court_name, section_num, source, region: a court for every row, by the older order of stages.

    rows: row_id, fio, passport, address; prefixes: prefix, region of passport codes. The
    provider's answer by address, else the nearest court of the geocoded address
    (located), the district within the passport's region, the district within the
    address's region, the registry's answer by name, and in the end the fallback.
    """
    parsed = joins.prefix_lookup(rows.select("row_id", "fio", "passport", "address"), "passport", prefixes).withColumnRenamed("region", "passport_region")
    parsed = settle(joins.parsed_parts(parsed, "region", "district").withColumnRenamed("region", "address_region"))  # all stages read it
    having = lambda table, column: table.join(parsed.filter(text.not_blank(F.col(column))).select("row_id"), "row_id", "left_semi")
    stages = []
    if provider is not None:
        stages.append(_found(having(provider, "address").filter(text.not_blank(F.col("court_name"))), "dadata"))
    if located is not None:
        stages.append(_found(having(located, "address"), "address_geo"))
    for source, region in (("passport_code", "passport_region"), ("address", "address_region")):
        stages.append(_by_district(parsed.select("row_id", F.col(region).alias("region"), "district"), districts, source))
    if registry is not None:
        stages.append(_found(having(registry, "fio").withColumn("section_num", F.lit(0)), "fio_sudrf"))
    found = resolve.cascade(rows, stages).join(parsed.select("row_id", F.coalesce("address_region", "passport_region", F.lit("")).alias("region")), "row_id")
    return found.select("row_id", F.coalesce("court_name", F.lit(FALLBACK_NAME)).alias("court_name"), F.coalesce(F.col("section_num").try_cast("int"), F.lit(0)).alias("section_num"), F.coalesce("source", F.lit(FALLBACK_SOURCE)).alias("source"), "region")
