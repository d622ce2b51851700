"""Geometry on columns: points, rings (arrays of struct(x, y)), distances and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
METRES_A_DEGREE, FARTHEST_DEGREES = 111_320.0, 0.1


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def parse_point(c: Column) -> Column:
    """'lat,lon' to struct(lat, lon), null unless it is two numbers in range."""
    parts = F.split(F.regexp_replace(c, r"\s", ""), ",")
    lat, lon = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when((F.size(parts) == 2) & valid_point(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def _edges(ring: Column) -> Column:
    """struct(a, b) for each side, closing the ring."""
    after = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
    return F.zip_with(ring, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting, half open on the border."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans, x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(False)

    return F.aggregate(_edges(ring), F.lit(False), lambda inside, e: inside != crosses(e))


def border_metres(ring: Column, x: Column, y: Column) -> Column:
    """Distance to the ring's border, by degrees of equal length, at most FARTHEST_DEGREES."""

    def away(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / long))).otherwise(0.0)
        return F.sqrt(F.pow(x - a["x"] - t * dx, 2) + F.pow(y - a["y"] - t * dy, 2))

    nearest = F.array_min(F.transform(_edges(ring), away))
    return F.least(nearest, F.lit(FARTHEST_DEGREES)) * METRES_A_DEGREE


def ring_area(ring: Column) -> Column:
    """Area by the shoelace formula."""
    twice = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(twice) / 2


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def cells_between(low: Column, high: Column, size: float) -> Column:
    return F.sequence(cell(low, size), cell(high, size))


def precision_level(provider: Column, code: Column) -> Column:
    """exact, street, city or low from a geocoder's own code."""
    words = F.when(code.isin("exact", "number", "0", "1"), "exact").when(code.isin("street", "near", "range", "2"), "street").when(code.isin("other", "3", "4"), "city")
    return F.when(provider.isNotNull(), F.coalesce(words, F.lit("low")))
