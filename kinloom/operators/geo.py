"""Facilities near a point: distance, direction, kinds, first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS = 6_371_000.0
# Kinds by rank.
KINDS = {
    0: "refugee_site shelter homeless_shelter emergency_shelter assembly_point",
    1: "food_bank soup_kitchen hospital clinic centre",
    2: "doctors doctor social_facility day_centre outreach water_point community_centre drinking_water",
    3: "pharmacy police fire_station",
}


def distance(lat1, lon1, lat2, lon2) -> Column:
    """Metres on the sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """One of eight directions."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    eighth = F.pmod(F.round(F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0)) / 45), F.lit(8)).cast("int")
    return F.element_at(F.array(*map(F.lit, "N NE E SE S SW W NW".split())), eighth + 1)


def readable(m: Column) -> Column:
    return F.when(m < 1000, F.concat((F.round(m / 10) * 10).cast("int").cast("string"), F.lit(" m"))).otherwise(F.concat(F.when(m < 10000, F.format_number(m / 1000, 1)).otherwise(F.format_number(m / 1000, 0)), F.lit(" km")))


def rank_of(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for rank, names in KINDS.items():
        out = F.when(kind.isin(*names.split()), rank).otherwise(out)
    return out


def kind(tags: Column) -> Column:
    """The first tag, by priority, that names a known kind."""
    t = lambda k: F.try_element_at(tags, F.lit(k))
    tries = [F.when(t("amenity") == "refugee_site", "refugee_site"), t("emergency"), t("social_facility"), t("shelter_type"), t("amenity"), t("healthcare"), F.when(t("man_made") == "water_tap", "drinking_water")]
    return F.coalesce(*(F.when(rank_of(x).isNotNull(), x) for x in tries))


def nearby(points: DataFrame, lat: float, lon: float, metres: float = 6000, limit: int | None = 60) -> DataFrame:
    """Points ``ord, name, kind, lat, lon`` within reach by rank and distance; the first of equal points stays."""
    wide = metres / 111_000
    box = points.where((F.abs(F.col("lat") - lat) <= wide * 1.01) & (F.abs(F.pmod(F.col("lon") - lon + 540, F.lit(360.0)) - 180) * max(0.01, abs(F_cos(lat))) <= wide * 1.01))
    key = Window.partitionBy("name", F.round("lat", 4), F.round("lon", 4)).orderBy("ord")
    once = box.withColumn("_r", F.row_number().over(key)).where("_r = 1").drop("_r")
    out = once.withColumns({"distance": distance(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")), "direction": bearing(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")), "rank": rank_of(F.col("kind"))})
    out = out.where((F.col("distance") <= metres) & F.col("rank").isNotNull()).orderBy("rank", "distance", "ord")
    return out.limit(limit) if limit else out


def F_cos(degrees: float) -> float:
    import math

    return math.cos(math.radians(degrees))
