"""Places on the globe: struct of latitude and longitude in radians, and elevation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in kilometres.
EARTH_KM = 6371.0


def location(lat_degrees: Column, lng_degrees: Column, elevation: Column | float = 0.0) -> Column:
    elv = F.lit(elevation) if isinstance(elevation, (int, float)) else elevation
    return F.struct(F.radians(lat_degrees).alias("lat"), F.radians(lng_degrees).alias("lng"), elv.cast("double").alias("elv"))


def haversine(a: Column, b: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance."""
    lat, lng = F.sin((b["lat"] - a["lat"]) / 2), F.sin((b["lng"] - a["lng"]) / 2)
    return 2 * radius * F.asin(F.sqrt(lat * lat + F.cos(a["lat"]) * F.cos(b["lat"]) * lng * lng))
