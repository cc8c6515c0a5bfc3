"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    up, across = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    chord = F.pow(F.sin(up), F.lit(2.0)) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(across), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))
