"""Great-circle distance."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from dockflow.schemas import EARTH_RADIUS_M


def great_circle_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Unrounded haversine metres (for ordering; round only for display)."""
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return F.lit(EARTH_RADIUS_M) * 2 * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def whole_metres(distance: Column) -> Column:
    return F.floor(distance + 0.5).cast("int")
