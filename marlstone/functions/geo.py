"""Distances on the sphere. Every result is null where a coordinate is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088  # mean radius, a fixed value


def haversine_km(lat: Column, lon: Column, to_lat: Column, to_lon: Column, decimals: int = 2) -> Column:
    """Great-circle distance in kilometres, rounded half up."""
    d_lat, d_lon = F.radians(to_lat - lat) / 2, F.radians(to_lon - lon) / 2
    a = F.sin(d_lat) * F.sin(d_lat) + F.cos(F.radians(lat)) * F.cos(F.radians(to_lat)) * F.sin(d_lon) * F.sin(d_lon)
    return F.round(2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a))), decimals)


def planar_square(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Squared distance in degrees: a cheap order for points close by."""
    return (lat - to_lat) * (lat - to_lat) + (lon - to_lon) * (lon - to_lon)


def map_link(lat: Column, lon: Column, template: str = "geo:%.6f,%.6f") -> Column:
    """A link to a place, its coordinates with six decimals."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string(template, lat, lon))


def route_link(lat: Column, lon: Column, from_lat: Column, from_lon: Column, template: str = "route:%s%.6f,%.6f", origin: str = "%.6f,%.6f;") -> Column:
    """A link to the way to a place; without a whole origin, from wherever the reader is."""
    start = F.when(from_lat.isNotNull() & from_lon.isNotNull(), F.format_string(origin, from_lat, from_lon)).otherwise("")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string(template, start, lat, lon))


def enriched(df: DataFrame, lat: str, lon: str, from_lat: Column, from_lon: Column) -> DataFrame:
    """df with map_url, route_url and distance_km: all null where the place is unknown, the distance also without an origin."""
    there = (F.col(lat), F.col(lon))
    return df.withColumns({"map_url": map_link(*there), "route_url": route_link(*there, from_lat, from_lon), "distance_km": haversine_km(*there, from_lat, from_lon)})
