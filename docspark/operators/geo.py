"""Distances, polygons and boxes over points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import haversine, in_polygon
from .filters import resolve


def _point(df: DataFrame, field: str) -> tuple[Column, Column]:
    """(longitude, latitude) of a GeoJSON point or an array."""
    ref = resolve(df.schema, f"{field}.coordinates")
    c = ref.column if ref.column is not None else resolve(df.schema, field).column
    return F.get(c, F.lit(0)), F.get(c, F.lit(1))


def near(df: DataFrame, point: tuple[float, float], *, field: str = "location", max_distance: float | None = None, min_distance: float | None = None, tie: str | None = None) -> DataFrame:
    """Rows by distance in metres from (longitude, latitude), with ``calculatedDistance`` rounded."""
    lon, lat = _point(df, field)
    metres = haversine(lat, lon, F.lit(float(point[1])), F.lit(float(point[0])))
    df = df.withColumn("_metres", metres).where(F.col("_metres").isNotNull())
    if max_distance is not None:
        span = math.degrees(max_distance / 6_371_000) * 1.0001  # a latitude band can be pushed down
        df = df.where(lat.between(point[1] - span, point[1] + span) & (F.col("_metres") <= max_distance))
    if min_distance is not None:
        df = df.where(F.col("_metres") >= min_distance)
    order = ["_metres", tie] if tie else ["_metres"]
    return df.orderBy(*order).withColumn("calculatedDistance", F.round("_metres").cast("long")).drop("_metres")


def within_polygon(df: DataFrame, polygon: list[tuple[float, float]], *, field: str = "location") -> DataFrame:
    """Rows whose point is in a polygon of (longitude, latitude) corners."""
    lon, lat = _point(df, field)
    return df.where(in_polygon(lon, lat, polygon))


def in_box(df: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float, *, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(F.col(lat).between(min_lat, max_lat) & F.col(lon).between(min_lon, max_lon))


def nearest(df: DataFrame, at: tuple[float, float], k: int = 5, *, lat: str = "lat", lon: str = "lon", max_km: float | None = None, tie: str | None = None) -> DataFrame:
    """The k nearest rows to (latitude, longitude), with ``distanceKm``."""
    km = haversine(F.col(lat), F.col(lon), F.lit(float(at[0])), F.lit(float(at[1])), 6371.0)
    df = df.withColumn("distanceKm", km).where(F.col("distanceKm").isNotNull())
    if max_km is not None:
        df = df.where(F.col("distanceKm") <= max_km)
    return df.orderBy("distanceKm", *([tie] if tie else [])).limit(k)
