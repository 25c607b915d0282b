"""Numeric expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_000.0


def to_number(col: Column) -> Column:
    """Lenient cast: anything that is not a number becomes null."""
    return F.nullif(col.try_cast("double"), F.lit(float("nan")))


def clean_rating(col: Column) -> Column:
    """Round half-even, clip to 1..5, nullable int."""
    rounded = F.bround(to_number(col))
    return F.when(rounded.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(5.0), rounded)).cast("int"))


def round_to(col: Column, digits: int = 2) -> Column:
    """Half-up rounding that gives the same double on every engine (non-negative input)."""
    scale = float(10 ** digits)
    return F.floor(col * scale + 0.5).cast("double") / scale


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole in double, null for a zero whole."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in double, null for a zero whole."""
    return part.cast("double") / F.nullif(whole, F.lit(0))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(chord))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Straight-line distance in degrees."""
    return F.hypot(x2 - x1, y2 - y1)


def zoom_for_population(population: Column) -> Column:
    """Map zoom level of a city; fixed steps 800k / 200k / 50k."""
    return (
        F.when(population >= 800_000, "11z").when(population >= 200_000, "12z")
        .when(population >= 50_000, "13z").otherwise("14z")
    )


def rating_class(rating: Column) -> Column:
    """Marker colour of a rating; null and 0 count as unrated."""
    return (
        F.when(rating.isNull() | (rating == 0), "gray").when(rating >= 4, "green")
        .when(rating >= 3, "orange").otherwise("red")
    )
