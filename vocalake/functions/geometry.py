"""Planar geometry over rings: array<struct<x, y>>, first point repeated at the end.

A region is an array of rings, each with a mark that tells holes from outer rings.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..taxonomy import LAT_RANGE, LNG_RANGE


def in_bounds(lat: Column, lng: Column) -> Column:
    return lng.between(*LNG_RANGE) & lat.between(*LAT_RANGE)


def edges(ring: Column) -> Column:
    """Consecutive point pairs as structs (a, b)."""
    count = F.size(ring)
    return F.zip_with(
        F.slice(ring, F.lit(1), count - 1), F.slice(ring, F.lit(2), count - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def bounding_box(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {
        "min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys),
    }


def closed(ring: Column) -> Column:
    """The ring with its first point repeated at the end, unless it is already."""
    first = F.get(ring, 0)
    return F.when(first == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(first)))


def all_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, lambda r: edges(r["points"])))


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def centroid(rings: Column) -> Column:
    """Area centroid by the shoelace sums of all rings; holes count negatively, whichever way a ring winds."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("area", "x", "y")])
    sums = F.transform(rings, lambda r: F.aggregate(
        edges(r["points"]), zero,
        lambda s, e: F.struct(
            (s["area"] + _cross(e)).alias("area"),
            (s["x"] + (e["a"]["x"] + e["b"]["x"]) * _cross(e)).alias("x"),
            (s["y"] + (e["a"]["y"] + e["b"]["y"]) * _cross(e)).alias("y"),
        ),
        lambda s: F.struct(s["area"], s["x"], s["y"], F.when(r["hole"], -F.signum(s["area"])).otherwise(F.signum(s["area"])).alias("sign")),
    ))
    return F.aggregate(
        sums, zero,
        lambda t, s: F.struct(*[(t[n] + s["sign"] * s[n]).alias(n) for n in ("area", "x", "y")]),
        lambda t: F.struct(*[(t[n] / F.nullif(t["area"] * 3, F.lit(0.0))).alias(n) for n in ("x", "y")]),
    )


def _crosses_ray(e: Column, x: Column, y: Column) -> Column:
    """The horizontal ray to the right of the point crosses this edge."""
    spans = (e["a"]["y"] > y) != (e["b"]["y"] > y)
    at = e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / F.nullif(
        e["b"]["y"] - e["a"]["y"], F.lit(0.0))
    return spans & (x < at)


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    turn = (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
    return (
        (turn == 0.0)
        & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"]))
        & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))
    )


def contains_point(sides: Column, x: Column, y: Column) -> Column:
    """Strict interior test over the edges of all rings: an odd number of crossings, not on a boundary."""
    crossings = F.size(F.filter(sides, lambda e: _crosses_ray(e, x, y)))
    return (crossings % 2 == 1) & ~F.exists(sides, lambda e: _on_edge(e, x, y))
