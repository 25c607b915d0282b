"""Region polygons."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geometry import all_edges, bounding_box, centroid, closed
from ..functions.text import first_truthy

# The depth of coordinates depends on the type, so they are kept as text until it is known.
SHAPE = "type: string, coordinates: string"
FEATURE_COLLECTION = f"""
    features array<struct<
        properties: map<string, string>,
        geometry: struct<{SHAPE}, geometries: array<struct<{SHAPE}>>>>>
"""
RING = "array<struct<x: double, y: double>>"
POLYGON = "array<array<array<double>>>"


def describe_regions(polygons: DataFrame) -> DataFrame:
    """Add edges, boxes of the outer rings, bounding box and centroid to region rows.

    Rows hold ``region_order, region`` and either ``rings`` (points and a hole mark each) or a single ``ring``.
    """
    if "rings" not in polygons.columns:
        only = F.struct(F.lit(False).alias("hole"), closed(F.col("ring")).alias("points"))
        polygons = polygons.withColumn("rings", F.array(only))
    rings = F.col("rings")
    outer = F.filter(rings, lambda r: ~r["hole"])
    boxes = F.transform(outer, lambda r: F.struct(*[c.alias(n) for n, c in bounding_box(r["points"]).items()]))
    points = F.flatten(rings["points"])
    return polygons.withColumns({
        **bounding_box(points), "boxes": boxes, "edges": all_edges(rings), "center": centroid(rings),
    })


def _polygons(shape: Column) -> Column:
    """The polygons of one geometry; other types than polygons have none."""
    text = shape["coordinates"]
    return (
        F.when(shape["type"] == "Polygon", F.array(F.from_json(text, POLYGON)))
        .when(shape["type"] == "MultiPolygon", F.from_json(text, f"array<{POLYGON}>"))
        .otherwise(F.array().cast(f"array<{POLYGON}>"))
    )


def _rings(polygons: Column) -> Column:
    """Rings of four points or more with a mark; the first ring of a polygon bounds it, the others are holes."""
    marked = F.flatten(F.transform(
        F.filter(polygons, lambda p: p.isNotNull()),
        lambda polygon: F.transform(polygon, lambda ring, at: F.struct(
            (at > 0).alias("hole"),
            closed(F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("points"),
        )),
    ))
    return F.filter(marked, lambda r: F.size(r["points"]) > 3)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a GeoJSON collection: polygons, multi-part polygons and collections of them, with holes.

    Unnamed features and those without an outer ring are dropped; ``region_order`` is the place in the file.
    """
    features = (
        spark.read.schema(FEATURE_COLLECTION).option("multiLine", True).json(path)
        .select(F.posexplode("features").alias("region_order", "f"))
    )
    props, geometry = F.col("f")["properties"], F.col("f")["geometry"]
    parts = F.flatten(F.transform(
        F.coalesce(geometry["geometries"], F.array().cast(f"array<struct<{SHAPE}>>")), _polygons))
    polygons = features.select(
        "region_order",
        first_truthy(props["name"], props["NAME_1"], props["NAME"]).alias("region"),
        _rings(F.concat(_polygons(geometry), parts)).alias("rings"),
    )
    return describe_regions(polygons.filter(
        F.col("region").isNotNull() & F.exists("rings", lambda r: ~r["hole"])))
