"""Regions from coordinates and city names; centres and aliases from a gazetteer."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import contains_point, in_bounds
from ..functions.numbers import planar_distance, to_number, zoom_for_population
from ..functions.text import first_truthy, fold_latin, fold_marks, format_center, strip
from ..taxonomy import CITY_REGIONS, LAT_RANGE, LNG_RANGE, REGION_ALIASES
from .columns import first_present
from .dedupe import dedupe_last

CELL_DEGREES = 1.0


def region_of_city(city: Column, fold: bool = True) -> Column:
    """Dictionary lookup on the lower-case name (without accents unless ``fold`` is off)."""
    lookup = F.create_map(*[F.lit(v) for v in chain.from_iterable(CITY_REGIONS.items())])
    name = strip(F.lower(city))
    return F.try_element_at(lookup, fold_latin(name) if fold else name)


def region_by_city(df: DataFrame, city_col: str = "city", fold: bool = True) -> DataFrame:
    return df.withColumn("region", region_of_city(F.col(city_col), fold))


def _canonical_region(name: Column) -> Column:
    out = name
    for alias, region in REGION_ALIASES.items():
        out = F.when(name == alias, F.lit(region)).otherwise(out)
    return out


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{n}`") for n, kind in df.dtypes if "map<" not in kind and kind != "variant"])


def _cell(degrees: Column) -> Column:
    return F.floor(degrees / CELL_DEGREES)


def region_cells(regions: DataFrame) -> DataFrame:
    """One row per grid cell that the box of an outer ring touches, with the cell's regions in file order."""
    def span(low, high):
        return F.sequence(_cell(low), _cell(high))

    touched = F.array_distinct(F.flatten(F.transform("boxes", lambda box: F.flatten(F.transform(
        span(box["min_x"], box["max_x"]),
        lambda x: F.transform(span(box["min_y"], box["max_y"]), lambda y: F.struct(x.alias("x"), y.alias("y"))),
    )))))
    cells = regions.withColumn("cell", F.explode(touched)).withColumns({
        "cell_x": F.col("cell")["x"], "cell_y": F.col("cell")["y"]})
    candidate = F.struct("region_order", "region", "edges", "min_x", "max_x", "min_y", "max_y")
    return cells.groupBy("cell_x", "cell_y").agg(F.sort_array(F.collect_list(candidate)).alias("candidates"))


def center_cells(regions: DataFrame) -> DataFrame:
    """One row per grid cell with the centroids that can be nearest to some point of the cell.

    A centroid is left out if it is farther from the whole cell than another one is at most. Only
    regions and cells meet here; the number of cells is fixed by the bounds of valid coordinates.
    """
    def cells(bounds):
        return F.explode(F.sequence(*[F.lit(int(v // CELL_DEGREES)).cast("long") for v in bounds]))

    grid = regions.select("region_order", "region", "center", cells(LNG_RANGE).alias("cell_x")).withColumn(
        "cell_y", cells(LAT_RANGE))

    def gaps(axis, cell):
        low = F.col(cell) * CELL_DEGREES
        place = F.col("center")[axis]
        inside = F.greatest(low - place, place - low - CELL_DEGREES, F.lit(0.0))
        return inside, F.greatest(F.abs(place - low), F.abs(place - low - CELL_DEGREES))

    (near_x, far_x), (near_y, far_y) = gaps("x", "cell_x"), gaps("y", "cell_y")
    grid = grid.withColumns({"_near": F.hypot(near_x, near_y), "_far": F.hypot(far_x, far_y)})
    least = grid.groupBy("cell_x", "cell_y").agg((F.min("_far") + 1e-9).alias("_least"))
    possible = grid.join(least, ["cell_x", "cell_y"]).filter("_near <= _least")
    return possible.groupBy("cell_x", "cell_y").agg(
        F.collect_list(F.struct("region_order", "region", "center")).alias("centers"))


def _nearest(centers: Column, lat: Column, lng: Column) -> Column:
    """Name of the closest centroid in planar degrees; the first polygon wins a tie."""
    distances = F.transform(centers, lambda c: F.struct(
        planar_distance(lng, lat, c["center"]["x"], c["center"]["y"]).alias("distance"), c["region_order"], c["region"],
    ))
    return F.array_min(distances)["region"]


def region_by_point(
    df: DataFrame, regions: DataFrame, lat_col: str = "lat", lng_col: str = "lng", nearest: bool = True
) -> DataFrame:
    """Add ``region``: the first region that contains the point, else the nearest centroid.

    A point inside a hole lies outside; any part of a multi-part region counts.

    Points meet polygons through an equi-join on a one-degree grid cell; a cell carries its
    few candidate polygons and nearest centroids as arrays, so no point is ever duplicated or
    regrouped. The cells are few hundred rows, broadcast while they are small; otherwise the
    adaptive planner splits a hot cell. Rows with missing or out-of-bounds coordinates get null;
    their join key is a hash that meets no cell, so they are spread.
    """
    lat, lng = F.col("_lat"), F.col("_lng")
    usable = F.coalesce(in_bounds(lat, lng), F.lit(False))
    points = df.withColumns({"_lat": to_number(F.col(lat_col)), "_lng": to_number(F.col(lng_col))}).withColumns({
        "cell_x": F.when(usable, _cell(lng)).otherwise(F.shiftright(_row_hash(df), 1)),
        "cell_y": F.when(usable, _cell(lat)),
    })
    cells = region_cells(regions)
    if nearest:
        cells = center_cells(regions).join(cells, ["cell_x", "cell_y"], "left")
    located = points.join(cells, ["cell_x", "cell_y"], "left")
    inside = F.filter(
        F.col("candidates"),
        lambda c: lng.between(c["min_x"], c["max_x"]) & lat.between(c["min_y"], c["max_y"])
        & contains_point(c["edges"], lng, lat),
    )
    region = F.get(inside, 0)["region"]
    if nearest:
        region = F.coalesce(region, _nearest(F.col("centers"), lat, lng))
    kept = [c for c in df.columns if c != "region"]
    return located.select(*kept, F.when(usable, _canonical_region(region)).alias("region"))


def add_region(df: DataFrame, regions: DataFrame, fold: bool = True) -> DataFrame:
    """Polygon, then nearest centroid, then the city dictionary for rows without usable coordinates."""
    lat_col = first_present(df, ("lat", "latitude"))
    lng_col = first_present(df, ("lng", "longitude", "lon"))
    if not lat_col or not lng_col:
        raise ValueError(f"no latitude/longitude column among {df.columns}")
    located = region_by_point(df, regions, lat_col, lng_col)
    if "city" not in df.columns:
        return located
    return located.withColumn("region", F.coalesce("region", region_of_city(F.col("city"), fold)))


def _gazetteer_cities(gazetteer: DataFrame, include_towns: bool, order: Column) -> DataFrame:
    """Eligible entries with their alias set and canonical name."""
    kinds = ["city", "town"] if include_towns else ["city"]
    other = F.col("other_names")
    texts = F.concat(
        F.array("name"), F.coalesce(F.map_values(other), F.array().cast("array<string>")), F.array("address.city"))
    aliases = F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & (t != "")))
    preferred = F.coalesce(other["name:fr"], other["name:en"], F.col("name"))
    return (
        gazetteer.filter(
            (F.col("address.country_code") == "ma")
            & first_truthy(F.col("type"), F.col("inferred_type")).isin(kinds) & (F.size("location") == 2))
        .withColumns({
            "_entry": order,
            "aliases": aliases,
            "canonical": F.coalesce(F.nullif(preferred, F.lit("")), F.array_min(aliases)),
        })
        .filter(F.col("canonical").isNotNull())
    )


def city_centers(gazetteer: DataFrame, order: Column, include_towns: bool = False) -> DataFrame:
    """(key = city, value = ``@lat,lng,zoom``); of several entries for a city the last in ``order`` wins."""
    cities = _gazetteer_cities(gazetteer, include_towns, order)
    center = format_center(
        F.get("location", 1), F.get("location", 0), zoom_for_population(F.col("population")))
    rows = cities.select(F.col("canonical").alias("key"), center.alias("value"), "_entry")
    return dedupe_last(rows, ["key"], ["_entry"]).drop("_entry")


def city_aliases(gazetteer: DataFrame, order: Column, include_towns: bool = False) -> DataFrame:
    """(key = folded alias, value = city); of several entries for an alias the last in ``order`` wins."""
    cities = _gazetteer_cities(gazetteer, include_towns, order)
    rows = cities.select(F.explode("aliases").alias("alias"), F.col("canonical").alias("value"), "_entry")
    rows = rows.select(fold_marks(F.col("alias"), exact=True).alias("key"), "value", "_entry")
    return dedupe_last(rows, ["key"], ["_entry"]).drop("_entry")
