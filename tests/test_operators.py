"""Operators on small fixtures: null rules, skew, failures, idempotence, plan shapes."""
import json
import sys
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vocalake.functions import text
from vocalake.operators import columns, dedupe, mutate, sketches
from vocalake.operators.classify import _answers, classify, classify_by_rules
from vocalake.operators.dedupe import dedupe_first
from vocalake.operators.entity import resolve_ids
from vocalake.operators.geo import add_region, region_by_city, region_by_point
from vocalake.operators.ids import assign_ids
from vocalake.operators.joins import with_sentiment
from vocalake.operators.normalize import normalize_reviews
from vocalake.operators.ranking import global_rank
from vocalake.plans import catalogue, migration, store
from vocalake.plans.named import run_query
from vocalake.plans.rollups import build_aggregates, rollup_table
from vocalake.schemas import PLACES, REVIEWS
from vocalake.session import configure, ensure_checkpoint_dir
from vocalake.sinks import writers
from vocalake.sources import documents, tabular
from vocalake.sources.regions import describe_regions, read_regions
from vocalake.streaming.incremental import review_appender
from vocalake.taxonomy import CATEGORIES

NOW = datetime(2024, 1, 15, 12, 0, 0)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


# ------------------------------------------------------------------------------ skew and scale

def test_hot_keys_split_by_adaptive_join(spark):
    """Without a broadcast, a hot city is split into several tasks by the adaptive planner."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    saved = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        fact = spark.range(0, 60000, 1, 8).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
        dim = spark.range(60000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        joined = fact.join(dim, "k", "left")
        assert "skew=true" in plan_of(joined)
        assert joined.count() == 60000
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") % 5).cast("int").alias("rating"))
    writers.write_bucketed(rows, "t_reviews", "id", 4, str(tmp_path / "reviews"))
    labels = spark.range(0, 1000, 2).select(F.col("id").alias("review_id"), F.lit("Positif").alias("sentiment"))
    writers.write_bucketed(labels, "t_labels", "review_id", 4, str(tmp_path / "labels"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = with_sentiment(spark.table("t_reviews"), spark.table("t_labels"))
        assert "Exchange" not in plan_of(joined) and joined.filter("sentiment IS NOT NULL").count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "reviews")
    spark.range(10).select(
        "id", F.lit("a").alias("business"), F.lit("x").alias("city"), F.lit("p").alias("place_id"),
        F.lit(3).alias("rating"), F.lit("long text").alias("text")).write.parquet(path)
    labels = spark.range(10).select(F.col("id").alias("review_id"), F.lit("Positif").alias("sentiment"))
    plan = catalogue.business_stats(spark.read.parquet(path), labels, "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(business,a)" in plan and "text" not in plan


def test_dedupe_is_a_partial_aggregate(spark):
    rows = spark.createDataFrame(
        [("a", None, 2, "late"), ("a", None, 1, "early"), ("b", "x", 1, "only")], "k string, l string, o int, v string")
    first = dedupe_first(rows, ["k", "l"], ["o"])
    assert sorted((r.k, r.v) for r in first.collect()) == [("a", "early"), ("b", "only")]
    assert "partial_min_by" in plan_of(first) and "Window" not in plan_of(first)


def test_assign_ids_dense_and_ordered(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("key"))
    got = assign_ids(rows, ["key"], after=10).collect()
    assert sorted((r.key, r.id) for r in got) == [(i, i + 11) for i in range(5000)]


def test_global_rank_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", 4.5), ("b", 4.5), ("c", 5.0), ("d", None), ("e", 0.0)], "n string, v double")
    assert {r.n: r.rank for r in global_rank(rows, "v", 0.0, 5.0).collect()} == {"c": 1, "a": 2, "b": 2, "e": 4, "d": 5}


# ------------------------------------------------------------------------------ columns

def test_detect_column(spark):
    df = spark.createDataFrame([], "`Place ID` string, Bank_Name string, ville string")
    assert columns.detect_column(df, tabular.PLACE_ID_NAMES, required=True) == "Place ID"
    assert columns.detect_column(df, tabular.BUSINESS_NAMES) == "Bank_Name"
    assert columns.detect_column(df, ("city",)) is None
    with pytest.raises(ValueError):
        columns.detect_column(df, ("city",), required=True)


def test_keep_valid(spark):
    df = spark.createDataFrame([("1", "x", "4")], "id string, unknown string, rating string")
    kept = columns.keep_valid(df, REVIEWS)
    assert kept.dtypes == [("id", "bigint"), ("rating", "int")] and tuple(kept.head()) == (1, 4)


def test_category_columns_by_keyword(spark):
    df = spark.createDataFrame([], "`Accueil froid` int, `attente longue` int, hors_sujet int, id int")
    assert columns.category_columns(df, ()) == (["Accueil froid"], ["attente longue"], ["hors_sujet"])


def test_normalize_accepts_other_names(spark):
    raw = spark.createDataFrame(
        [("4.5", "33.5", "bad", "  ok ", "il y a 2 ans")],
        "review_rating string, latitude string, longitude string, review_snippet string, review_date string")
    row = normalize_reviews(raw, NOW).head()
    assert (row.rating, row.latitude, row.longitude, row.review_snippet) == (4, 33.5, None, "ok")
    assert row.month == date(2022, 1, 1)


# ------------------------------------------------------------------------------ regions

def test_region_by_city(spark):
    rows = spark.createDataFrame([("Oujda ",), ("Atlantis",), (None,), ("Fès",)], "city string")
    assert [r.region for r in region_by_city(rows).collect()] == ["L'Oriental", None, None, "Fès-Meknès"]
    assert region_by_city(rows, fold=False).collect()[3].region is None


def test_hot_cell_and_nearest_against_all_centres(spark):
    """Most points in one cell; each gets the region a search over all centres and polygons gives."""
    import math

    boxes = [(i, f"r{i}", -16.5 + (i * 37 % 29) / 2, 21.3 + (i * 53 % 27) / 2) for i in range(60)]
    regions = describe_regions(spark.createDataFrame(
        [(i, n, [(x, y), (x + .3, y), (x + .3, y + .3), (x, y + .3), (x, y)]) for i, n, x, y in boxes],
        "region_order int, region string, ring array<struct<x: double, y: double>>"))
    points = [(i, 30.0 + (i % 97) / 100, -9.0 + (i % 89) / 100) if i % 10 else (i, 21 + i * 7 % 15 + .37, -17 + i * 11 % 16 + .21) for i in range(900)]
    points += [(1000 + i, None, 5.0) for i in range(50)]
    got = {r.id: r.region for r in region_by_point(
        spark.createDataFrame(points, "id int, lat double, lng double"), regions).collect()}
    assert len(got) == len(points)
    for i, lat, lng in points:
        if lat is None:
            assert got[i] is None
            continue
        inside = [n for _, n, x, y in boxes if x < lng < x + .3 and y < lat < y + .3]
        nearest = min((round(math.hypot(lng - x - .15, lat - y - .15), 9), o, n) for o, n, x, y in boxes)[2]
        assert got[i] == (inside[0] if inside else nearest)


def test_add_region_two_polygons(spark, tmp_path):
    def feature(name, x0, x1):
        ring = [[x0, 33.0], [x1, 33.0], [x1, 34.0], [x0, 34.0], [x0, 33.0]]
        return '{"type":"Feature","properties":{"%s":"%s"},"geometry":{"type":"Polygon","coordinates":[%s]}}' % (
            "name" if x0 < -7 else "NAME_1", name, ring)

    path = tmp_path / "regions.geojson"
    path.write_text('{"type":"FeatureCollection","features":[%s,%s,{"type":"Feature","properties":{},"geometry":null}]}' % (
        feature("West", -8.0, -7.0), feature("East", -7.0, -6.0)))
    regions = read_regions(spark, str(path))
    assert [(r.region, r.center.x, r.center.y) for r in regions.collect()] == [("West", -7.5, 33.5), ("East", -6.5, 33.5)]
    points = spark.createDataFrame(
        [(1, "33.5", "-7.2", None), (2, "33.5", "-6.8", None), (3, "33.5", "-7.0", None), (4, "30.0", "-6.2", None),
         (5, None, "-7", "Casablanca"), (6, "60", "-7", "casa"), (7, "x", "y", "nowhere")],
        "id int, lat string, lng string, city string")
    got = {r.id: r.region for r in add_region(points, regions).collect()}
    # Point 3 lies on the shared edge, inside neither; the tie of the centroids goes to the first.
    assert got == {1: "West", 2: "East", 3: "West", 4: "East", 5: "Casablanca-Settat", 6: "Casablanca-Settat", 7: None}
    with pytest.raises(ValueError):
        add_region(spark.createDataFrame([], "city string"), regions)


def test_regions_of_several_parts_with_holes(spark, tmp_path):
    def box(x0, y0, x1, y1):
        return [[x0, y0, 9.0], [x1, y0, 9.0], [x1, y1, 9.0], [x0, y1, 9.0], [x0, y0, 9.0]]

    shapes = {
        "Parts": {"type": "MultiPolygon", "coordinates": [
            [box(-8, 30, -7, 31), box(-7.75, 30.25, -7.25, 30.75)], [box(-7.6, 30.4, -7.4, 30.6)], [box(-3, 34, -2.5, 34.5)]]},
        "Holed": {"type": "Polygon", "coordinates": [box(-6, 30, -5, 31), box(-5.9, 30.1, -5.4, 30.6)[::-1]]},
        "Open": {"type": "Polygon", "coordinates": [box(-4, 30, -3, 31)[:-1]]},
        "Mixed": {"type": "GeometryCollection", "geometries": [
            {"type": "Point", "coordinates": [-10, 25]}, {"type": "Polygon", "coordinates": [box(-10, 24, -9, 25)]}]},
        "Point": {"type": "Point", "coordinates": [-9, 22]}, "Empty": {"type": "MultiPolygon", "coordinates": []},
        "Bad": {"type": "Polygon", "coordinates": [[[-9, 22], [-8, 22]]]}, "None": None,
    }
    features = [{"type": "Feature", "properties": {"name": n}, "geometry": g} for n, g in shapes.items()]
    path = tmp_path / "parts.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    regions = read_regions(spark, str(path))
    found = {r.region: (r.region_order, round(r.center.x, 9), round(r.center.y, 9)) for r in regions.collect()}
    areas = [(1.0, -7.5, 30.5), (-.25, -7.5, 30.5), (.04, -7.5, 30.5), (.25, -2.75, 34.25)]
    total = sum(a for a, _, _ in areas)
    assert found == {
        "Parts": (0, *(round(sum(a[0] * a[i] for a in areas) / total, 9) for i in (1, 2))),
        "Holed": (1, round((-5.5 + .25 * 5.65) / .75, 9), round((30.5 - .25 * 30.35) / .75, 9)),
        "Open": (2, -3.5, 30.5), "Mixed": (3, -9.5, 24.5),
    }
    points = [
        (1, 30.1, -7.9, "Parts"), (2, 30.3, -7.7, None), (3, 30.5, -7.5, "Parts"), (4, 34.2, -2.8, "Parts"), (5, 30.3, -5.6, None),
        (6, 30.8, -5.2, "Holed"), (7, 30.1, -5.65, None), (8, 30.5, -3.5, "Open"), (9, 24.5, -9.5, "Mixed"), (10, 30.5, -6.5, None),
    ]
    rows = spark.createDataFrame([p[:3] for p in points], "id int, lat double, lng double")
    got = {r.id: r.region for r in region_by_point(rows, regions, nearest=False).collect()}
    assert got == {p[0]: p[3] for p in points}


# ------------------------------------------------------------------------------ rollups

def test_rollups(spark):
    df = spark.createDataFrame(
        [("A", "x", 5, "Positif"), ("A", None, 3, "Négatif"), ("B", "x", None, None)],
        "business string, city string, rating int, sentiment string")
    rollups = build_aggregates(df)
    assert set(rollups) == {"by_business", "by_city", "by_business_city"}
    by_business = {r.business_id: r for r in rollups["by_business"].collect()}
    assert (by_business["A"].review_count, by_business["A"].avg_rating, by_business["A"].negative_share) == (2, 4.0, 0.5)
    assert by_business["B"].positive_share is None
    assert {r.city for r in rollups["by_city"].collect()} == {"x", None}
    table = rollup_table(df).groupBy("rollup").agg(F.sum("review_count").alias("n")).collect()
    assert {r.rollup: r.n for r in table} == {"by_business": 3, "by_city": 3, "by_business_city": 3}
    with pytest.raises(ValueError):
        build_aggregates(df.limit(0))
    with pytest.raises(ValueError):
        build_aggregates(df.drop("rating"))


def test_rollup_sentiment_from_category(spark):
    df = spark.createDataFrame([("A", 4, "Autre (positif)"), ("A", 2, "Autre (négatif)")], "bank string, rating int, category string")
    row = build_aggregates(df)["by_business"].head()
    assert (row.positive_share, row.negative_share) == (0.5, 0.5)


# ------------------------------------------------------------------------------ catalogue

@pytest.fixture(scope="module")
def tiny(spark):
    reviews = spark.createDataFrame(
        [(i, f"p{i % 3}", "A" if i < 12 else "B", "x", 5 if i % 2 else 3, date(2024, 1, 1 + i)) for i in range(15)],
        "id long, place_id string, business string, city string, rating int, review_date_parsed date")
    labels = spark.createDataFrame([(0, "Positif"), (1, "Négatif")], "review_id long, sentiment string")
    return reviews, labels


def test_position_of_unknown_and_small_business(spark, tiny):
    assert catalogue.competitive_position(*tiny, "nobody").count() == 0
    small = catalogue.competitive_position(*tiny, "B").head()
    assert small.rating_rank is None and small.total_businesses is None and small.avg_rating is not None
    large = catalogue.competitive_position(*tiny, "A").head()
    assert (large.rating_rank, large.total_businesses, large.positive_rate) == (1, 2, 8.33)


def test_unknown_metric_and_granularity_fall_back(spark, tiny):
    assert catalogue.business_ranking(*tiny, metric="nonsense").columns == ["business", "avg_rating", "review_count"]
    assert catalogue.temporal_trends(*tiny, granularity="nonsense").head().period == date(2024, 1, 1)


def test_unknown_query_name(spark, tiny):
    with pytest.raises(ValueError):
        run_query({"reviews": tiny[0], "classifications": tiny[1]}, "nonsense")


# ------------------------------------------------------------------------------ tables

def test_null_keys_never_conflict(spark):
    target = columns.complete(spark.createDataFrame([(1, "p", None, "t")], "id long, place_id string, author string, text string"), REVIEWS)
    new = spark.createDataFrame([("p", None, "t", 1), ("p", "a", "t", 2), ("p", "a", "t", 3)], "place_id string, author string, text string, line int")
    merged = mutate.insert_reviews(target, new, NOW, ["line"])
    assert sorted((r.id, r.author) for r in merged.collect()) == [(1, None), (2, None), (3, "a")]


def test_upsert_keeps_untouched_columns(spark):
    target = columns.complete(spark.createDataFrame([("p", "old", "0600")], "place_id string, name string, phone string"), PLACES)
    updates = spark.createDataFrame([("p", "new", None), ("q", "other", "0700")], "place_id string, name string, phone string")
    got = {r.place_id: (r.name, r.phone) for r in mutate.upsert_places(target, updates, NOW).collect()}
    assert got == {"p": ("new", "0600"), "q": ("other", "0700")}


def test_resolution_reuses_ids_found_earlier(spark):
    places = spark.createDataFrame(
        [(1, "", "n1"), (2, "ChIJa", "n1"), (3, None, "n1"), (4, "ChIJb", None), (5, "bad", None), (6, None, "n2")],
        "o int, place_id string, data_id string")
    cache = spark.createDataFrame([("n2", "ChIJc")], "key string, value string")
    out, extended = resolve_ids(places, cache, ["o"])
    assert [(r.o, r.canonical_place_id, r.resolve_status) for r in out.orderBy("o").collect()] == [
        (1, None, "unresolved"), (2, "ChIJa", "already_canonical"), (3, "ChIJa", "cache"),
        (4, "ChIJb", "already_canonical"), (5, None, "unresolved"), (6, "ChIJc", "cache")]
    assert {(r.key, r.value) for r in extended.collect()} == {("n2", "ChIJc"), ("n1", "ChIJa"), ("ChIJb", "ChIJb")}


def test_store_versions_and_batches(spark, tmp_path):
    base = str(tmp_path / "store")
    store.init_catalog(spark, base)
    rows = spark.createDataFrame([(1, "p"), (2, "q")], "id long, place_id string")
    store.append_rows(rows, base, "reviews")
    third = spark.createDataFrame([(3, "p")], rows.schema)
    store.append_rows(third, base, "reviews", writer="stream", batch=0)
    store.append_rows(third, base, "reviews", writer="stream", batch=0)
    assert store.load_table(spark, base, "reviews").count() == 3
    assert store.load_table(spark, base, "reviews", writer="stream", before_batch=0).count() == 2
    store.save_table(rows.limit(0), base, "reviews")
    assert store.load_table(spark, base, "reviews").count() == 0
    store.append_rows(rows, base, "reviews")
    assert store.sql(spark, base, "SELECT count(*) AS n FROM v_reviews_full").head().n == 2


def test_failed_write_leaves_the_table(spark, tmp_path):
    base = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "p"), (2, "q")], "id long, place_id string")
    store.append_rows(rows, base, "reviews")
    broken = spark.createDataFrame([(3, "r")], rows.schema).withColumn("place_id", F.raise_error(F.lit("lost")).cast("string"))
    for write in (store.append_rows, store.save_table):
        with pytest.raises(Exception, match="lost"):
            write(broken, base, "reviews")
    assert sorted(r.id for r in store.load_table(spark, base, "reviews").collect()) == [1, 2]
    store.save_table(store.load_table(spark, base, "reviews").filter("id = 2"), base, "reviews")
    assert [r.id for r in store.load_table(spark, base, "reviews").collect()] == [2]


def test_store_keeps_one_row_of_a_hot_key(spark, tmp_path):
    """Equal and different rows of one key: one stays, all others are kept as rejects."""
    base = str(tmp_path / "store")
    rows = spark.range(0, 4000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("long").alias("id"),
        F.concat(F.lit("p"), F.col("id") % 2).alias("place_id"))
    store.append_rows(rows, base, "reviews", writer="stream", batch=0)
    ids = [r.id for r in store.load_table(spark, base, "reviews").collect()]
    assert len(ids) == len(set(ids)) == rows.select("id").distinct().count()
    assert store.rejected_rows(spark, base, "reviews").count() == rows.count() - len(ids)
    store.append_rows(rows, base, "reviews", writer="stream", batch=0)
    assert store.load_table(spark, base, "reviews").count() == len(ids)
    assert store.rejected_rows(spark, base, "reviews").count() == rows.count() - len(ids)


def test_statistics_over_bucketed_store_have_no_exchange_below_the_join(spark, tmp_path):
    base = str(tmp_path / "store")
    store.create_tables(spark, base)
    ids = spark.range(500)
    store.append_rows(ids.select("id", F.concat(F.lit("p"), F.col("id") % 7).alias("place_id"),
                                 F.concat(F.lit("b"), F.col("id") % 3).alias("business")), base, "reviews")
    store.append_rows(ids.filter("id % 2 = 0").select("id", F.col("id").alias("review_id"), F.lit("Positif").alias("sentiment")),
                      base, "classifications")
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = store.save_bucketed(spark, base, 4, "bucket_test")
        stats = catalogue.business_stats(frames["reviews"], frames["classifications"])
        plan = stats._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        plain = catalogue.business_stats(store.load_table(spark, base, "reviews"), store.load_table(spark, base, "classifications"))
        assert "SortMergeJoin" in plan and "Exchange" not in plan[plan.index("SortMergeJoin"):]
        assert sorted(stats.collect()) == sorted(plain.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
        for table in store.BUCKETED:
            spark.sql(f"DROP TABLE IF EXISTS bucket_test_{table}")


def test_store_reads_only_the_wanted_months(spark, tmp_path):
    base = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "p", "2024-01-31"), (2, "p", "2024-03-01"), (3, "q", None)], "id long, place_id string, d string")
    store.append_rows(rows.withColumn("review_date_parsed", F.to_date("d")), base, "reviews")
    recent = store.load_table(spark, base, "reviews", since=date(2024, 2, 10))
    assert [r.id for r in recent.collect()] == [2] and store.load_table(spark, base, "reviews").count() == 3
    assert "PartitionFilters: [isnotnull(review_month" in recent._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_store_keeps_rejects_apart(spark, tmp_path):
    base = str(tmp_path / "store")
    reviews = spark.createDataFrame(
        [(1, "p", 5), (2, "q", 99), (3, None, 4), (1, "p", 4), (4, "r", None)], "id long, place_id string, rating int")
    store.append_rows(reviews, base, "reviews")
    store.append_rows(spark.createDataFrame([(4, "z"), (5, "z")], "id long, place_id string"), base, "reviews")
    assert sorted(r.id for r in store.load_table(spark, base, "reviews").collect()) == [1, 4, 5]
    assert sorted(r.id for r in store.rejected_rows(spark, base, "reviews").collect()) == [1, 2, 3, 4]
    labels = spark.createDataFrame([(1, 1, "Positif"), (2, 1, "Neutre"), (3, 5, "Bogus")], "id long, review_id long, sentiment string")
    store.append_rows(labels, base, "classifications")
    assert store.load_table(spark, base, "classifications").count() == 1
    store.register_views(spark, base)
    assert spark.table("v_reviews_full").count() == 3


def test_replayed_batch_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "store")
    store.init_catalog(spark, base)
    handle = review_appender(spark, base, NOW, ["line"])
    first = spark.createDataFrame([("p", "a", "x", 1), ("p", None, "y", 2)], "place_id string, author string, text string, line int")
    second = spark.createDataFrame([("p", "a", "x", 3), ("q", None, "y", 4)], first.schema)

    def stored():
        return sorted((r.id, r.place_id, r.text) for r in store.load_table(spark, base, "reviews").collect())

    handle(first, 0)
    handle(second, 1)
    once = stored()
    handle(second, 1)
    assert stored() == once == [(1, "p", "x"), (2, "p", "y"), (4, "q", "y")]


def test_duplicate_updates_do_not_multiply_rows(spark):
    target = columns.complete(spark.createDataFrame([("p", "old")], "place_id string, name string"), PLACES)
    updates = spark.createDataFrame([("p", "b"), ("p", "a"), ("q", "c"), ("q", "d")], "place_id string, name string")
    got = sorted((r.place_id, r.name) for r in mutate.upsert_places(target, updates, NOW).collect())
    assert got == [("p", "b"), ("q", "d")]


def test_checkpoint_folder(spark, monkeypatch):
    """The session's folder is used; without one only a local session may take its own."""
    class Context:
        master, chosen = "spark://cluster", None

        def getCheckpointDir(self):
            return self.chosen

        def setCheckpointDir(self, path):
            self.chosen = path

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "s3a://shared/checkpoints"}
    ensure_checkpoint_dir(Session())
    assert Session.sparkContext.chosen == "s3a://shared/checkpoints"


# ------------------------------------------------------------------------------ sources and sinks

def test_locations_file(spark, tmp_path):
    path = tmp_path / "banks.csv"
    path.write_bytes("﻿_place_id,_bank,_city\n a ,Crédit de l'Île,Aïn-Ville\n,Öko® + Söhne,Rabat\nb,Öko® + Söhne,Rabat\n".encode())
    rows = tabular.read_locations(spark, str(path)).select("_place_id", "_business", "_city").collect()
    assert [tuple(r) for r in rows] == [("a", "Crédit de l'Île", "Aïn-Ville"), ("b", "Öko® + Söhne", "Rabat")]
    assert tabular.read_locations(spark, str(path), cities=["rabat"]).count() == 1
    path.write_text("_place_id,_bank,_city\n")
    empty = tabular.read_locations(spark, str(path))
    assert empty.count() == 0 and "_place_id" in empty.columns


def test_latin1_file_with_undefined_byte(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes("id,text\n1,\x80 \x81 é\n".encode("latin-1"))
    assert tabular.read_reviews(spark, str(path)).head().text == "\x80 \x81 é"
    path.write_bytes("id,text\n1,5 € é\n".encode("cp1252"))
    assert tabular.read_reviews(spark, str(path)).head().text == "5 € é"


def test_arrival_order_follows_the_files(spark, tmp_path):
    """The second file is larger, so Spark reads it first; the first one must still win."""
    (tmp_path / "a.csv").write_text("k,v\nx,first\n")
    (tmp_path / "b.csv").write_text("k,v\n" + "".join(f"x,later {i}\n" for i in range(1000)))
    rows = tabular.read_csv(spark, str(tmp_path))
    first = dedupe_first(rows.withColumn("o", columns.file_order()), ["k"], ["o"])
    assert [r.v for r in first.collect()] == ["first"]


def test_lookup_missing_or_broken(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "good.json").write_text('{"a": "b",\n "c": "d"}')
    assert documents.read_lookup(spark, str(tmp_path / "none.json")).count() == 0
    assert documents.read_lookup(spark, str(tmp_path / "bad.json")).count() == 0
    assert {tuple(r) for r in documents.read_lookup(spark, str(tmp_path / "good.json")).collect()} == {("a", "b"), ("c", "d")}


def test_default_centers(spark, tmp_path):
    missing = str(tmp_path / "none")
    centers, aliases = documents.load_centers(spark, missing, missing, missing)
    assert centers.count() == 13 and aliases.count() == 0
    foreign = tmp_path / "foreign.json"
    foreign.write_text('{"name": "Paris", "type": "city", "address": {"country_code": "fr"}, "location": [2.3, 48.8]}\n')
    assert documents.load_centers(spark, missing, missing, str(foreign))[0].count() == 13


def test_stored_lookups_come_first(spark, tmp_path):
    (tmp_path / "centers.json").write_text('{"Fes": "@1,2,3z"}')
    (tmp_path / "aliases.json").write_text('{"fez": "Fes"}')
    centers, aliases = documents.load_centers(spark, str(tmp_path / "centers.json"), str(tmp_path / "aliases.json"))
    assert [tuple(r) for r in centers.collect()] == [("Fes", "@1,2,3z")] and aliases.count() == 1


def test_pretty_printed_bundle(spark, tmp_path):
    path = tmp_path / "bundle.json"
    path.write_text('{\n "p": [{"date": "d", "rating": 4, "snippet": "a"}, {"rating": 5}],\n "q": []\n}')
    rows = documents.read_review_bundle(spark, str(path), whole_document=True)
    assert [(r.place_id, r.position, r.rating) for r in rows.collect()] == [("p", 0, 4.0), ("p", 1, 5.0)]


def test_bundle_is_the_same_for_every_batch_size(spark, tmp_path):
    rows = spark.range(0, 100, 1, 3).select(
        F.when(F.col("id") % 10 == 0, "other").otherwise('hot "1"').alias("place_id"),
        F.format_string("%03d", "id").alias("snippet"))
    found = []
    for size in ("10", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            writers.write_review_bundle(rows, str(tmp_path / size), order=["snippet"])
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        back = documents.read_review_bundle(spark, str(tmp_path / size))
        found.append(sorted((r.place_id, r.position, r.snippet) for r in back.collect()))
    hot = [f"{i:03d}" for i in range(100) if i % 10]
    expected = [('hot "1"', i, s) for i, s in enumerate(hot)] + [("other", i, f"{i * 10:03d}") for i in range(10)]
    assert found == [sorted(expected)] * 2


# ------------------------------------------------------------------------------ classification

def fussy_scorer(batch):
    if batch["text"].str.contains("boom").any():
        raise RuntimeError("boom")
    return pd.DataFrame({
        "sentiment": "Positif", "categories": [[{"label": CATEGORIES[0], "confidence": 0.9}]] * len(batch),
        "language": "fr", "rationale": "ok",
    }, index=range(len(batch)))


def test_scorer_failure_marks_only_its_row(spark):
    rows = spark.createDataFrame(
        [(i, "boom" if i % 5 == 0 else " " if i % 7 == 0 else "bien", 5) for i in range(100)], "id int, text string, rating int")
    got = {r.id: (r.sentiment, r.categories_json) for r in classify(rows, fussy_scorer).collect()}
    for i in range(100):
        if i % 5 == 0:
            assert got[i] == ("Error", None)
        elif i % 7 == 0:
            assert got[i] == (None, None)
        else:
            assert got[i][0] == "Positif" and CATEGORIES[0] in got[i][1]


def test_scorer_sees_rows_at_most_twice():
    batch = pd.DataFrame({"text": ["boom" if i % 50 == 0 else "bien" for i in range(1000)], "rating": 5})
    seen = []

    def counting(rows):
        seen.append(len(rows))
        return fussy_scorer(rows)

    answers = _answers(counting, batch)
    assert sum(seen) == 2 * len(batch) and (answers["sentiment"] == "Error").sum() == 20

    def reporting(rows):
        seen.append(len(rows))
        return fussy_scorer(rows.assign(text="bien")).assign(error=rows["text"].eq("boom").to_numpy())

    seen.clear()
    answers = _answers(reporting, batch)
    assert seen == [len(batch)] and (answers["sentiment"] == "Error").sum() == 20
    assert answers["categories"].isna().sum() == 20


def test_rules(spark):
    rows = spark.createDataFrame(
        [("Trop de frais et une longue file d'attente", 1), ("Application fluide !", None), ("Correct", 3), ("Bravo", 5), ("", 5)],
        "text string, rating int")
    got = [(r.sentiment, r.categories_json) for r in classify_by_rules(rows).collect()]
    assert got[0][0] == "Négatif" and CATEGORIES[7] in got[0][1] and CATEGORIES[11] in got[0][1]
    assert got[1][0] == "Positif" and CATEGORIES[6] in got[1][1]
    assert got[2][0] == "Neutre" and CATEGORIES[14] in got[2][1]
    assert got[3] == ("Positif", '[{"label":"Autre (positif)","confidence":0.6}]')
    assert got[4] == (None, None)
    with pytest.raises(ValueError):
        classify_by_rules(rows.drop("text"))


def test_unreadable_ratings_count_as_zero(spark):
    rows = spark.createDataFrame([("Correct", "4.0"), ("Correct", "n/a"), ("Correct", None)], "text string, rating string")
    assert [r.sentiment for r in classify_by_rules(rows).collect()] == ["Positif", "Neutre", "Neutre"]


def test_classify_keeps_original_columns(spark):
    rows = spark.createDataFrame([(1, "bien", 5, "kept")], "id int, text string, rating int, extra string")
    assert classify(rows, fussy_scorer).columns[:4] == ["id", "text", "rating", "extra"]


# ------------------------------------------------------------------------------ keys by digest, lazy ids

def test_inserts_read_only_digests_and_ids_of_the_store(spark, tmp_path):
    base = str(tmp_path / "store")
    store.create_tables(spark, base)
    raw = spark.createDataFrame([("p", "a", f"text {i}", i) for i in range(40)] + [("p", None, "text 1", 90)],
                                "place_id string, author string, text string, line int")
    store.append_rows(mutate.new_reviews(store.load_table(spark, base, "reviews", keyed=True), raw, NOW, ["line"]), base, "reviews")
    assert "key_digest" not in store.load_table(spark, base, "reviews").columns
    more = spark.createDataFrame([("p", "a", f"text {i}", i) for i in range(30, 50)] + [("p", None, "text 1", 91)], raw.schema)
    fresh = mutate.new_reviews(store.load_table(spark, base, "reviews", keyed=True), more, NOW, ["line"])
    plan = plan_of(fresh)
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("text" not in line.split("ReadSchema")[1] for line in scans)
    # Ids follow the batch's own order, known rows included; a null in the key never conflicts.
    assert {(r.id, r.text, r.author) for r in fresh.collect()} == {
        *((41 + i - 29, f"text {i}", "a") for i in range(40, 50)), (62, "text 1", None)}


def test_key_digest_tells_nulls_and_borders_apart(spark):
    rows = spark.createDataFrame(
        [(None, ""), ("", None), ("", ""), ("a", "bc"), ("ab", "c"), ("-", ""), ("1:a", ""), (None, None)], "a string, b string")
    assert rows.select(dedupe.key_digest("a", "b")).distinct().count() == 8


def test_dedupe_by_digest_keeps_long_keys_out_of_exchanges(spark, tmp_path):
    rng = [(i, "x" * (i % 5), None if i % 3 else "l", i * 7919 % 1000) for i in range(1000)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rng, "v long, t string, l string, o long").write.parquet(path)
    rows = spark.read.parquet(path)
    late = dedupe_first(rows, ["t", "l"], ["o"], total=True)
    plan = plan_of(late)
    assert "SortAggregate" not in plan and "hashpartitioning(t" not in plan
    assert sorted(map(str, late.collect())) == sorted(map(str, dedupe_first(rows, ["t", "l"], ["o"]).collect()))
    two = dedupe_first(rows, ["t", "l"], ["l", "o"], total=True)
    assert sorted(map(str, two.collect())) == sorted(map(str, dedupe_first(rows, ["t", "l"], ["l", "o"]).collect()))


def test_ids_are_lazy_and_follow_any_order(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    def refused(*_, **__):
        raise AssertionError("no checkpoint while a plan is built")

    monkeypatch.setattr(Classic, "checkpoint", refused)
    monkeypatch.setattr(Classic, "localCheckpoint", refused)
    rows = spark.range(0, 3000, 1, 5).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), (F.col("id") * 31 % 50).cast("string"))).alias("name"),
        F.timestamp_seconds(F.col("id") * 7919 % 3001).alias("at"), F.struct((F.col("id") % 4).alias("p"), "id").alias("place"))
    for order in (["name", "at"], ["at"], ["place"], ["name", "place"]):
        got = assign_ids(rows, order, after=5)
        expected = rows.coalesce(1).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id() + 6)
        columns_ = ["id", *rows.columns]
        assert sorted(map(str, got.select(*columns_).collect())) == sorted(map(str, expected.select(*columns_).collect()))
        assert sorted(map(str, got.collect())) == sorted(map(str, got.collect()))
    assert assign_ids(rows.limit(0), ["at"]).count() == 0


def test_latest_run_is_found_by_folder_names(spark, tmp_path):
    base = str(tmp_path / "runs")
    with pytest.raises(FileNotFoundError):
        writers.read_latest(spark, base)
    for day in (1, 2):
        writers.write_run(spark.range(day), base, date(2024, 5, day))
    (tmp_path / "runs" / "run_date=20240503" / "_temporary").mkdir(parents=True)
    newest = writers.read_latest(spark, base)
    assert newest.count() == 2
    assert all("run_date=20240502" in f for f in newest.inputFiles()) and "Aggregate" not in plan_of(newest)


def test_sketches_unite_without_counting_again(spark):
    rows = spark.range(20_000).select((F.col("id") % 5).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 7_000).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(9, 9, None)], rows.schema))
    cells = sketches.distinct_sketches(rows, ["a", "b"], ["v"])
    assert abs(sketches.estimated(sketches.unite(cells, [])).head().v - 7_000) < 210
    per_a = {r.a: r.v for r in sketches.estimated(sketches.unite(cells, ["a"])).collect()}
    exact = {r.a: r.n for r in rows.groupBy("a").agg(F.count_distinct("v").alias("n")).collect()}
    assert per_a.keys() == exact.keys() and all(abs(per_a[a] - n) <= 0.03 * n for a, n in exact.items())


def test_missing_folders_are_skipped_but_other_errors_are_not(spark, tmp_path):
    assert tabular.latest_snapshot(spark, [str(tmp_path / "none")]) is None
    with pytest.raises(Exception):
        tabular.latest_snapshot(spark, ["nosuchscheme://x/y"])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("encoding", ["utf-8", "cp1252"])
def test_csv_with_line_breaks_in_fields_splits(spark, tmp_path, end, encoding):
    import csv
    import random

    rng = random.Random(2)
    pieces = ["a", "é€", '"', ",", "\n", " ", "x" * 40, "\n\n", "12", end]
    rows = [[str(i), *["q" + "".join(rng.choice(pieces) for _ in range(rng.randrange(9))) + "z" for _ in range(2)]] for i in range(700)]
    rows[5][1] = "long\n" * 400 + "end"
    path = tmp_path / "in.csv"
    with open(path, "w", newline="", encoding=encoding) as file:
        csv.writer(file, lineterminator=end).writerows([["id", "Avis é", "b"], *rows])
    text = path.read_text(encoding).rstrip(end) if end == "\n" else path.read_bytes().decode(encoding)
    path.write_bytes(text.encode(encoding))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        formats = tabular.file_formats(spark, str(path))
        assert [tabular._how(f, ",") for f in formats] == ["records"]
        read = tabular.read_csv(spark, str(path), order="place")
        assert read.columns == ["id", "Avis é", "b", "place"]
        assert sorted(map(tuple, read.drop("place").collect())) == sorted(map(tuple, rows))
        assert [r.id for r in read.orderBy("place").collect()] == [r[0] for r in rows]
        assert tabular._records(spark, [str(path)], "UTF-8" if encoding == "utf-8" else "ISO-8859-1").select("block").distinct().count() > 5
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_forms_choose_how_a_file_is_read(spark, tmp_path):
    forms = {
        "lines": 'a,b\n1,"x, ""y"""\n\n2,z\n', "records": 'a,b\n1,"x\n\ny"\n2,""\n', "whole": 'a,b\n1,5" pipe\n2,"x\ny"\n',
    }
    expected = {"lines": [("1", 'x, "y"'), ("2", "z")], "records": [("1", "x\n\ny"), ("2", None)], "whole": [("1", '5" pipe'), ("2", "x\ny")]}
    for how, content in forms.items():
        (tmp_path / f"{how}.csv").write_text(content)
        path = str(tmp_path / f"{how}.csv")
        assert tabular._how(tabular.file_formats(spark, path)[0], ",") == how
        whole = sorted(map(tuple, tabular.read_csv(spark, path, multi_line=True).collect()))
        assert sorted(map(tuple, tabular.read_csv(spark, path).collect())) == whole == expected[how]
    assert tabular.read_csv(spark, str(tmp_path), order="o").select("o").distinct().count() == 6


# ------------------------------------------------------------------------------ imports that scale

def test_compressed_store_is_not_broadcast(spark, tmp_path):
    """A stored table whose file is far smaller than its keys in memory: its ids must not pass through the driver."""
    configure(spark)
    base, saved = str(tmp_path / "store"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = spark.range(0, 200_000, 1, 4).select("id", F.lit("p").alias("place_id"))
    columns.complete(rows, REVIEWS).coalesce(1).write.parquet(f"{base}/reviews/data/_writer=main/_batch=0/review_month=2024-01")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        plan = plan_of(rows.join(store.load_table(spark, base, "reviews").select("id"), "id", "left_semi"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    assert "BroadcastHashJoin" not in plan


def test_rows_without_rejects_shuffle_only_their_keys(spark, tmp_path):
    clean = columns.complete(spark.range(50).select("id", F.lit("p").alias("place_id")), REVIEWS)
    numbered = clean.withColumn(store.POSITION, F.monotonically_increasing_id())
    assert store._rejected_positions(numbered, "reviews", None) is None
    twice = numbered.unionByName(numbered.withColumn(store.POSITION, F.col(store.POSITION) + (1 << 40)))
    assert store._rejected_positions(twice, "reviews", None).count() == 50
    known = store._rejected_positions(numbered, "reviews", clean.filter("id < 7"))
    assert known.count() == 7


def test_staged_order_names_files_by_number(spark, tmp_path):
    for name, values in (("b", (3, 4)), ("a", (1, 2))):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.csv").write_text("place_id,a.b\n" + "".join(f"p,{v}\n" for v in values))
    rows = migration.stage_csv(spark, str(tmp_path / "in"), str(tmp_path / "store"), "x")
    assert rows.schema[migration.ROW].dataType["file"].dataType.simpleString() == "int"
    assert [r["a.b"] for r in rows.orderBy(migration.ROW).collect()] == ["1", "2", "3", "4"]


def test_split_with_staging_gives_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame(
        [("p" if i % 3 else "q", f"a{i % 4}" if i % 5 else None, f"t{i % 6}", "5", "Positif", i) for i in range(60)],
        "place_id string, author string, text string, rating string, sentiment string, line int")
    stored = columns.complete(rows.filter("line = 7").withColumn("id", F.lit(90)), REVIEWS)
    plain = migration.split_classified(rows, NOW, ["line"], stored, 3, 1)
    staged = migration.split_classified(rows, NOW, ["line"], stored, 3, 1, staging=str(tmp_path / "numbered"))
    for name in ("places", "reviews", "classifications"):
        assert sorted(map(str, plain[name].collect())) == sorted(map(str, staged[name].collect()))
    assert staged["reviews"].agg(F.min("id")).head()[0] == 91


def test_empty_table_is_not_compared(spark):
    new = spark.createDataFrame([(1,), (None,)], "review_id long")
    assert migration._unstored(new, new.limit(0), "review_id") is new
    assert [r.review_id for r in migration._unstored(new, new, "review_id").collect()] == [None]


def test_ids_cut_by_a_larger_table_are_the_same(spark):
    rows = spark.range(0, 500, 1, 4).select(F.col("id").alias("at"))
    few = rows.filter("at % 7 = 0")
    cut = assign_ids(few, ["at"], after=2, cut_by=rows)
    assert sorted((r.id, r["at"]) for r in cut.collect()) == [(3 + i, v) for i, v in enumerate(range(0, 500, 7))]


def test_python_batches_are_bounded_by_bytes(spark):
    """2 000 texts of 20 kB in one task: no batch for Python may hold them all."""
    configure(spark)

    @F.pandas_udf("long")
    def batch_size(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("é"), 10_000).alias("t"))
    assert texts.select(batch_size("t").alias("n")).agg(F.max("n")).head()[0] < 1000


def test_exact_fold_of_odd_texts(spark):
    values = ["  Été ", "ﬁn ½ ㎏", "İstanbul ΣΑΣ", "", None, "𝐀́b  "]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").coalesce(1)
    got = [r.f for r in rows.select("i", text.fold_ascii(F.col("t"), exact=True).alias("f")).orderBy("i").collect()]
    assert got == ["ete", "fin 12 kg", "istanbul ", "", "", "Ab"]
