"""Round trips through every source and sink: what was written must come back whole."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F, types as T

from vocalake.operators.columns import conform, normalize_column_names
from vocalake.operators.joins import reviews_full, with_sentiment
from vocalake.plans.dashboard import collection_stats
from vocalake.plans.rollups import rollup_table
from vocalake.schemas import REVIEW_ITEM
from vocalake.sinks import writers as w
from vocalake.sources import documents as docs, tabular
from vocalake.sources.regions import read_regions
from vocalake.taxonomy import CATEGORY_COLUMNS, FLAG_COLUMNS

from . import roles as b
from .q_catalogue import FULL
from .q_dashboard import _labelled, rollup_union
from .q_entity import ALIASES, CENTERS, FLAT, RECTANGLES, flat_reviews, gazetteer
from .registry import query
from .roles import quoted, sql

KEY = "CAST(place_id AS BIGINT)"


# ------------------------------------------------------------------------------ CSV and Parquet

@query("read_locations", sql(f"""
SELECT CAST({KEY} AS VARCHAR) AS _place_id, city AS _city, business||' & Cie "x"' AS _business, name FROM places
WHERE {KEY}%5<>0 AND city IN ('NATION_3','NATION_10') AND business IN ('BUILDING','MACHINERY')"""))
def _(spark, sf):
    path = f"{b.scratch(spark)}/locations"
    k = F.col("place_id").cast("long")
    b.places(spark, sf).select(
        F.when(k % 5 != 0, F.concat(F.lit(" "), "place_id")).otherwise(" ").alias("Place ID"),
        F.col("city").alias("Ville"), F.concat("business", F.lit(' & Cie "x"')).alias("Bank_Name"), "name",
    ).write.csv(path, header=True, sep=";", escape='"')
    return tabular.read_locations(
        spark, path, cities=["nation_3", "Nation_10"], businesses=['Building & cie "X"', 'machinery & Cie "x"'],
    ).select("_place_id", "_city", "_business", "name")


@query("read_reviews_windows", "SELECT p_partkey, 'Très «bien» à 5 €;'||chr(10)||p_name||', dit-il' AS text FROM part")
def _(spark, sf):
    path = f"{b.scratch(spark)}/reviews"
    # The writer knows Latin-1 only: byte 0x80 is the euro sign of Windows-1252.
    text = F.concat(F.lit("Très «bien» à 5 \x80;\n"), "p_name", F.lit(", dit-il"))
    rows = b.table(spark, sf, "part").select("p_partkey", text.alias("text"))
    rows.write.option("encoding", "ISO-8859-1").option("escape", '"').csv(path, header=True)
    return tabular.read_reviews(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "text")


@query("read_reviews_utf8", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def _(spark, sf):
    path = f"{b.scratch(spark)}/reviews"
    w.export_csv(b.documents(spark, sf).select("doc_id", "text"), path)
    return tabular.read_reviews(spark, path).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


@query("read_reviews_mixed_encodings", """
SELECT doc_id, md5(text) AS text_md5 FROM documents
UNION ALL SELECT p_partkey, md5('Très «bien» à 5 €, '||p_name) FROM part""")
def _(spark, sf):
    """A folder of files in UTF-8 and Windows-1252: each file is read in its own encoding."""
    path = f"{b.scratch(spark)}/mixed"
    w.export_csv(b.documents(spark, sf).select("doc_id", "text"), path)
    windows = F.concat(F.lit("Très «bien» à 5 \x80, "), "p_name")
    b.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), windows.alias("text")).write.mode("append").option(
        "encoding", "ISO-8859-1").option("escape", '"').csv(path, header=True)
    return tabular.read_reviews(spark, path).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


@query("read_reviews_replacement_char", "SELECT doc_id, md5('é'||chr(65533)||text) AS text_md5 FROM documents")
def _(spark, sf):
    """Valid UTF-8 stays UTF-8 even if it holds replacement characters of its own."""
    path = f"{b.scratch(spark)}/replaced"
    w.export_csv(b.documents(spark, sf).select("doc_id", F.concat(F.lit("é\ufffd"), "text").alias("text")), path)
    return tabular.read_reviews(spark, path).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


@query("read_wide_semicolon", sql("SELECT review_id, " + ", ".join(FLAG_COLUMNS) + " FROM flags"))
def _(spark, sf):
    """Category names hold commas, in a file separated by semicolons."""
    path = f"{b.scratch(spark)}/wide"
    b.flags(spark, sf).select("review_id", *[F.col(c).alias(label) for c, label in CATEGORY_COLUMNS.items()]).write.csv(
        path, header=True, sep=";", quoteAll=True, escape='"')
    return tabular.read_reviews(spark, path, multi_line=False).select(
        F.col("review_id").cast("long").alias("review_id"),
        *[F.col(f"`{label}`").cast("int").alias(c) for c, label in CATEGORY_COLUMNS.items()])


@query("export_parquet", sql(FULL))
def _(spark, sf):
    path = f"{b.scratch(spark)}/full.parquet"
    w.export(reviews_full(b.reviews(spark, sf), b.places(spark, sf), b.classifications(spark, sf)), path)
    return tabular.read_table(spark, path.removesuffix(".parquet"))


@query("export_csv_wide", sql("""
SELECT c.review_id, sentiment, rationale, model_version, """ + ", ".join(f"coalesce({c},0) AS {c}" for c in FLAG_COLUMNS) + """
FROM classifications c LEFT JOIN flags f ON f.review_id=c.review_id"""))
def _(spark, sf):
    base = f"{b.scratch(spark)}/wide"
    w.export(b.labelled(spark, sf), f"{base}.csv")
    back = tabular.read_table(spark, base)
    return back.select(
        F.col("review_id").cast("long").alias("review_id"), "sentiment", "rationale", "model_version",
        *[F.col(f"`{label}`").cast("int").alias(c) for c, label in CATEGORY_COLUMNS.items()])


@query("flatten_reviews_csv", sql(FLAT))
def _(spark, sf):
    """All thirteen columns through the file and back."""
    path = f"{b.scratch(spark)}/flat"
    flat = flat_reviews(spark, sf)
    w.export_csv(flat, path)
    return tabular.read_csv(spark, path).select(*[F.col(n).cast(kind).alias(n) for n, kind in flat.dtypes])


@query("latest_snapshot", sql("SELECT city, CAST(count(*) AS VARCHAR) AS reviews FROM reviews GROUP BY city"))
def _(spark, sf):
    """A snapshot is one file: the reviews per city, after an empty one and an older folder."""
    base = b.scratch(spark)
    rows = b.reviews(spark, sf).groupBy("city").agg(F.count(F.lit(1)).alias("reviews"))
    rows.filter("reviews < 0").write.csv(f"{base}/older", header=True)
    rows.filter("reviews < 0").coalesce(1).write.csv(f"{base}/current", header=True)
    rows.coalesce(1).write.mode("append").csv(f"{base}/current", header=True)
    newest = tabular.latest_snapshot(spark, [f"{base}/missing", f"{base}/current", f"{base}/older"])
    return tabular.read_csv(spark, newest)


@query("dated_runs", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf):
    base = f"{b.scratch(spark)}/runs"
    rows = b.table(spark, sf, "customer").select("c_custkey", "c_name")
    older = rows.withColumn("c_name", F.upper("c_name"))
    w.write_run(rows.unionByName(older), base, date(2024, 1, 31))
    w.write_run(older, base, date(2024, 2, 1))
    w.write_run(rows, base, date(2024, 2, 1))
    return w.read_latest(spark, base)


@query("split_failures", sql(f"SELECT DISTINCT place_id FROM reviews WHERE {KEY}%10=1"))
def _(spark, sf):
    rows = b.reviews(spark, sf).withColumn(
        "status", F.when(F.col("place_id").cast("long") % 10 == 1, "failed").when(F.col("rating") > 2, "ok"))
    return w.split_failures(rows)[1]


@query("split_successes", sql(f"SELECT id, rating FROM reviews WHERE {KEY}%10<>1"))
def _(spark, sf):
    rows = b.reviews(spark, sf).withColumn(
        "status", F.when(F.col("place_id").cast("long") % 10 == 1, "failed").when(F.col("rating") > 2, "ok"))
    return w.split_failures(rows)[0].select("id", "rating")


@query("write_aggregates", rollup_union())
def _(spark, sf):
    path = f"{b.scratch(spark)}/aggregates"
    w.write_aggregates(rollup_table(_labelled(spark, sf)), path)
    return spark.read.parquet(path)


@query("conform_columns", "SELECT c_custkey, c_name AS name, 'x' AS city FROM customer")
def _(spark, sf):
    rows = b.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias(" TITLE"), F.lit("x").alias("_City "))
    return conform(normalize_column_names(rows), "places").select("c_custkey", "name", "city")


# ------------------------------------------------------------------------------ JSON

def bundle_items(spark, sf):
    """Reviews in the item shape of a bundle."""
    return b.reviews(spark, sf).select(
        "place_id", "city", "business", F.col("author").alias("name"), F.col("rating").cast("double").alias("rating"),
        F.col("review_date").alias("date"), F.concat("text", F.lit(' "é"\n'), F.col("id").cast("string")).alias("snippet"),
        F.array(F.col("id").cast("string"), F.lit("b")).alias("images"))


BUNDLE = "SELECT place_id, author AS name, CAST(rating AS DOUBLE) AS rating, review_date AS date, " \
         "text||' \"é\"'||chr(10)||id AS snippet, CAST(id AS VARCHAR) AS image{} FROM reviews"
ITEM = ("place_id", "name", "rating", "date", "snippet")


@query("review_bundle", sql(BUNDLE.format("")))
def _(spark, sf):
    path = f"{b.scratch(spark)}/bundle"
    w.write_review_bundle(bundle_items(spark, sf), path)
    return docs.read_review_bundle(spark, path).select(*ITEM, F.col("images")[0].alias("image"))


def _by(column):
    @query(f"review_bundle_by_{column}", sql(BUNDLE.format(f", replace(lower({column}),' ','-') AS {column}_slug")))
    def _(spark, sf):
        path = f"{b.scratch(spark)}/by"
        w.write_json_by(bundle_items(spark, sf), path, column)
        text = spark.read.text(path)
        lines = text.select(
            f"{column}_slug", F.explode(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(REVIEW_ITEM))))
            .alias("place_id", "reviews"))
        items = lines.select(f"{column}_slug", "place_id", F.explode("reviews").alias("r"))
        return items.select(
            f"{column}_slug", "place_id", "r.name", "r.rating", "r.date", "r.snippet", F.col("r.images")[0].alias("image"))


_by("city")
_by("business")


@query("bundle_collection_stats", sql(
    "SELECT count(DISTINCT place_id) AS total_places, count(*) AS total_reviews FROM reviews"))
def _(spark, sf):
    path = f"{b.scratch(spark)}/bundle"
    w.write_review_bundle(bundle_items(spark, sf), path)
    return collection_stats(docs.read_review_bundle(spark, path))


@query("read_gazetteer", sql(f"""
SELECT 'Ville '||city AS name, {KEY}*1000%900001 AS population, longitude AS lng,
       CASE WHEN {KEY}%2=0 THEN city END AS french FROM places"""))
def _(spark, sf):
    path = f"{b.scratch(spark)}/gazetteer"
    lines = gazetteer(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    broken = b.table(spark, sf, "nation").select(F.explode(F.array(
        F.lit(""), F.concat(F.lit('{"name": '), "n_name"))).alias("value"))
    lines.unionByName(broken).write.text(path)
    return docs.read_gazetteer(spark, path).select(
        "name", "population", F.col("location")[0].alias("lng"), F.col("other_names")["name:fr"].alias("french"))


@query("read_lookup", sql("SELECT city AS key, CAST(count(*) AS VARCHAR) AS value FROM places GROUP BY city"))
def _(spark, sf):
    """Places per city as one JSON dictionary; a missing file adds nothing."""
    path = f"{b.scratch(spark)}/lookup"
    counts = b.places(spark, sf).groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    entries = F.map_from_entries(F.collect_list(F.struct("city", "n")))
    counts.agg(F.to_json(entries).alias("value")).coalesce(1).write.text(path)
    missing = docs.read_lookup(spark, f"{path}-missing")
    return docs.read_lookup(spark, path).unionByName(missing)


_CITY_NUMBER = "CAST(split_part(city,'_',2) AS INTEGER)"


@query("read_regions", sql(f"""
, known(o, region, x0, y0, x1, y1) AS (VALUES {", ".join(
    f"({i}, {quoted(name)}, {x0}::DOUBLE, {y0}::DOUBLE, {x1}::DOUBLE, {y1}::DOUBLE)"
    for i, name, x0, y0, x1, y1 in RECTANGLES)})
SELECT pos AS region_order, region, x0 AS min_x, y0 AS min_y, x1 AS max_x, y1 AS max_y
FROM known JOIN (SELECT n, CAST(row_number() OVER (ORDER BY n)-1 AS INTEGER) AS pos
                 FROM (SELECT DISTINCT {_CITY_NUMBER} AS n FROM places)) ON n=o"""))
def _(spark, sf):
    """One feature per city of the places: the first carry the known rectangles, the rest no geometry."""
    path = f"{b.scratch(spark)}/regions"
    corners = {i: [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]] for i, _, x0, y0, x1, y1 in RECTANGLES}
    names = F.array(*[F.lit(r[1]) for r in RECTANGLES])
    rings = F.array(*[F.array(*[F.array(*[F.lit(v) for v in p]) for p in corners[r[0]]]) for r in RECTANGLES])
    n = F.col("n")
    known = n < len(RECTANGLES)
    feature = F.struct(
        n.alias("order"),
        F.struct(F.when(known & (n % 2 == 0), F.get(names, n)).alias("name"), F.when(known, F.get(names, n)).alias("NAME_1"))
        .alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.when(known, F.array(F.get(rings, n))).alias("coordinates"))
        .alias("geometry"))
    cities = b.places(spark, sf).select(F.split_part("city", F.lit("_"), F.lit(2)).cast("int").alias("n")).distinct()
    cities.agg(F.to_json(F.struct(
        F.array_sort(F.collect_list(feature)).alias("features"))).alias("value")).coalesce(1).write.text(path)
    return read_regions(spark, path).select("region_order", "region", "min_x", "min_y", "max_x", "max_y")


@query("load_centers_from_gazetteer", sql(f"""
SELECT 'center' AS kind, key, value FROM ({CENTERS}) UNION ALL SELECT 'alias', key, value FROM ({ALIASES})"""))
def _(spark, sf):
    """No stored lookups: centres and aliases, both whole, are built from the gazetteer file."""
    base = b.scratch(spark)
    gazetteer(spark, sf).orderBy("order").write.json(f"{base}/gazetteer")
    centers, aliases = docs.load_centers(spark, f"{base}/none", f"{base}/none", f"{base}/gazetteer")
    return centers.select(F.lit("center").alias("kind"), "key", "value").unionByName(
        aliases.select(F.lit("alias").alias("kind"), "key", "value"))


@query("bucketed_join", sql("""
SELECT sentiment, count(*) AS n FROM rs GROUP BY sentiment"""))
def _(spark, sf):
    """Reviews and classifications bucketed on the review id join without a shuffle."""
    base = b.scratch(spark)
    names = [f"{kind}_{base[-32:]}" for kind in ("reviews", "labels")]
    w.write_bucketed(b.reviews(spark, sf).select("id", "rating"), names[0], "id", 8, f"{base}/reviews")
    labels = b.classifications(spark, sf).select("review_id", "sentiment")
    w.write_bucketed(labels, names[1], "review_id", 8, f"{base}/labels")
    joined = with_sentiment(*[spark.table(name) for name in names])
    return joined.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))
