"""Classification, staged runs and incremental jobs."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from vocalake.functions.categories import parse_categories
from vocalake.operators.classify import RULES, classify, classify_by_rules
from vocalake.plans import store
from vocalake.plans.pipeline import run_pipeline
from vocalake.streaming.incremental import append_stream, process_available, stream_new_files, upsert_stream
from vocalake.taxonomy import CATEGORIES, CATEGORY_COLUMNS, OFF_TOPIC, OTHER_NEGATIVE, OTHER_POSITIVE, REGION_ALIASES

from . import roles as b
from .q_entity import CENTER_LISTS, RECTANGLES, regions
from .q_tables import raw_reviews
from .registry import query
from .roles import NOW, quoted, sql

# Sentences that carry one or more cues, dealt out by document id.
CUES = (
    "", " Trop d'attente, la file est longue.", " Personnel impoli et hautain !", " Une panne, encore une erreur.",
    " L'application fluide me plaît.", " Service injoignable, on ne rappelle pas.", " Des frais et commissions.",
    " Attente, panne, frais: injoignable.", " Les services en ligne sont en panne.",
)
CUE_LIST = "[" + ", ".join(quoted(c) for c in CUES) + "]"


def cued_documents(spark, sf):
    """Whole documents with a cue sentence at the end and a rating; some are blank."""
    key = F.col("doc_id")
    cue = F.element_at(F.array(*[F.lit(c) for c in CUES]), (key % len(CUES) + 1).cast("int"))
    text = F.when(key % 17 == 0, " \n").otherwise(F.concat("text", cue))
    quality = b.table(spark, sf, "labels").select("doc_id", "quality")
    rating = F.when(F.col("quality") == 1, 5).otherwise((key % 6).cast("int"))
    return b.documents(spark, sf).join(quality, "doc_id", "left").select(
        "doc_id", text.alias("text"), rating.alias("rating"))


RULE_SQL = f"""
WITH d AS (SELECT documents.doc_id,
    CASE WHEN documents.doc_id%17=0 THEN NULL ELSE lower(strip_accents(text||({CUE_LIST})[documents.doc_id%{len(CUES)}+1])) END AS t,
    CASE WHEN quality=1 THEN 5 ELSE documents.doc_id%6 END AS rating
  FROM documents LEFT JOIN labels ON labels.doc_id=documents.doc_id),
c AS (SELECT doc_id, rating, t IS NOT NULL AS has_text,
    {", ".join(f"coalesce(regexp_matches(t, {quoted(p)}), false) AS {flag}" for flag, p in RULES.items())},
    {", ".join(f"len(regexp_extract_all(t, {quoted(p)})) AS n_{flag}" for flag, p in RULES.items())} FROM d),
n AS (SELECT *, {" OR ".join(f for f in RULES if f != "cat_experience_digitale")} AS neg, cat_experience_digitale AS pos FROM c),
s AS (SELECT *, CASE WHEN neg AND NOT pos THEN 'Négatif' WHEN pos AND NOT neg THEN 'Positif' WHEN rating>=4 THEN 'Positif'
    WHEN rating IN (1,2) THEN 'Négatif' ELSE 'Neutre' END AS sentiment,
  list_transform(list_sort(list_filter([{", ".join(
    f"CASE WHEN {flag} THEN (-n_{flag}, {i}, {quoted(CATEGORY_COLUMNS[flag])}) END" for i, flag in enumerate(RULES))}],
    lambda x: x IS NOT NULL)), lambda x: x[3])[1:3] AS found FROM n),
l AS (SELECT doc_id, has_text, sentiment, CASE WHEN len(found)>0 THEN found
    WHEN NOT (neg OR pos) AND sentiment='Neutre' THEN [{quoted(OFF_TOPIC)}]
    WHEN sentiment='Positif' THEN [{quoted(OTHER_POSITIVE)}] WHEN sentiment='Négatif' THEN [{quoted(OTHER_NEGATIVE)}]
    ELSE [] END AS labels FROM s)
"""


@query("classify_by_rules", RULE_SQL + """
SELECT doc_id, CASE WHEN has_text THEN sentiment END AS sentiment,
       CASE WHEN has_text THEN array_to_string(labels, ' | ') ELSE '' END AS labels FROM l""")
def _(spark, sf):
    done = classify_by_rules(cued_documents(spark, sf))
    labels = F.concat_ws(" | ", F.transform(parse_categories(F.col("categories_json")), lambda c: c["label"]))
    return done.select("doc_id", "sentiment", labels.alias("labels"))


def rating_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A scorer that reads the rating, proposes one weak label and reports rating 0 as an error."""
    sentiments = batch["rating"].map(lambda r: "Positif" if r >= 4 else "Négatif" if r <= 2 else "Neutre")
    return pd.DataFrame({
        "sentiment": sentiments,
        "categories": [
            [{"label": CATEGORIES[int(r)], "confidence": 0.9 if r != 2 else 0.4}, {"label": "unknown", "confidence": 1.0}]
            for r in batch["rating"]],
        "language": "fr", "rationale": batch["text"].str.len().astype(str), "error": batch["rating"] == 0,
    })


@query("classify_with_scorer", sql("""
, t AS (SELECT id, CASE WHEN id%97=0 THEN 0 ELSE rating END AS rating, id%11=0 AS blank, length(text) AS n FROM reviews)
SELECT id, CASE WHEN blank THEN NULL WHEN rating=0 THEN 'Error' WHEN rating>=4 THEN 'Positif'
    WHEN rating<=2 THEN 'Négatif' ELSE 'Neutre' END AS sentiment,
  CASE WHEN blank OR rating=0 THEN NULL WHEN rating=2 THEN """ + quoted(OTHER_NEGATIVE)
       + " ELSE ([" + ", ".join(quoted(c) for c in CATEGORIES) + """])[rating+1] END AS label,
  CASE WHEN NOT blank AND rating>0 THEN 'fr' END AS language,
  CASE WHEN NOT blank AND rating>0 THEN CAST(n AS VARCHAR) END AS rationale FROM t"""))
def _(spark, sf):
    rows = b.reviews(spark, sf).select(
        "id", F.when(F.col("id") % 11 != 0, F.col("text")).otherwise(" ").alias("text"),
        F.when(F.col("id") % 97 != 0, F.col("rating")).alias("rating"))
    done = classify(rows, rating_scorer)
    label = F.get(parse_categories(F.col("categories_json")), 0)["label"]
    return done.select("id", "sentiment", label.alias("label"), "language", "rationale")


_REGION_LIST = "[" + ", ".join(quoted(REGION_ALIASES.get(r[1], r[1])) for r in RECTANGLES) + "]"


@query("staged_run", RULE_SQL + f"""
SELECT doc_id, sentiment, CASE WHEN doc_id%3=0 THEN CASE WHEN doc_id%2=0 THEN 'Fès-Meknès' END
    ELSE ({_REGION_LIST})[doc_id%{len(RECTANGLES)}+1] END AS region,
  {", ".join(f"list_contains(labels, {quoted(label)})::INT AS {short}" for short, label in CATEGORY_COLUMNS.items())}
FROM l WHERE has_text""")
def _(spark, sf):
    """All stages, then only their stored results: every document with its region and 17 flags.

    Two thirds of the documents have coordinates inside a polygon, the others a city at most.
    """
    base = b.scratch(spark)
    key = F.col("doc_id")
    slot = (key % len(RECTANGLES) + 1).cast("int")
    lng, lat = (F.element_at(F.array(*[F.lit(v) for v in values]), slot) for values in CENTER_LISTS)
    raw = cued_documents(spark, sf).filter(F.length(F.trim(F.replace("text", F.lit("\n"), F.lit("")))) > 0).select(
        "doc_id", "text", F.when(F.col("rating") > 0, F.col("rating").cast("string")).alias("rating"),
        F.lit("il y a 3 mois").alias("date"), F.when(key % 3 > 0, lat).alias("lat"), F.when(key % 3 > 0, lng).alias("lng"),
        F.when(key % 2 == 0, "Fès").otherwise("Nowhere").alias("city"))
    run_pipeline(spark, base, NOW, raw, regions(spark))
    wide = run_pipeline(spark, base, NOW, skip=("transform", "classify", "export"))
    return wide.select(
        "doc_id", "sentiment", "region", *[F.col(f"`{label}`").alias(short) for short, label in CATEGORY_COLUMNS.items()])


# ------------------------------------------------------------------------------ incremental

def _event_files(spark, sf, base):
    """Events as one file per task and type; returns their schema and half the number of files."""
    rows = b.table(spark, sf, "events").select("event_id", "value", "event_type")
    rows.withColumn("kind", F.col("event_type")).write.partitionBy("kind").parquet(f"{base}/in")
    files = spark.read.parquet(f"{base}/in").inputFiles()
    return rows.schema, max(1, len(files) // 2)


@query("stream_append", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def _(spark, sf):
    """Two runs over the same folder, a few micro-batches each: the second run finds nothing new."""
    base = b.scratch(spark)
    schema, half = _event_files(spark, sf, base)
    for _ in range(2):
        stream = stream_new_files(spark, f"{base}/in", schema, max_files=half)
        append_stream(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("stream_batches", "SELECT event_id, value, event_type FROM events")
def _(spark, sf):
    """Every micro-batch is written whole; together they hold each event once."""
    base = b.scratch(spark)
    schema, half = _event_files(spark, sf, base)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    stream = stream_new_files(spark, f"{base}/in", schema, max_files=half)
    process_available(stream, f"{base}/checkpoint", keep).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "value", "event_type")


@query("upsert_stream", sql("""
SELECT place_id, author, text, count(*) AS n FROM (
  SELECT DISTINCT place_id, CASE WHEN id%9<>0 THEN author ELSE '-' END AS author, text FROM reviews) GROUP BY ALL"""))
def _(spark, sf):
    """New review files arrive in two runs; each natural key is stored once."""
    base = b.scratch(spark)
    rows = raw_reviews(spark, sf).withColumn("review_name", F.coalesce("review_name", F.lit("-")))
    for turn in range(2):
        rows.filter(F.col("line") % 2 == turn).write.mode("append").parquet(f"{base}/in")
        stream = stream_new_files(spark, f"{base}/in", rows.schema)
        upsert_stream(stream, f"{base}/store", f"{base}/checkpoint", NOW, ["line"]).awaitTermination()
    stored = store.load_table(spark, f"{base}/store", "reviews")
    return stored.groupBy("place_id", "author", "text").agg(F.count(F.lit(1)).alias("n"))
