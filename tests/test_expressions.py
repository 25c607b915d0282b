"""Value cases of the scalar expressions."""
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vocalake.functions import categories, dates, geometry, numbers, text
from vocalake.taxonomy import CATEGORIES, OTHER_NEGATIVE, OTHER_POSITIVE

NOW = datetime(2024, 1, 15, 12, 0, 0)


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).head().r


@pytest.mark.parametrize("phrase, expected", [
    ("il y a 2 ans", datetime(2022, 1, 15, 12)),
    ("il y a 3 mois", datetime(2023, 10, 17, 12)),
    ("il y a 5 jours", datetime(2024, 1, 10, 12)),
    ("Modifié il y a 11 mois", datetime(2023, 2, 19, 12)),
    ("MODIFIÉ IL Y A UNE SEMAINE", datetime(2024, 1, 8, 12)),
    ("modifie il y a 2 heures", datetime(2024, 1, 15, 10)),
    ("il y a un an", datetime(2023, 1, 15, 12)),
    ("il y a 7 ans", datetime(2017, 1, 16, 12)),
    ("  il  y a 30 minutes ", datetime(2024, 1, 15, 11, 30)),
    ("il y a 99999 ans", None),
    ("il y a 99999999999999999999 ans", None),
    ("depuis il y a 2 ans", None),
    ("not a date", None), ("", None), (None, None),
])
def test_relative_french(spark, phrase, expected):
    got = one(spark, phrase, lambda c: dates.parse_relative_french(c, NOW).cast("string"))
    assert got == (str(expected) if expected else None)


@pytest.mark.parametrize("raw, expected", [
    ("4", 4), ("5.0", 5), ("0", 1), ("6", 5), ("-1", 1), ("2.5", 2), ("3.5", 4), ("invalid", None), (None, None),
    ("nan", None), (" 3 ", 3),
])
def test_ratings(spark, raw, expected):
    assert one(spark, raw, numbers.clean_rating) == expected


@pytest.mark.parametrize("raw, expected", [
    ("2024-03-05", "2024-03-05 00:00:00"), ("05/03/2024", "2024-03-05 00:00:00"), ("5-3-2024", "2024-03-05 00:00:00"),
    ("05.03.2024 14:30", "2024-03-05 14:30:00"), ("2024-03-05T01:02:03", "2024-03-05 01:02:03"), ("2024-03", "2024-03-01 00:00:00"),
    ("31/02/2024", None), ("soon", None), ("12:30", None), (None, None),
    ("09/11/23", "2023-11-09 00:00:00"), ("9.11.71", "1971-11-09 00:00:00"), ("2023/11/9", "2023-11-09 00:00:00"),
    ("9 Nov 2023", "2023-11-09 00:00:00"), ("09 november 2023", "2023-11-09 00:00:00"), ("9-NOV-2023", "2023-11-09 00:00:00"),
    ("09/11/23 07:08", "2023-11-09 07:08:00"), ("9 xyz 2023", None),
])
def test_dayfirst(spark, raw, expected):
    assert one(spark, raw, lambda c: dates.parse_date_dayfirst(c).cast("string")) == expected


@pytest.mark.parametrize("raw, expected", [("  Good  ", "Good"), (None, ""), (" Bien\n", "Bien")])
def test_clean_text(spark, raw, expected):
    assert one(spark, raw, text.clean_text) == expected


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("raw, expected", [
    ("  Fès ", "fes"), ("TÉTOUAN", "tetouan"), (None, ""), ("agadir ⴰⴳ", "agadir "), ("Œuvre", "uvre"),
])
def test_fold_ascii(spark, raw, expected, exact):
    assert one(spark, raw, lambda c: text.fold_ascii(c, exact)) == expected


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("raw, expected", [
    ("  Al  Hoceïma ", "al hoceima"), ("Агадир", "агадир"), (None, ""), ("Fès", "fes"),
])
def test_fold_marks(spark, raw, expected, exact):
    assert one(spark, raw, lambda c: text.fold_marks(c, exact)) == expected


@pytest.mark.parametrize("raw, expected", [
    ("ChIJABC123xyz", True), ("ChIJ_test-123", True), ("", False), ("ChIJ", False), ("ChI", False),
    ("ChIJ@invalid", False), (None, False),
])
def test_canonical_ids(spark, raw, expected):
    assert one(spark, raw, text.is_canonical_place_id) is expected


def test_short_category(spark):
    assert one(spark, CATEGORIES[7], text.short_category) == "Attente / Lenteur"
    assert one(spark, "AUTRE (POSITIF)", text.short_category) == "Autre (+)"
    assert one(spark, "x" * 40 + " (y)", text.short_category) == "x" * 30 + "..."


def test_exact_whitespace_composes(spark):
    assert one(spark, " \ufb01n \u00a0 \u2460\u3000x ", lambda c: text.normalize_whitespace(c, exact=True)) == "fin 1 x"
    assert one(spark, " a\u202f\u00a0b ", text.normalize_whitespace) == "a b"


def test_sentiment_bucket_folds_accents(spark):
    assert [one(spark, s, text.sentiment_bucket) for s in ("Positif", "Négatif", "NEUTRE", "?", None)] == [
        "positive", "negative", "neutral", None, None]


def test_distance(spark):
    def metres(lat):
        return one(spark, lat, lambda c: numbers.haversine_m(F.lit(33.5888), F.lit(-7.6114), c, F.lit(-6.8416)), "double")

    assert one(spark, 1.0, lambda c: numbers.haversine_m(c, c, c, c), "double") == 0
    assert 80_000 < metres(34.0209) < 100_000


@pytest.mark.parametrize("population, zoom", [(None, "14z"), (0, "14z"), (50_000, "13z"), (200_000, "12z"), (800_000, "11z")])
def test_zoom(spark, population, zoom):
    assert one(spark, population, numbers.zoom_for_population, "long") == zoom


@pytest.mark.parametrize("rating, color", [(None, "gray"), (0.0, "gray"), (4.0, "green"), (3.5, "orange"), (2.9, "red")])
def test_rating_class(spark, rating, color):
    assert one(spark, rating, numbers.rating_class, "double") == color


@pytest.mark.parametrize("json, labels", [
    (None, []), ("[]", []), ("{bad", []), ('[{"label":"a","confidence":0.4},{"label":null}]', ["a", None]),
])
def test_parse_categories(spark, json, labels):
    assert one(spark, json, lambda c: categories.parse_categories(c)["label"]) == labels


def test_threshold_and_fallback(spark):
    low = '[{"label": "%s", "confidence": 0.4}]' % CATEGORIES[0]

    def labels(sentiment):
        kept = lambda c: categories.filter_categories(categories.parse_categories(c))
        return one(spark, low, lambda c: categories.with_fallback(kept(c), F.lit(sentiment)))

    assert [(c.label, c.confidence) for c in labels("Positif")] == [(OTHER_POSITIVE, 0.6)]
    assert [c.label for c in labels("negatif")] == [OTHER_NEGATIVE]
    assert labels("Neutre") == [] and labels(None) == []


def test_polygon_interior_is_strict(spark):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in (
        (0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 1.0), (0.0, 2.0), (0.0, 0.0))])

    def inside(x, y):
        return one(spark, x, lambda c: geometry.contains_point(geometry.edges(square), c, F.lit(y)), "double")

    assert inside(1.0, 0.5) and inside(0.2, 1.5) and inside(1.8, 1.5)
    assert not inside(1.0, 1.5)   # in the notch
    assert not inside(0.0, 1.0) and not inside(2.0, 2.0) and not inside(1.5, 1.5)   # on the boundary


def test_search_queries(spark):
    phrases = one(spark, "CIH", lambda c: text.search_queries(c, F.lit("Fes"), F.lit("banque")))
    assert phrases == ["CIH Fes", "CIH banque Fes", "CIH agence Fes", "CIH succursale Fes", "CIH Fes Morocco",
                       "CIH near Fes Morocco"]
    assert one(spark, "CIH", lambda c: text.search_queries(c, F.lit("Fes"))) == [
        "CIH Fes", "CIH Fes Morocco", "CIH near Fes Morocco"]


def test_fold_ascii_equals_the_exact_form_for_all_letters(spark):
    """Every letter up to U+FFFF, alone between two others."""
    import unicodedata

    letters = [chr(c) for c in range(0x10000) if unicodedata.category(chr(c)).startswith("L")]
    rows = spark.createDataFrame([(f"a{c}b",) for c in letters], "t string")
    native, exact = text.fold_ascii(F.col("t")), text.fold_ascii(F.col("t"), exact=True)
    wrong = rows.select("t", native.alias("n"), exact.alias("e")).filter("n <> e").collect()
    assert not wrong, wrong[:10]
