"""Classification: pluggable batch scorer, rule scorer and post-processing."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.categories import categories_json, filter_categories, with_fallback
from ..functions.numbers import to_number
from ..functions.text import fold_ascii, strip
from ..schemas import CATEGORY_ARRAY
from ..taxonomy import CATEGORY_COLUMNS, ERROR, NEGATIVE, NEUTRAL, OFF_TOPIC, POSITIVE
from .columns import first_present

Scorer = Callable[[pd.DataFrame], pd.DataFrame]
ANSWER = T.StructType([
    T.StructField("sentiment", T.StringType()), T.StructField("categories", CATEGORY_ARRAY),
    T.StructField("language", T.StringType()), T.StructField("rationale", T.StringType()),
])
RULE_CONFIDENCE = 0.8
MAX_LABELS = 3  # default of ``max_labels``: an answer names its three most relevant categories at most

# Cue words (folded to ASCII) -> flag column of the category they point to.
RULES = {
    "cat_attente_lenteur": r"\b(attente|attendre|file|queue|lent|lente|lenteur|peu de personnel)\b",
    "cat_manque_consideration": r"\b(impoli|impolie|mepris|hautain|condescendant|irrespect|mal accueilli)",
    "cat_incidents_techniques": r"\b(panne|bug|erreur|bloquee?|technique|systeme)s?\b",
    "cat_experience_digitale": r"\b(application fluide|appli|en ligne|digitale?)\b",
    "cat_service_injoignable": r"\b(injoignable|ne repond|ne rappelle|jamais rappele)",
    "cat_frais_abusifs": r"\b(frais|commissions?|couts?|trop cher)\b",
}
# Any cue; inside a match the rules see the same word bounds as in the text.
ANY_RULE = "|".join(f"(?:{pattern})" for pattern in RULES.values())
POSITIVE_RULES = ("cat_experience_digitale",)


def _text_and_rating(df: DataFrame, text_col: str | None, rating_col: str | None) -> tuple[str, str]:
    text_col = text_col or first_present(df, ("text", "review_snippet"))
    rating_col = rating_col or first_present(df, ("rating", "review_rating"))
    if not text_col or not rating_col:
        raise ValueError(f"no review text or rating column among {df.columns}")
    return text_col, rating_col


def _has_text(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def _stars(rating: Column) -> Column:
    """Whole rating; missing and unreadable ones count as 0."""
    return F.coalesce(to_number(rating).cast("int"), F.lit(0))


def _answers(scorer: Scorer, batch: pd.DataFrame) -> pd.DataFrame:
    """Score a batch; if the scorer raises, score its rows once more one by one.

    A scorer that reports failing rows in a column ``error`` is called once per batch; one that
    raises sees each row at most twice.
    """
    try:
        return _reported(scorer(batch), batch.index)
    except Exception:
        return pd.concat([_answer(scorer, batch.iloc[i:i + 1]) for i in range(len(batch))])


def _answer(scorer: Scorer, row: pd.DataFrame) -> pd.DataFrame:
    try:
        return _reported(scorer(row), row.index)
    except Exception:
        return pd.DataFrame([[ERROR, None, None, None]], columns=ANSWER.names, index=row.index)


def _reported(answers: pd.DataFrame, index: pd.Index) -> pd.DataFrame:
    out = answers[ANSWER.names].set_axis(index)
    if "error" in answers.columns:
        failed = answers["error"].fillna(False).astype(bool).to_numpy()
        out = out.astype(object)
        out.loc[failed, ANSWER.names] = None
        out.loc[failed, "sentiment"] = ERROR
    return out


def classify(
    df: DataFrame, scorer: Scorer, text_col: str | None = None, rating_col: str | None = None
) -> DataFrame:
    """Add sentiment, categories_json, language and rationale.

    ``scorer`` maps a pandas batch (text, rating) to a batch (sentiment, categories, language,
    rationale, and optionally error). Only these two columns travel to Python; texts that are
    empty are not scored and keep null results, a failing row gets the sentiment ``Error``.
    """
    text_col, rating_col = _text_and_rating(df, text_col, rating_col)

    def score(texts: pd.Series, ratings: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(None, index=texts.index, columns=ANSWER.names, dtype=object)
        wanted = texts.notna()
        if wanted.any():
            batch = pd.DataFrame({"text": texts[wanted], "rating": ratings[wanted]})
            out.loc[wanted] = _answers(scorer, batch)
        return out.astype(object).where(out.notna(), None)

    scored = F.pandas_udf(score, ANSWER)
    text = F.when(_has_text(F.col(text_col)), F.col(text_col))
    return _attach(df, scored(text, _stars(F.col(rating_col))))


def _attach(df: DataFrame, answer: Column) -> DataFrame:
    """Threshold, fallback and serialisation of the scorer's answer, as native columns."""
    kept = df.withColumn("_answer", answer)
    sentiment = F.col("_answer")["sentiment"]
    raw = F.coalesce(F.col("_answer")["categories"], F.array().cast(CATEGORY_ARRAY))
    final = with_fallback(filter_categories(raw), sentiment)
    scored = sentiment.isNotNull() & (sentiment != ERROR)
    return kept.withColumns({
        "sentiment": sentiment,
        "categories_json": F.when(scored, categories_json(final)),
        "language": F.col("_answer")["language"],
        "rationale": F.col("_answer")["rationale"],
    }).drop("_answer")


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda cue: cue.rlike(pattern)


def _any(hits: list[Column]) -> Column:
    return reduce(or_, hits, F.lit(False))


def classify_by_rules(
    df: DataFrame, text_col: str | None = None, rating_col: str | None = None, max_labels: int = MAX_LABELS
) -> DataFrame:
    """``classify`` with the offline rules: cue words give categories, the rating decides
    without a clear cue. The ``max_labels`` categories with the most cues stay, ties in the order
    of the rules.

    Native expressions only, in layers: the folded text and each cue are computed once per row
    and later layers read them as columns.
    """
    text_col, rating_col = _text_and_rating(df, text_col, rating_col)
    text = F.col(text_col)
    rows = df.withColumn("_folded", F.when(_has_text(text), fold_ascii(text)))
    # One pass finds all cue words of a text; the categories are counted on those few.
    rows = rows.withColumn("_cues", F.regexp_extract_all("_folded", F.lit(ANY_RULE), F.lit(0)))
    rows = rows.withColumns({f"_{flag}": F.size(F.filter("_cues", _matches(p))) for flag, p in RULES.items()})
    cues = {flag: F.coalesce(F.col(f"_{flag}") > 0, F.lit(False)) for flag in RULES}
    positive_cue = _any([hit for flag, hit in cues.items() if flag in POSITIVE_RULES])
    negative_cue = _any([hit for flag, hit in cues.items() if flag not in POSITIVE_RULES])
    stars = _stars(F.col(rating_col))
    sentiment = (
        F.when(negative_cue & ~positive_cue, NEGATIVE).when(positive_cue & ~negative_cue, POSITIVE)
        .when(stars >= 4, POSITIVE).when(stars.isin(1, 2), NEGATIVE).otherwise(NEUTRAL)
    )
    rows = rows.withColumn("_sentiment", F.when(F.col("_folded").isNotNull(), sentiment))

    def entry(label):
        return F.struct(F.lit(label).alias("label"), F.lit(RULE_CONFIDENCE).alias("confidence"))

    ranked = F.array_sort(F.array_compact(F.array(*[
        F.when(hit, F.struct((-F.col(f"_{flag}")).alias("order"), F.lit(i).alias("rule"), entry(CATEGORY_COLUMNS[flag]).alias("e")))
        for i, (flag, hit) in enumerate(cues.items())])))
    found = F.transform(ranked, lambda r: r["e"])
    off_topic = ~(negative_cue | positive_cue) & (F.col("_sentiment") == NEUTRAL)
    labels = F.when(off_topic, F.array(entry(OFF_TOPIC))).otherwise(F.slice(found, 1, max_labels))
    answer = F.struct(
        F.col("_sentiment").alias("sentiment"), labels.cast(CATEGORY_ARRAY).alias("categories"),
        F.lit(None).cast("string").alias("language"),
        F.when(F.col("_sentiment").isNotNull(), "rules").alias("rationale"),
    )
    return _attach(rows, answer).drop("_folded", "_cues", "_sentiment", *[f"_{flag}" for flag in RULES])
