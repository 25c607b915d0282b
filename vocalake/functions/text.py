"""String expressions."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..taxonomy import CANONICAL_PLACE_ID, SHORT_CATEGORY_NAMES

# Every character Unicode counts as white space.
WHITESPACE = "".join(
    chr(c) for c in
    [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
     0x205F, 0x3000]
)
def _latin_fold_table() -> tuple[str, str]:
    """Characters of the Latin blocks, and letters of any block, whose compatibility form is one
    ASCII character plus marks."""
    source, target = [], []
    latin = {*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)}
    for code in range(0xA0, 0x10000):
        if code not in latin and not unicodedata.category(chr(code)).startswith("L"):
            continue
        ascii_part = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if ord(c) < 128)
        if len(ascii_part) == 1:
            source.append(chr(code))
            target.append(ascii_part)
    return "".join(source), "".join(target)


def _expanding_fold_table() -> dict[str, str]:
    """Characters whose compatibility form has several ASCII characters, such as ligatures.

    All letters, and the signs of the Latin-1, punctuation, letter-like and number blocks.
    """
    table = {}
    for code in range(0xA0, 0x10000):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or not (code < 0x2190 or unicodedata.category(char).startswith("L")):
            continue
        # As in the exact form, the lower case comes before the decomposition.
        lowered = char.lower()
        ascii_part = "".join(c for c in unicodedata.normalize("NFKD", lowered) if ord(c) < 128)
        if len(ascii_part) > 1 and lowered == char:
            table[char] = ascii_part
    return table


_FOLD_FROM, _FOLD_TO = _latin_fold_table()
_EXPANDING = _expanding_fold_table()


def _covering_class(gap: int = 8) -> str:
    """Ranges that hold every character whose lower case expands, and some more."""
    codes = [c for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c).lower() in _EXPANDING]
    ranges = []
    for code in codes:
        if ranges and code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\u{low:04x}-\\u{high:04x}" for low, high in ranges)


_EXPANDING_CLASS = _covering_class()


def strip(col: Column) -> Column:
    """Trim every Unicode white-space character, not only the blank."""
    return F.btrim(col, F.lit(WHITESPACE))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    """Exact compatibility composition, for scripts the native path leaves alone."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_whitespace(col: Column, exact: bool = False) -> Column:
    """Collapse runs of white space (no-break spaces included) to one blank and trim.

    ``exact`` also composes compatibility characters (NFKC) in Arrow batches.
    """
    blanks = F.translate(_nfkc(col) if exact else col, WHITESPACE, " " * len(WHITESPACE))
    return F.btrim(F.regexp_replace(blanks, " {2,}", " "))


def _ascii_of(text: str) -> str:
    return unicodedata.normalize("NFKD", text.lower().strip()).encode("ascii", errors="ignore").decode("ascii")


@F.pandas_udf(T.StringType())
def _fold_ascii_exact(texts: pd.Series) -> pd.Series:
    # Text by text, so that the forms between exist for one text at a time and not for the batch.
    return texts.map(_ascii_of, na_action="ignore")


def _without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _fold_marks_exact(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(_without_marks(t).lower().split()), na_action="ignore")


def fold_latin(col: Column) -> Column:
    """Replace accented Latin letters by their base letter, keep the rest."""
    return F.translate(col, _FOLD_FROM, _FOLD_TO)


def _ascii_only(text: Column) -> Column:
    return F.regexp_replace(fold_latin(text), r"[^\x00-\x7f]", "")


def fold_ascii(col: Column, exact: bool = False) -> Column:
    """Lower, trim, strip accents and drop what is not ASCII; null becomes "".

    The native form covers the Latin blocks, ligatures and letter-like signs; ``exact`` decomposes
    every script in Arrow batches.
    """
    text = F.coalesce(col.cast("string"), F.lit(""))
    if exact:
        return _fold_ascii_exact(text)
    lowered = strip(F.lower(text))
    expanded = lowered
    for char, letters in _EXPANDING.items():
        expanded = F.replace(expanded, F.lit(char), F.lit(letters))
    # The rare texts with such characters take the long way; the test reads the text as it is.
    expanding = (F.octet_length(text) != F.char_length(text)) & text.rlike(f"[{_EXPANDING_CLASS}]")
    return F.when(expanding, _ascii_only(expanded)).otherwise(_ascii_only(lowered))


def fold_marks(col: Column, exact: bool = False) -> Column:
    """Lower, strip accents, collapse blanks; other scripts survive."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    if exact:
        return _fold_marks_exact(text)
    return normalize_whitespace(F.lower(F.regexp_replace(fold_latin(text), r"\p{Mn}", "")))


def clean_text(col: Column) -> Column:
    """Null -> "", then trim."""
    return strip(F.coalesce(col.cast("string"), F.lit("")))


def slug(col: Column) -> Column:
    return F.replace(F.lower(col), F.lit(" "), F.lit("-"))


def short_category(col: Column) -> Column:
    """Display name of a category: substring match in either direction, first entry wins."""
    lowered = F.lower(col)
    head = strip(F.split_part(col, F.lit("("), F.lit(1)))
    fallback = F.when(F.length(head) > 30, F.concat(F.substring(head, 1, 30), F.lit("..."))).otherwise(head)
    names = [
        F.when(lowered.contains(full.lower()) | F.lit(full.lower()).contains(lowered), F.lit(short))
        for full, short in SHORT_CATEGORY_NAMES.items()
    ]
    return F.when(col.isNotNull(), F.coalesce(*names, fallback))


def sentiment_matches(col: Column, stem: str) -> Column:
    """Accent- and case-insensitive substring test; null stays null."""
    return fold_latin(F.lower(col)).contains(stem)


def sentiment_bucket(col: Column) -> Column:
    return (
        F.when(sentiment_matches(col, "pos"), "positive").when(sentiment_matches(col, "neg"), "negative")
        .when(sentiment_matches(col, "neut"), "neutral")
    )


def sentiment_from_category(col: Column) -> Column:
    lowered = F.lower(F.coalesce(col, F.lit("")))
    return (
        F.when(lowered.contains("positif"), "positive").when(lowered.contains("négatif"), "negative")
        .otherwise("neutral")
    )


def first_truthy(*cols: Column, empty=""):
    """First value that is neither null nor the type's empty value ("" or 0)."""
    return F.coalesce(*[F.nullif(c, F.lit(empty)) for c in cols])


def place_key(place_id: Column, data_id: Column, name: Column, address: Column) -> Column:
    """Deduplication key of a place: its id, else the numeric id, else name and address."""
    label = F.concat(F.coalesce(name, F.lit("")), F.lit("-"), F.coalesce(address, F.lit("")))
    return F.coalesce(first_truthy(place_id, data_id), label)


def is_canonical_place_id(col: Column) -> Column:
    return F.coalesce(col.rlike(CANONICAL_PLACE_ID), F.lit(False))


def search_queries(business: Column, city: Column, business_type: Column | None = None) -> Column:
    """Search phrases for one business in one city, in the order they are tried."""
    def phrase(*parts):
        return F.concat_ws(" ", business, *[p if isinstance(p, Column) else F.lit(p) for p in parts])

    phrases = [phrase(city)]
    if business_type is not None:
        # Extra words per kind of business.
        extras = {
            ("bank", "banque"): ("agence", "succursale"),
            ("hotel", "hôtel"): ("hotel", "resort"),
            ("restaurant",): ("restaurant", "cuisine"),
        }
        given = F.nullif(business_type, F.lit("")).isNotNull()
        phrases.append(F.when(given, phrase(business_type, city)))
        for kinds, words in extras.items():
            phrases += [F.when(business_type.isin(*kinds), phrase(word, city)) for word in words]
    phrases += [phrase(city, "Morocco"), phrase("near", city, "Morocco")]
    return F.array_compact(F.array(*phrases))


def format_center(lat: Column, lng: Column, zoom: Column) -> Column:
    return F.format_string("@%.6f,%.6f,%s", lat, lng, zoom)


def parse_center(col: Column) -> Column:
    """Struct(lat, lng, zoom) of an ``@lat,lng,zoom`` text."""
    parts = F.split(F.btrim(col, F.lit("@")), ",")
    return F.struct(
        F.get(parts, 0).try_cast("double").alias("lat"), F.get(parts, 1).try_cast("double").alias("lng"),
        F.get(parts, 2).alias("zoom"),
    )


def display_city(name: Column, other_names: Column) -> Column:
    """French name, else the first word of the name."""
    return F.coalesce(other_names["name:fr"], F.split_part(name, F.lit(" "), F.lit(1)))
