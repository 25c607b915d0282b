"""Quality rules: a table of thresholds compiled into one projection of native expressions."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SYMBOL = "[#*$%&|<>]"
WINDOW = 3
MARKS = r"""!-/:-@\[-`{-~«»„“”‘’…¿¡"""

# Frequent words of English, French, German, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = (
    "the of and to in is that for with as on be by this are was from at an or it have not "
    "le la les de des du et un une en que est pour dans qui au aux sur avec ce "
    "der die das und zu den von mit ein eine ist nicht auf für im dem sich des auch "
    "el los las y del que por con para una se su al es como "
    "il di che e per non sono della con si "
    "o os as do da em um uma não com para "
    "het een van en dat niet op te zijn met"
)


@dataclass(frozen=True)
class Rule:
    """Bounds in percent of ``part`` against ``whole``, both measures; ``whole`` "" bounds the measure itself."""

    name: str
    part: str
    whole: str = ""
    at_least: int | None = None
    at_most: int | None = None


THRESHOLDS = (
    Rule("few_words", "n_words", at_least=50),
    Rule("repeated_words", "n_repeat_words", "n_words", at_most=50),
    Rule("word_length", "word_chars", "n_words", at_least=200, at_most=1_500),
    Rule("symbols", "n_symbols", "n_words", at_most=10),
    Rule("words_with_letters", "n_letter_words", "n_words", at_least=80),
    Rule("stop_words", "n_stop_words", "n_words", at_least=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", at_most=35),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", at_most=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", at_most=30),
)
BASE = ("few_words", "repeated_words")


def stop_word_pattern(words: str = STOP_WORDS) -> str:
    """A whole word that is one of ``words`` once marks around it are dropped; A-Z match either case."""
    listed = "|".join(sorted(set(words.split())))
    return rf"(?i)(?<![^{SPACE}])[{MARKS}]*+(?:{listed})[{MARKS}]*+(?![^{SPACE}])"


def repeated_places(windows: Column, ordered: Column) -> Column:
    """Positions of the windows whose key a neighbour in the order by key shares."""
    def shared(at: Column) -> Column:
        key = ordered[at]["key"]
        return key.eqNullSafe(F.get(ordered, at - 1)["key"]) | key.eqNullSafe(F.get(ordered, at + 1)["key"])

    return F.transform(F.filter(F.sequence(F.lit(0), F.size(windows) - 1), shared), lambda at: ordered[at]["at"])


def quality_measures(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stop_words: str = STOP_WORDS
) -> DataFrame:
    """One row per input row: ``id`` and the long counts that the thresholds name.

    Words are runs without space and the ASCII controls 9 to 13, lines end at each newline, and only
    lines with a word count. ``word_chars`` counts the code points in words, ``n_dup_lines`` the lines
    equal to an earlier one, ``n_repeat_words`` the words inside windows of three words that occur twice
    or more, the first occurrence included. Windows compare by 64-bit hashes of their words: two of the
    n windows of one text clash with a probability below n * n / 2^65. Everything is a native expression
    of the row's own text, so nothing is shuffled.

    Null and empty texts have zero everywhere; whole texts of any length count; repeated rows are
    measured each; other columns are ignored whatever their names; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    split = docs.select(
        F.col(id_column).alias("id"), text.alias("text"),
        F.regexp_extract_all(text, F.lit(f"({WORD})")).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    keyed = split.withColumn("windows", F.when(
        F.size("words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - WINDOW),
            lambda at: F.xxhash64(*[F.col("words")[at + i] for i in range(WINDOW)]),
        ),
    ))
    ordered = keyed.withColumn("ordered", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda key, at: F.struct(key.alias("key"), at.alias("at")))),
    ))
    placed = ordered.withColumn("places", F.when(
        F.col("ordered").isNotNull(), repeated_places(F.col("windows"), F.col("ordered"))
    ))
    covered = F.size(F.array_distinct(F.flatten(
        F.transform("places", lambda at: F.transform(F.array(*map(F.lit, range(WINDOW))), lambda i: at + i))
    )))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOL)),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.col("places").isNull(), 0).otherwise(covered),
        "n_letter_words": F.regexp_count("text", F.lit(rf"[^{SPACE}\p{{L}}]*+\p{{L}}[^{SPACE}]*+")),
        "n_stop_words": F.regexp_count("text", F.lit(stop_word_pattern(stop_words))),
        "n_bullet_lines": F.size(F.filter("lines", lambda line: line.rlike(rf"^[{SPACE}]*[•‣▪*-]"))),
        "n_ellipsis_lines": F.size(F.filter("lines", lambda line: line.rlike(rf"(\.\.\.|…)[{SPACE}]*$"))),
    }
    # Behind a generator no later filter on a count is pushed down, which would evaluate the arrays again.
    measured = F.struct(*[count.cast("long").alias(name) for name, count in counts.items()])
    return placed.select("id", F.inline(F.array(measured)))


def fails(rule: Rule) -> Column:
    """Whether a row of measures breaks the bounds; integers on both sides, so no ratio is rounded."""
    part = F.col(rule.part) * (100 if rule.whole else 1)
    whole = F.col(rule.whole) if rule.whole else F.lit(1)
    broken = F.lit(False)
    if rule.at_least is not None:
        broken = broken | (part < whole * rule.at_least)
    if rule.at_most is not None:
        broken = broken | (part > whole * rule.at_most)
    return broken


def failed_rules(thresholds: Sequence[Rule] = THRESHOLDS) -> Column:
    """The names of the rules that a row of measures breaks, in the order of the table."""
    return F.array_compact(F.array(*[F.when(fails(rule), F.lit(rule.name)) for rule in thresholds]))


def judge_quality(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    thresholds: Sequence[Rule] = THRESHOLDS, stop_words: str = STOP_WORDS,
) -> DataFrame:
    """The rows of ``quality_measures`` with ``failed`` (rules broken), ``base_failed`` and ``kept``.

    The table of thresholds is compiled into one projection over the measures. A measure bounded against
    an absent whole (no words, no lines) breaks nothing but a least number of its own. ``base_failed``
    tells whether a rule named in BASE is broken; a document is kept when no rule is. Stop words are
    those of the languages listed; for texts in others pass their words. Null and empty texts have too
    few words and fail; an empty table gives no rows.
    """
    judged = quality_measures(docs, id_column, text_column, stop_words).withColumn("failed", failed_rules(thresholds))
    return judged.withColumns({
        "base_failed": F.arrays_overlap("failed", F.array(*map(F.lit, BASE))), "kept": F.size("failed") == 0,
    })
