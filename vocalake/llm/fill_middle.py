"""Fill-in-the-middle rearrangement by one match of a counted pattern per text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
# Possessive, so matching a unit never backtracks and a counted group of units is one loop.
UNIT = rf"(?:[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50
SPM_RATE = 80


def draws(id_column: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of the hex sha256 of ``seed:id``; a null id is written as nothing."""
    written = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    digest = F.sha2(written.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def counted_pattern(first: Column, second: Column) -> Column:
    """A pattern whose groups are ``first`` units, the units up to ``second``, and the rest."""
    return F.format_string(
        rf"(?s)\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)(.*)\z", first, second - first
    )


def fill_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED,
    rate: int = RATE, spm_rate: int = SPM_RATE,
) -> DataFrame:
    """One row per input row: ``id, n, form, prefix, middle, suffix, output``.

    A text is n units, each a word with the white space before it, or white space at the end. Two places
    among the n + 1 between units and four numbers of a digest of the id decide the cuts and the form:
    ``plain`` leaves the text, ``psm`` gives prefix, suffix, middle and ``spm`` suffix, prefix, middle,
    each behind its mark. ``rate`` percent of the texts are cut, ``spm_rate`` percent of these as spm.
    The pattern of a row, with its own counts, captures all three parts in one match; the counted groups
    are possessive, which the regular-expression engine runs as loops without recursion, so texts may be
    of any length.

    Null counts as empty. Empty texts and those that hold a mark stay plain, with null parts. The same
    id and text always give the same row, so repeated rows agree; a null id draws from the seed alone.
    Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    drawn = docs.select(
        F.col(id_column).alias("id"), text.alias("text"), F.regexp_count(text, F.lit(UNIT)).alias("n"),
        F.array(*draws(F.col(id_column), seed)).alias("h"),
    )
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    formed = drawn.withColumn(
        "form",
        F.when((F.col("text") == "") | marked | (F.col("h")[2] % 100 >= rate), "plain")
        .when(F.col("h")[3] % 100 < spm_rate, "spm").otherwise("psm"),
    )
    cuts = [F.col("h")[i] % (F.col("n") + 1) for i in range(2)]
    pattern = counted_pattern(F.least(*cuts), F.greatest(*cuts))
    # The text holds no mark, and no mark ends as another begins, so the split gives back the three groups.
    match = F.split(F.regexp_replace("text", pattern, F.lit(f"$1{MIDDLE}$2{MIDDLE}$3")), MIDDLE, -1)
    parts = formed.withColumn("parts", F.when(F.col("form") != "plain", match))
    prefix, middle, suffix = (F.col("parts")[i] for i in range(3))
    return parts.select(
        "id", F.col("n").cast("long").alias("n"), "form",
        prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"),
        F.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text")).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_middle`` rearranged, rebuilt from its output and form alone."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
