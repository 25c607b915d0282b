"""Small tables with awkward rows, and rows as plain Python values."""
import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, start=0):
    """A documents table of the texts; ids count up from ``start``."""
    rows = [(start + i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def awkward(spark):
    """Null and empty texts, null ids and values, repeated rows, ties, a long text, clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, "en"), (2, "", None), (3, "one two three four five six seven", "en"),
        (3, "one two three four five six seven", "en"), (4, "ONE two three four five six seven", "fr"),
        (None, "one two three four five six seven", "en"), (5, "a\nb\nc\na\nb\nc\na\nb\nc", "en"), (6, long, "en"),
        (7, " \t\n\n\n\n", "en"), (8, "Straße ÄÖ ıİ 𐐨 12 x\x00y", None), (9, "a", "en"), (None, None, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    columns = ["id", "row", "lines", "version", "digest", "content", "words", "spans", "n", "component", "node", "a", "length"]
    clashing = frame.selectExpr("doc_id", "text", "lang", "'s' AS source", "0L AS n_chars", *[f"'x' AS `{c}`" for c in columns])
    return clashing, rows


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def near_texts(seed=7, groups=12, size=120):
    """Texts with near copies at many distances, exact copies, and unrelated ones."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(4_000)}" for _ in range(size)]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(size)] = f"w{rng.randrange(4_000)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts
