"""Audit of how filters interact: path counts over the lattice of the sets of filters already applied."""
from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
FILTERS = "ABCDE"
REPEATED = "E"
MOST_FILTERS = 7


def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """For every set of filters, as bits: the orders of its members, and the orders of those still to come.

    Counted along the edges of the lattice, forward from the empty set and backward from the full one.
    """
    states = 1 << filters
    reaching, leaving = [1] + [0] * (states - 1), [0] * (states - 1) + [1]
    for state in range(states):
        for f in range(filters):
            if not state >> f & 1:
                reaching[state | 1 << f] += reaching[state]
    for state in reversed(range(states)):
        for f in range(filters):
            if not state >> f & 1:
                leaving[state] += leaving[state | 1 << f]
    return reaching, leaving


def lattice_edges(filters: int) -> list[tuple[int, int, int]]:
    """``state, filter, orders`` of every edge: the orders that apply the filter right after the state's own."""
    reaching, leaving = path_counts(filters)
    return [
        (state, f, reaching[state] * leaving[state | 1 << f])
        for state in range(1 << filters) for f in range(filters) if not state >> f & 1
    ]


def order_steps(letters: str) -> list[tuple[str, int, int]]:
    """``filter_order, step, edge`` of every order: each step is an edge, by its place in ``lattice_edges``."""
    places = {(state, f): i for i, (state, f, _) in enumerate(lattice_edges(len(letters)))}
    rows = []
    for order in permutations(range(len(letters))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(letters[i] for i in order), step, places[state, f]))
            state |= 1 << f
    return rows


def filter_interactions(rows: DataFrame, letters: str = FILTERS) -> DataFrame:
    """What every filter removes in every order: ``part, filter_order, step`` and counts.

    ``rows`` holds one row per document with ``part``, ``fails`` (bit i set: fails the filter of letter
    i), ``good`` and ``toxic`` (0 or 1). They are reduced to one count per part and set of failures, at
    most 2^k for k filters, and these to one row per part. A document lives in a state of the lattice
    while it fails none of the state's filters; an edge removes those that live in its state and fail
    its filter. The removals of all edges of a filter, weighted by the orders that use the edge, sum to
    ``shapley``; the steps of the k! orders read their counts from the same edges, joined on the edge.

    Counts of a part: ``kept`` and ``removed`` at the step, ``redundant`` (failing, but removed before),
    ``unique_fails`` (failing this filter only), ``good_lost`` and ``toxic_lost`` (removed here with that
    mark). Parts follow from the rows, so an empty table gives none; a null part counts as the empty
    string, null failures and marks as none. At most MOST_FILTERS filters, as orders grow by factorial.
    """
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) != len(letters):
        raise ValueError(f"need 1 to {MOST_FILTERS} different letters, got {letters!r}")
    counted = rows.groupBy(
        F.coalesce("part", F.lit("")).alias("part"), F.coalesce("fails", F.lit(0)).cast("int").alias("fails")
    ).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"),
    )
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))

    def total(of: str, holds) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda acc, x: acc + F.when(holds(x["fails"]), x[of]).otherwise(0))

    spark, lattice = rows.sparkSession, lattice_edges(len(letters))
    edges = spark.createDataFrame(
        [(i, s, 1 << f, s | 1 << f, n) for i, (s, f, n) in enumerate(lattice)],
        "edge int, state int, bit int, after int, orders long",
    )
    state, bit, after = F.col("state"), F.col("bit"), F.col("after")

    def removed(mask: Column) -> Column:
        return (mask.bitwiseAND(state) == 0) & (mask.bitwiseAND(bit) != 0)

    numbered = parts.select("part", "sets", F.explode(F.sequence(F.lit(0), F.lit(len(lattice) - 1))).alias("edge"))
    walked = numbered.join(F.broadcast(edges), "edge").select(
        "part", "edge", "bit", "orders",
        total("n", lambda m: m.bitwiseAND(after) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(state) != 0) & (m.bitwiseAND(bit) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
    )
    shares = walked.groupBy("part", "bit").agg(
        F.sum(F.col("orders") * F.col("removed")).alias("shapley"),
        F.collect_list(F.struct(
            "edge", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"
        )).alias("edges"),
    ).select("part", "shapley", F.inline("edges"))
    steps = spark.createDataFrame(order_steps(letters), "filter_order string, step int, edge int")
    return shares.join(F.broadcast(steps), "edge").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def text_failures(docs: DataFrame, id_column: str, text_column: str, part_column: str) -> DataFrame:
    """``id, part, digest, fails`` per row: bits 0 to 3 for the filters A to D, which see one text alone."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(part_column).cast("string").alias("part"), text.alias("text"),
        F.regexp_extract_all(text, F.lit(f"({WORD})")).alias("words"),
    )
    failing = [
        F.size("words") < 50,
        F.size(F.array_distinct("words")) * 100 < F.size("words") * 65,
        F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.char_length("text") * 5,
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    fails = sum((F.when(broken, 1 << i).otherwise(0) for i, broken in enumerate(failing)), F.lit(0))
    return rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), fails.alias("fails"))


def with_repeats(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` with ``bit`` set in ``fails`` where a smaller id has the same digest.

    The smallest id of a digest is an aggregate, which shrinks a hot text to one row a task; rows meet it
    on digest and id together, so copies of a hot text spread over their ids. Null ids are neither
    smaller than any nor fail.
    """
    first = rows.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"))
    marked = rows.join(first.withColumn("first", F.lit(True)), ["digest", "id"], "left")
    repeated = F.col("id").isNotNull() & F.col("first").isNull()
    return marked.withColumn("fails", F.col("fails") + F.when(repeated, bit).otherwise(0)).drop("first")


def audit_filters(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """``filter_interactions`` of five filters over whole texts, per part, for all 120 orders.

    Failing: A under 50 words; B under 65 % distinct words, case-sensitive; C over 5 % of the code points
    in A-Z; D holds one of ``#$%&*|``; E identical to the text of a smaller id anywhere in the table,
    removed or not. Texts are read once and reduced to failures and a sha256 digest, by which E compares.

    Null texts count as empty, null parts as the empty string. Marks come from ``labels`` by id: a
    document is good (toxic) if any row of its id says quality (toxic) 1; absent and null marks are 0.
    Repeated rows count each, and rows of one id and text are not smaller than each other. Other columns
    are ignored; an empty table of documents gives no rows.
    """
    rows = stored(text_failures(docs, id_column, text_column, part_column))
    judged = with_repeats(rows, 1 << FILTERS.index(REPEATED))
    marks = labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    return filter_interactions(judged.join(marks, "id", "left").select("part", "fails", "good", "toxic"))
