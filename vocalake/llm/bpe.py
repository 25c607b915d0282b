"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and ids back to bytes."""
from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import read_ranks

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
CACHE = 300_000
DOCS_AT_ONCE = 500


def java_pattern(pattern: str) -> str:
    """The splitting pattern with white space in Unicode's sense, which Java's own class is not."""
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: its own rank, or those of its parts after all merges.

    From single bytes on, the leftmost pair of neighbours whose concatenation has the lowest rank is
    joined until no pair has a rank. Pairs wait in a heap, so a word of n bytes takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    size = len(word)
    end = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    pairs = [(ranks[word[i:i + 2]], i, i + 1, i + 2) for i in range(size - 1) if word[i:i + 2] in ranks]
    heapq.heapify(pairs)
    while pairs:
        _, start, middle, stop = heapq.heappop(pairs)
        if end[start] != middle or end[middle] != stop:
            continue
        end[start], end[middle] = stop, 0
        if stop < size:
            before[stop] = start
            if (rank := ranks.get(word[start:end[stop]])) is not None:
                heapq.heappush(pairs, (rank, start, stop, end[stop]))
        if start and (rank := ranks.get(word[before[start]:stop])) is not None:
            heapq.heappush(pairs, (rank, before[start], start, stop))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[word[at:end[at]]])
        at = end[at]
    return ids


def encode_words(words: pa.ListArray, known: dict[str, list[int]], ranks: dict[bytes, int]) -> pa.ListArray:
    """Ids of each document from its list of words; every distinct word is merged once."""
    bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
    distinct = words.flatten().dictionary_encode()
    spelled = []
    for word in distinct.dictionary.to_pylist():
        if (ids := known.get(word)) is None:
            ids = known[word] = merged(word.encode(), ranks)
        spelled.append(ids)
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    flat = np.fromiter((i for ids in spelled for i in ids), np.int32, int(sizes.sum()))
    place = distinct.indices.to_numpy()
    counts = sizes[place] if len(place) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    starts = (np.cumsum(sizes) - sizes)[place] if len(place) else counts
    ids = flat[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], counts)]
    return pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(ids, pa.int32()))


def encode(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """``id, ids``: token ids of each whole text, without special tokens.

    Spark splits each text by ``pattern``; every match is encoded by itself. Tasks merge each distinct
    word of their documents once and spread the ids over its places. No text is shuffled. Null and empty
    texts have no ids; repeated rows are encoded each; other columns are ignored; an empty table gives no
    rows.
    """
    ranks = read_ranks(ranks_path or public_tokenizers.path(RANK_FILE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(lo, DOCS_AT_ONCE)
                if len(known) > CACHE:
                    known.clear()
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), encode_words(some.column(1), known, ranks)], ["id", "ids"]
                )

    words = F.regexp_extract_all(
        F.coalesce(F.col(text_column), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    rows = docs.select(F.col(id_column).alias("id"), words.alias("words"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def literal(spark: SparkSession, value: object, kind: str) -> Column:
    """``value`` as one constant of a plan: a session variable, which the optimizer turns into a literal.

    Equal values share one variable of the session.
    """
    name = f"llm_{hashlib.md5(repr(value).encode()).hexdigest()}"
    row = spark.createDataFrame([(value,)], f"value {kind}")
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind}")
    spark.sql(f"SET VAR {name} = (SELECT value FROM {{row}})", row=row)
    return F.expr(name)


def decode(spark: SparkSession, ids: Column, ranks_path: str | None = None) -> Column:
    """The bytes of an array of ids, their pieces concatenated in order; null for null."""
    ranks = read_ranks(ranks_path or public_tokenizers.path(RANK_FILE))
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    spelled = literal(spark, pieces, "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(spelled, i)), ""))
