"""Public byte-level vocabularies, and token counts attributed to lines or fields."""
from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_FILE = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def load_encoding(path: str):
    """The rank file as an encoder without special tokens, and the byte length of each token."""
    import tiktoken

    ranks = read_ranks(path)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    encoding = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return encoding, lengths


def attribute(lengths: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that end beyond it.

    ``lengths`` are the byte lengths of consecutive tokens; section i is bytes ``bounds[i]`` to
    ``bounds[i + 1]``. A token counts for the section that holds its first byte; where empty sections
    share that byte with a filled one, for the filled one.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    place = np.searchsorted(bounds, starts, "right") - 1
    sections = len(bounds) - 1
    crossing = ends > bounds[np.minimum(place + 1, sections)]
    return np.bincount(place, minlength=sections), np.bincount(place[crossing], minlength=sections)


def characters_before(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of code points that start before each byte position."""
    firsts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return firsts[bounds]


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Byte bounds of the lines, each with its newline; a text without characters is one empty line."""
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends])


def line_token_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks_path: str | None = None
) -> DataFrame:
    """One row per line: ``id, section, char_start, char_end, n_tokens, n_crossing``.

    Each whole text is encoded once; the tokens' spans are joined with the lines' spans, a merge of two
    sorted lists. A token counts for the line that holds its first byte, so the counts of a document add
    up to its tokens; ``n_crossing`` of them end in a later line. A line includes its newline. Null and
    empty texts are one line without tokens. Repeated rows are counted each, other columns ignored, and
    an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.array(F.coalesce(F.col(text_column), F.lit(""))).alias("parts"))
    return _sections(rows, ranks_path, by_line=True)


def field_token_counts(
    rows: DataFrame, id_column: str, fields: list[str], ranks_path: str | None = None
) -> DataFrame:
    """As ``line_token_counts`` with the given string columns, joined without a separator, as sections.

    Section i is the i-th field; null fields count as empty and get a row too.
    """
    parts = F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields])
    return _sections(rows.select(F.col(id_column).alias("id"), parts.alias("parts")), ranks_path, by_line=False)


def _sections(rows: DataFrame, ranks_path: str | None, by_line: bool) -> DataFrame:
    path = ranks_path or public_tokenizers.path(RANK_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = load_encoding(path)
        for batch in batches:
            owners, columns = [], []
            for row, parts in enumerate(batch.column(1)):
                fields = parts.as_py()
                text = "".join(fields)
                data = np.frombuffer(text.encode(), np.uint8)
                bounds = line_bounds(data) if by_line else np.cumsum([0, *(len(f.encode()) for f in fields)])
                ids = np.asarray(encoding.encode_ordinary(text), np.int64)
                counts, crossing = attribute(lengths[ids], bounds)
                at = characters_before(data, bounds)
                owners.append(np.full(len(counts), row))
                columns.append(np.stack([np.arange(len(counts)), at[:-1], at[1:], counts, crossing]))
                if sum(map(len, owners)) >= 100_000:
                    yield table(batch, owners, columns)
                    owners, columns = [], []
            if owners:
                yield table(batch, owners, columns)

    def table(batch: pa.RecordBatch, owners: list, columns: list) -> pa.RecordBatch:
        values = np.concatenate(columns, axis=1)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(np.concatenate(owners)))] + [pa.array(v.astype(np.int64)) for v in values],
            ["id", "section", "char_start", "char_end", "n_tokens", "n_crossing"],
        )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, section long, char_start long, char_end long, n_tokens long, n_crossing long"
    )
