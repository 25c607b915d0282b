"""Packing of token sequences by exact complements, then best fit, on a histogram of lengths."""
from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import RANK_FILE, load_encoding

CAPACITY = 2048
END = 0


def token_pieces(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
    ranks_path: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A text's ids are those of the byte-level vocabulary without special tokens, then id 0; strings that
    look like special tokens are ordinary text. A text of more ids than ``capacity`` is cut so that only
    its first piece may be shorter. Null and empty texts are one piece of length 1. Repeated rows give
    repeated pieces, other columns are ignored, and an empty table gives no rows.
    """
    path = ranks_path or public_tokenizers.path(RANK_FILE)
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = load_encoding(path)
        for batch in batches:
            owners, pieces, ids_of = [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.array(encoding.encode_ordinary(text.as_py() or "") + [END], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                if len(ids) <= capacity:
                    cuts = [0, len(ids)]
                for piece, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    owners.append(row)
                    pieces.append((piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    if with_ids:
                        ids_of.append(ids[start:end].astype(np.int32))
            columns = [batch.column(0).take(pa.array(owners, pa.int64()))]
            columns += [pa.array(v, t) for v, t in zip(
                zip(*pieces) if pieces else [[]] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids_of, pa.list_(pa.int32()))] * with_ids, names)

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)


class Complements:
    """Finds lengths that exactly fill a gap, while counts of lengths only ever fall.

    ``pair_at[s]`` and ``triple_at[g]`` point at the largest member of the next candidate combination of
    that sum; a candidate that lost a member never returns, so pointers only move down.
    """

    def __init__(self, counts: list[int]):
        self.counts = counts
        top = len(counts)
        self.pair_at = [min(s - 1, top - 1) for s in range(top)]
        self.triple_at = [min(g - 2, top - 1) for g in range(top)]

    def pairs(self, total: int) -> Iterator[tuple[int, int]]:
        counts = self.counts
        settled = True
        for big in range(self.pair_at[total], (total - 1) // 2, -1):
            if counts[big] and counts[total - big]:
                settled = False
                yield big, total - big
            elif settled:
                self.pair_at[total] = big - 1

    def triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        settled = True
        for big in range(self.triple_at[total], (total - 1) // 3, -1):
            found = False
            if self.counts[big]:
                for pair in self.pairs(total - big):
                    found = True
                    yield big, *pair
            if settled and not found:
                self.triple_at[total] = big - 1
            settled = settled and not found

    def fill(self, first: int, gap: int) -> tuple[dict[int, int], int] | None:
        """How often each length occurs in the first combination that holds ``first`` and fills ``gap``, and how many such sequences there are lengths for."""
        def candidates():
            yield (gap,)
            yield from self.pairs(gap)
            yield from self.triples(gap)

        for rest in candidates():
            times: dict[int, int] = {}
            for length in (first, *rest):
                times[length] = times.get(length, 0) + 1
            if copies := min(self.counts[length] // n for length, n in times.items()):
                return times, copies
        return None


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: runs ``(length, from, to, per_sequence, sequence, offset)``.

    Pieces of a length are numbered from 0; those from ``from`` to ``to`` lie ``per_sequence`` to a
    sequence from ``offset`` on, in consecutive sequences from ``sequence`` on. The longest lengths
    first take every combination of one, two or three lengths that fills them exactly, as often as the
    counts allow; what is left goes by best fit, longest first. Work depends on the number of distinct
    lengths, at most ``capacity``, not on the number of pieces.
    """
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    used = [0] * (capacity + 1)
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def place(pattern: list[tuple[int, int]], copies: int) -> None:
        nonlocal sequences
        offset = 0
        for length, times in pattern:
            runs.append((length, used[length], used[length] + copies * times, times, sequences, offset))
            used[length] += copies * times
            offset += length * times
        sequences += copies

    if counts[capacity]:
        place([(capacity, 1)], counts[capacity])
        counts[capacity] = 0
    index = Complements(counts)
    for length in range(capacity - 1, 0, -1):
        while counts[length] and (found := index.fill(length, capacity - length)):
            times, copies = found
            for member, n in times.items():
                counts[member] -= n * copies
            place(list(times.items()), copies)

    open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    gaps: list[int] = []
    closed: list[tuple[list[tuple[int, int]], int]] = []

    def put(pattern: list[tuple[int, int]], copies: int, gap: int) -> None:
        if not copies:
            return
        if not gap:
            closed.append((pattern, copies))
            return
        if gap not in open_bins:
            bisect.insort(gaps, gap)
        open_bins.setdefault(gap, []).append((pattern, copies))

    for length in range(capacity - 1, 0, -1):
        left = counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            gap = gaps[at] if at < len(gaps) else capacity
            pattern, copies = open_bins[gap].pop() if at < len(gaps) else ([], left)
            if at < len(gaps) and not open_bins[gap]:
                del open_bins[gap], gaps[at]
            times = gap // length
            full = min(copies, left // times)
            last = left - full * times if full < copies else 0
            put([*pattern, (length, times)], full, gap - times * length)
            put([*pattern, (length, last)], 1 if last else 0, gap - last * length)
            if pattern:
                put(pattern, copies - full - bool(last), gap)
            left -= full * times + last
    for group in [*closed, *(g for groups in open_bins.values() for g in groups)]:
        place(*group)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``token_pieces`` with ``sequence_id`` and ``offset`` added.

    Only the histogram of lengths, at most ``capacity`` rows, reaches the driver. Pieces of one length
    are numbered inside hashed slots whose offsets are prefix sums, so a hot length is spread: n pieces get
    about sqrt(n) slots, and neither a slot nor the prefix sums of a length are more than about sqrt(n)
    rows. Each piece then looks its number up in the runs of ``pack_lengths``. Sequences are gapless from
    offset 0 and hold at most ``capacity`` ids. An empty table gives no rows.
    """
    pieces = stored(pieces)
    carried = pieces.columns
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = F.lit([math.isqrt(histogram.get(length, 0)) + 1 for length in range(capacity + 1)])
    slot = F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.element_at(slots, F.col("length").cast("int") + 1))
    slotted = pieces.withColumn("slot", slot)
    sizes = slotted.groupBy("length", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    runs = np.array(sorted(pack_lengths(histogram, capacity)), np.int64).reshape(-1, 6)
    number = F.row_number().over(Window.partitionBy("length", "slot").orderBy("id", "piece", "start", "ids_crc32"))
    numbered = slotted.withColumn("number", number).join(bases, ["length", "slot"]).select(
        *carried, (F.col("number") - 1 + F.col("base")).alias("number")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (runs[:, 0] << 43) + runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            at = np.searchsorted(keys, (length << 43) + number, "right") - 1
            _, first, _, times, sequence, offset = runs[at].T
            columns = [batch.column(n) for n in carried]
            columns += [pa.array(sequence + (number - first) // times), pa.array(offset + (number - first) % times * length)]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")
