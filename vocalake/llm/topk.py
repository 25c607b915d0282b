"""Exact top-k inner-product search as a Voronoi join of query groups and data cells."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIVOTS = 64
PIVOT_SAMPLE = 2_048
BLOCK_ROWS = 16_384
CHUNK_QUERIES = 8_192
SCALE = 256
AT_ONCE = 256
PARTS = 256


def usable(vector: Column) -> Column:
    """True where the vector and all its components are there and finite."""
    def finite(x: Column) -> Column:
        number = x.cast("double")
        return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))

    return vector.isNotNull() & F.forall(vector, finite)


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``id`` and ``v``: each component times ``scale``, rounded down, zeros up to the longest vector."""
    vector = F.col(vector_column)
    rows = vectors.filter(F.col(id_column).isNotNull() & usable(vector)).select(
        F.col(id_column).alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v")
    )
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy().astype(float)
    return values.reshape(rows, len(values) // max(1, rows))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different vectors, each the farthest of the sample from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def with_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with the place of the nearest pivot and the distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (pivots ** 2).sum(1)
        for batch in batches:
            data = matrix(batch.column(1), batch.num_rows)
            cell = (squares - 2 * data @ pivots.T).argmin(1) if batch.num_rows else np.zeros(0, int)
            distance = np.sqrt(((data - pivots[cell]) ** 2).sum(1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(distance, pa.float64())], ["id", "v", "cell", "distance"]
            )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<long>, cell int, distance double")


def reach(queries: np.ndarray, pivots: np.ndarray, radius: np.ndarray, nearest: list[np.ndarray], k: int):
    """Least score of a place among the k best, and upper bounds of the scores in each cell, by query.

    By Cauchy-Schwarz a vector at distance r from its pivot scores within |q| r of the pivot's score.
    ``nearest`` holds each cell's smallest distances, one row per id over all cells; so of k + 1 lower bounds
    at most one is the query's own.
    """
    at_pivot = queries @ pivots.T
    norm = np.sqrt((queries ** 2).sum(1))[:, None]
    slack = 1e-6 * (1 + np.abs(at_pivot)) + 1e-6 * norm
    lower = np.concatenate(
        [at_pivot[:, [j]] - norm * d[None, :] - slack[:, [j]] for j, d in enumerate(nearest)], axis=1
    )
    best = -np.sort(-lower, axis=1)
    least = best[:, k] if lower.shape[1] > k else np.full(len(queries), -np.inf)
    return least, at_pivot + norm * radius[None, :] + slack


def chunk_plan(sizes: dict[int, int], limit: int) -> dict[int, tuple[int, int]]:
    """First chunk and number of chunks of each query cell: neighbours share one, large cells get several."""
    plan, chunk, filled = {}, 0, 0
    for cell in sorted(sizes):
        parts = math.ceil(sizes[cell] / limit)
        if parts > 1 or filled + sizes[cell] > limit:
            chunk, filled = chunk + (filled > 0), 0
        plan[cell] = (chunk, parts)
        if parts > 1:
            chunk += parts
        else:
            filled += sizes[cell]
    return plan


def best_of_block(data: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best rows of a block for each query, ties to smaller ids, scores below the query's least left out."""
    names = ["query_id", "id", "score"]
    kinds = [queries.schema.field("query_id").type, data.schema.field("id").type, pa.int64()]
    if not data.num_rows or not queries.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names)
    data = data.sort_by("id")
    n = data.num_rows
    ids, points = data["id"].combine_chunks(), matrix(data["v"], n)
    asked, wanted = queries["query_id"].combine_chunks(), matrix(queries["v"], queries.num_rows)
    least = queries["least"].to_numpy()
    own = ids.to_numpy()
    exact = points.shape[1] * max(1.0, np.abs(points).max(initial=0)) * max(1.0, np.abs(wanted).max(initial=0)) * n < 2 ** 53
    parts = []
    for lo in range(0, len(wanted), AT_ONCE):
        some = slice(lo, lo + AT_ONCE)
        if exact:
            score = wanted[some] @ points.T
            order = score * n + np.arange(n - 1, -1, -1)
        else:
            score = wanted[some].astype(np.int64) @ points.T.astype(np.int64)
            order = np.empty(score.shape)
            for row, line in zip(order, score):
                row[np.lexsort((np.arange(n - 1, -1, -1), line))] = np.arange(n)
        other = own[None, :] != asked.to_numpy()[some][:, None]
        order = np.where(other, order, -np.inf)
        top = np.argpartition(order, max(0, n - k), axis=1)[:, -k:]
        row = np.repeat(np.arange(len(top)), top.shape[1])
        top = top.ravel()
        good = other[row, top] & (score[row, top] >= least[some][row])
        parts.append((lo + row[good], top[good], score[row, top][good]))
    row, place, score = (np.concatenate(p) for p in zip(*parts))
    return pa.table([asked.take(pa.array(row)), ids.take(pa.array(place)), pa.array(score.astype(np.int64))], names)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
    scale: int = SCALE, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """``query_id, rank, id, score``: the k highest integer inner products of each query row.

    ``is_query`` is a condition on the id column; candidates are all rows of another id. Vectors and
    queries are grouped by their nearest of a bounded number of pivots. Summaries of the cells (size,
    radius, smallest distances of distinct ids) bound each query's scores from below and above, and a query is sent only
    to cells that can hold one of its k best. Cells and query groups are cut into blocks of bounded size
    by a hash, so a hot cell is many tasks; each block of data meets each chunk of queries that needs it
    in one local product, and the blocks' winners are ranked by query.

    Vectors that are null or hold a null or non-finite component, and null ids, take no part. Vectors
    shorter than the longest count as filled with zeros. Equal scores go to the smaller id. Rows that
    repeat a query's id are one query; other repeated rows are candidates each. A query without
    candidates gives no rows, as does an empty table; other columns are ignored.
    """
    rows = whole_numbers(vectors, id_column, vector_column, scale)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).toArrow()
    centres = choose_pivots(matrix(sample["v"], sample.num_rows), pivots)
    kind = rows.schema["id"].dataType.simpleString()
    data = stored(with_cells(rows, centres))
    place = F.row_number().over(Window.partitionBy("cell", "part").orderBy("distance"))
    once = data.groupBy("id").agg(F.min(F.struct("distance", "cell")).alias("row")).select("id", "row.*")
    spread = once.select("cell", "distance", F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part"))
    near = spread.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("cell").agg(
        F.slice(F.array_sort(F.collect_list("distance")), 1, k + 1).alias("near")
    )
    sizes_of = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
    summary = sizes_of.join(near, "cell", "left").collect()
    cells = {r["cell"]: r for r in summary}
    radius = np.array([cells[j]["radius"] if j in cells else -np.inf for j in range(len(centres))])
    nearest = [np.array((cells[j]["near"] or []) if j in cells else []) for j in range(len(centres))]
    blocks = {j: math.ceil(r["n"] / block_rows) for j, r in cells.items()}

    asked = data.withColumnRenamed("id", id_column).filter(is_query).withColumnRenamed(id_column, "id").dropDuplicates(["id"])
    sizes = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    plan = chunk_plan(sizes, chunk_queries)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            least, most = reach(matrix(batch.column(1), batch.num_rows), centres, radius, nearest, k)
            row, cell = np.nonzero(most >= least[:, None])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(pa.array(row)) for i in (0, 1, 2)]
                + [pa.array(least[row], pa.float64()), pa.array(cell, pa.int32())],
                ["query_id", "v", "home", "least", "cell"],
            )

    def by_cell(values: dict[int, int], cell: str, default: int = 1) -> Column:
        found = F.lit(default)
        for key, value in values.items():
            if value != default:
                found = F.when(F.col(cell) == key, F.lit(value)).otherwise(found)
        return found

    sent = asked.mapInArrow(send, f"query_id {kind}, v array<long>, home int, least double, cell int")
    part = F.pmod(F.xxhash64("query_id"), by_cell({c: n for c, (_, n) in plan.items()}, "home"))
    sent = sent.withColumn("chunk", by_cell({c: first for c, (first, _) in plan.items()}, "home", 0) + part)
    needed = sent.select(F.col("cell").alias("wanted"), F.col("chunk").alias("group")).distinct()
    replicated = data.select("id", "v", "cell", F.pmod(F.xxhash64("id"), by_cell(blocks, "cell")).alias("block"))
    replicated = replicated.join(needed, F.col("cell") == F.col("wanted")).drop("wanted")
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), by_cell(blocks, "cell") - 1)))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of_block(left, right, k)

    found = replicated.groupBy("cell", "block", "group").cogroup(
        sent.select("query_id", "v", "least", "cell", "block", "chunk").groupBy("cell", "block", "chunk")
    ).applyInArrow(solve, f"query_id {kind}, id {kind}, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
