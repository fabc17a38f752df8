"""Exact top-k inner products by vector-approximation files.

Vectors lie in blocks.  Each block keeps, besides its exact vectors, the cell of every component on a grid of its own quantiles.
The grid cells bound every inner product from both sides, so a query scans cells only, drops what cannot reach
its k-th lower bound, and reads exact vectors in the order of their upper bounds until the k-th score is certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block and queries of a block, on average; one task holds one of each.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 2_048
#: Cells per component.
CELLS = 64
#: No score may reach this, by the greatest components of queries and vectors; a little below the range of long, as the bound is a double.
LARGEST = 2.0**63 * (1 - 2.0**-40)
#: Queries whose bounds are held at once, and exact vectors read at once for one query.
SOME_QUERIES, READ = 128, 32


def approximate(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (uint8) of each component, and per component and cell the least and greatest value in it."""
    n, d = vectors.shape
    cells = np.empty((n, d), dtype=np.uint8)
    low, high = np.zeros((d, CELLS)), np.zeros((d, CELLS))
    for j in range(d):
        column = np.sort(vectors[:, j])
        borders = np.unique(column[np.arange(CELLS) * n // CELLS])  # each cell begins at one of these
        cells[:, j] = np.searchsorted(borders, vectors[:, j], side="right") - 1
        low[j, : len(borders)] = borders
        ends = np.searchsorted(column, borders[1:], side="left")
        high[j, : len(borders)] = column[np.append(ends, n) - 1]
    return cells, low, high


def top_of_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score) of each query's k best in the block, rows with the query's own id aside."""
    cells, low, high = approximate(vectors)
    columns = np.arange(vectors.shape[1])
    middle, half = ((low + high) / 2)[columns, cells], ((high - low) / 2)[columns, cells]
    reach = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1]
    slack = reach * 2.0**-40 if reach >= 2.0**51 else 0.0  # below, all sums here are exact
    who, what, scores = [], [], []
    for at in range(0, len(queries), SOME_QUERIES):
        some = queries[at : at + SOME_QUERIES]
        centre, width = some @ middle.T.astype(np.float64), np.abs(some) @ half.T + slack
        own = query_ids[at : at + SOME_QUERIES, None] == ids[None, :]
        lower, upper = np.where(own, -np.inf, centre - width), np.where(own, -np.inf, centre + width)
        floor = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(some), -np.inf)
        for i in range(len(some)):
            left = np.flatnonzero((upper[i] >= floor[i]) & ~own[i])
            left = left[np.argsort(-upper[i][left], kind="stable")]
            best_id, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for begin in range(0, len(left), READ):
                if len(best) == k and upper[i][left[begin]] < best[-1]:
                    break  # an equal bound may still be a tie with a smaller id
                read = left[begin : begin + READ]
                best_id, best = np.append(best_id, ids[read]), np.append(best, vectors[read] @ some[i])
                order = np.lexsort((best_id, -best))[:k]
                best_id, best = best_id[order], best[order]
            who.append(np.full(len(best), at + i))
            what.append(best_id)
            scores.append(best)
    empty = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(who or empty), np.concatenate(what or empty), np.concatenate(scores or empty)


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as double, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor empty, all components present and finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(good(x), F.lit(False)))


def check_range(clean: DataFrame, factor: int = 256) -> None:
    """Raises an error if a score between a query and a vector could leave the range of long.  Needs vector, d and asks."""
    reach = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))) * factor + 1
    most = clean.select("d", "asks", reach.alias("reach")).groupBy("d").agg(F.max("reach").alias("v"), F.max(F.when(F.col("asks"), F.col("reach"))).alias("q"))
    worst = most.agg(F.max(F.col("v") * F.col("q") * F.col("d"))).collect()[0][0]
    if worst is not None and worst >= LARGEST:
        raise ValueError(f"components are too large: scores may reach {worst:.3g}, beyond the range of long")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest integer inner products of each query, ties to smaller ids.

    Rows for which ``is_query`` holds are the queries; every row with another id and as many components is a candidate.  Vectors are scaled
    by ``scaled``; rows without an id or with a vector that is not ``usable`` take no part; components so large
    that a score could leave the range of long are an error.  Repeated rows are one query
    each per distinct vector, and candidates each.  Queries without candidates give no rows, as does an empty table.

    Every block of queries meets every block of vectors in one task; blocks have a fixed size, so a task's memory does not grow.
    """
    clean = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    clean = clean.withColumn("vector", F.when(usable(F.col("vector")), F.col("vector"))).where("vector is not null").withColumn("d", F.size("vector"))
    check_range(clean)
    clean = clean.withColumn("vector", scaled(F.col("vector")))
    n, m = clean.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).collect()[0]
    blocks, turns = max(1, -(-n // BLOCK_VECTORS)), max(1, -(-m // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")
    turn = F.pmod(F.xxhash64("id", "vector"), F.lit(turns)).cast("int")
    data = clean.select("d", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "id", "vector")
    asked = clean.where("asks").select("d", "id", "vector").distinct()
    asked = asked.select("d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), turn.alias("turn"), "id", "vector")

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(table.num_rows, -1).astype(np.int64)

    def search(asked: pa.Table, data: pa.Table) -> pa.Table:
        if not asked.num_rows or not data.num_rows:
            who, what, scores, queries = [], [], [], np.zeros(0, dtype=np.int64)
        else:
            queries = asked["id"].to_numpy()
            who, what, scores = top_of_block(matrix(asked), queries, matrix(data), data["id"].to_numpy(), k)
        asks = pa.array(np.asarray(who, dtype=np.int64))
        return pa.table({
            "query_id": pa.array(queries).take(asks), "query_hash": (asked["hash"].combine_chunks() if asked.num_rows else pa.array([], pa.int64())).take(asks),
            "vec_id": pa.array(np.asarray(what, dtype=np.int64)), "score": pa.array(np.asarray(scores, dtype=np.int64)),
        })

    keys = ("d", "block", "turn")
    found = asked.withColumn("hash", F.xxhash64("vector")).groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(
        search, "query_id long, query_hash long, vec_id long, score long",
    )
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
