"""Exact top-k search by inner product with pivot-table elimination.

Vectors are dealt into blocks of bounded size. Each block keeps a table of its
vectors' distances to many pivots (spread-out vectors of the block). For a query
``q`` and a candidate ``x`` every pivot ``p`` gives the lower bound
``|d(q,p) - d(x,p)| <= d(q,x)``; as ``<q,x> = (|q|^2 + |x|^2 - d(q,x)^2) / 2``,
the largest lower bound caps the score. Candidates are evaluated by falling cap
until the cap of the next one is below the k-th score, so the result is exact.
Per block and query only k rows leave the task; a second ranking merges blocks.

The query set is matched with all rows in blocks: each task holds one block of
queries and one of candidates, both bounded, whatever the table's size.

Defined cases: vectors that are null or hold a null or non-finite component take
no part, as query or as candidate; vectors are compared with those of their own
dimension; ties go to the smaller id; a repeated id is a row of its own, except
that a query never meets its own id; rows with a null id are left out; fewer
than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import prepare

RESULT_SCHEMA = "query_id long, vec_id long, score long"


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def pick_pivots(vectors: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first vectors, so that pivots lie apart."""
    chosen = [0]
    nearest = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(vectors)):
        at = int(nearest.argmax())
        if nearest[at] <= 0:
            break
        chosen.append(at)
        nearest = np.minimum(nearest, ((vectors - vectors[at]) ** 2).sum(axis=1))
    return vectors[chosen]


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, pivots: int) -> tuple[list[tuple[int, int, int]], int]:
    """The k best (query, row, score) of each query in this block, and how many scores were evaluated."""
    table = pick_pivots(rows, pivots)
    distance = lambda a: np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (table * table).sum(axis=1)[None] - 2 * a @ table.T, 0))
    to_rows, to_queries = distance(rows), distance(queries)
    row_norm, query_norm = (rows * rows).sum(axis=1), (queries * queries).sum(axis=1)
    found, evaluated = [], 0
    for i, query in enumerate(queries):
        lower = np.zeros(len(rows))
        for p in range(to_rows.shape[1]):
            np.maximum(lower, np.abs(to_rows[:, p] - to_queries[i, p]), out=lower)
        # rounding must not push a cap below a true score
        lower = np.maximum(lower - 1e-6 * (1 + lower), 0)
        caps = (query_norm[i] + row_norm - lower * lower) / 2 + 1e-6 * (1 + query_norm[i] + row_norm)
        caps[row_ids == query_ids[i]] = -np.inf
        order = np.argsort(-caps, kind="stable")
        best: list[tuple[int, int]] = []
        at, step = 0, max(64, 4 * k)
        while at < len(order):
            part = order[at : at + step]
            if caps[part[0]] == -np.inf or len(best) == k and caps[part[0]] < -best[-1][0]:
                break
            part = part[caps[part] > -np.inf]
            scores = np.rint(rows[part] @ query).astype(np.int64)
            evaluated += len(part)
            best = sorted([*best, *zip((-scores).tolist(), row_ids[part].tolist())])[:k]
            at, step = at + step, min(4096, 2 * step)
        found += [(int(query_ids[i]), vec_id, -score) for score, vec_id in best]
    return found, evaluated


def _pairs(k: int, pivots: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if queries.num_rows and rows.num_rows:
            dim = queries.column("dim")[0].as_py()
            found, _ = search_block(_vectors(queries.column("vec"), dim), queries.column("vec_id").to_numpy(), _vectors(rows.column("vec"), dim), rows.column("vec_id").to_numpy(), k, pivots)
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def quantised(embedding: str | Column) -> Column:
    """floor(256 * x) of every component as double; null for a vector that takes no part."""
    column = F.col(embedding) if isinstance(embedding, str) else embedding
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite & (F.size(column) > 0), F.transform(column, lambda x: F.floor(x.cast("double") * 256).cast("double")))


def top_k(embeddings: DataFrame, query: Column, k: int = 5, pivots: int = 32, block_rows: int = 4096) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each row where ``query`` holds.

    ``embeddings`` has vec_id and embedding (array of numbers). Returns
    query_id, rank (from 1), vec_id, score.
    """
    spark = prepare(embeddings.sparkSession)
    rows = (
        embeddings.where(F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding").alias("vec"), query.alias("is_query"))
        .where("vec is not null")
        .withColumn("dim", F.size("vec"))
    )
    dims = [(r["dim"], r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).where("q > 0").collect()]
    sides = []
    for dim, n, q in dims:
        row_blocks, query_blocks = -(-n // block_rows), -(-q // block_rows)
        own = rows.where(F.col("dim") == dim)
        block = lambda blocks: F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int")
        each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        left = own.where("is_query").select("vec_id", "vec", "dim", block(query_blocks).alias("qb")).select("*", each(row_blocks).alias("rb"))
        right = own.select("vec_id", "vec", "dim", block(row_blocks).alias("rb")).select("*", each(query_blocks).alias("qb"))
        keys = ["dim", "qb", "rb"]
        sides.append(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_pairs(k, pivots), RESULT_SCHEMA))
    if not sides:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = sides[0]
    for other in sides[1:]:
        found = found.unionByName(other)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
