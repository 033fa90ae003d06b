"""Hard-negative mining by product quantisation with stored residual norms.

For each anchor the rows of its label with the highest inner products are its
positives; a positive's hard negatives are the rows of other labels that score
close below it, in a *window* of shares of the positive's score.

Every vector is stored with a code, one centroid for each few components, and the
norm of what the centroids leave (its residual). For an anchor ``a`` a table holds
the inner products of its components with all centroids, so a row's approximate
score is a sum of table entries, and the true one differs by at most
``|a| * |residual|`` (Cauchy-Schwarz). These bounds filter rigorously: a row whose
bounds miss the window is never looked at, the others are taken by falling upper
bound and scored exactly in whole numbers until the window's ``k``-th best exact
score is above every upper bound that is left.

Work is dealt in blocks: rows in blocks of ``block_rows``, anchors in blocks of
``block_anchors``, so that a task holds one of each, whatever the table's size. The
positives come from the blocks of the anchor's own label, of which a frequent label
has as many as it needs; the negatives from all blocks. From a block and an anchor
at most ``k`` rows a window leave the task, and one ranking merges the blocks.

Centroids are fitted on at most ``sample_rows`` vectors (those of the smallest hashes
of id and vector); they decide how much the filter spares, never what is found.

Defined cases: rows with a null id or label, or whose vector is null, empty or holds
a null or non-finite component, take no part; vectors are compared with those of
their own dimension; ties go to the smaller id; a repeated id is a row of its own,
except that an anchor never meets its own id, as a positive or as a negative; an
anchor without positives, or a positive without rows in its window (as whenever its
score is negative, if the window is above shares of it), gives no rows; a repeated
anchor row counts once, and of several rows of one anchor's id the first by label and
vector asks; very long texts and other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from lodestack.llm.common import prepare, shuffle_partitions, small_side
from lodestack.storage import settled

CENTROIDS = 256
#: Scores beyond this count as this; whole numbers are exact up to 2^53.
LARGEST = 2.0**62
FOUND_SCHEMA = "anchor_id long, window int, vec_id long, score long"


@dataclass(frozen=True)
class Mining:
    """Positives an anchor, negatives a positive, the window in percent of the positive's score, and sizes of the index."""

    positives: int = 5
    negatives: int = 5
    low_percent: int = 80
    high_percent: int = 100
    components_per_code: int = 2
    sample_rows: int = 8192
    block_rows: int = 8192
    block_anchors: int = 1024


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component."""
    return np.floor(256.0 * vectors.astype(np.float64))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1))


class Codebook:
    """Centroids of each few components."""

    def __init__(self, sample: np.ndarray, components_per_code: int, rounds: int = 8) -> None:
        self.cuts = list(range(0, sample.shape[1], components_per_code)) + [sample.shape[1]]
        self.centroids = [self._fit(sample[:, a:b], rounds) for a, b in zip(self.cuts, self.cuts[1:])]

    @staticmethod
    def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return ((centroids * centroids).sum(axis=1) - 2 * vectors @ centroids.T).argmin(axis=1)

    @classmethod
    def _fit(cls, vectors: np.ndarray, rounds: int) -> np.ndarray:
        kinds = np.unique(vectors, axis=0)
        centroids = kinds[np.linspace(0, len(kinds) - 1, min(CENTROIDS, len(kinds))).astype(int)]
        for _ in range(rounds if len(kinds) > CENTROIDS else 0):
            nearest = cls._nearest(vectors, centroids)
            count = np.bincount(nearest, minlength=len(centroids))
            sums = np.stack([np.bincount(nearest, weights=vectors[:, d], minlength=len(centroids)) for d in range(vectors.shape[1])], axis=1)
            centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
        return centroids

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (a byte for each few components) and norms of the residuals, rounded up."""
        codes, left = np.empty((len(vectors), len(self.centroids)), dtype=np.uint8), np.zeros(len(vectors))
        for low in range(0, len(vectors), 4096):
            part = slice(low, low + 4096)
            for s, (a, b, centroids) in enumerate(zip(self.cuts, self.cuts[1:], self.centroids)):
                own = vectors[part, a:b]
                codes[part, s] = nearest = self._nearest(own, centroids)
                left[part] += ((own - centroids[nearest]) ** 2).sum(axis=1)
        return codes, np.sqrt(left) * (1 + 1e-9)

    def table(self, anchor: np.ndarray) -> np.ndarray:
        """Inner products of the anchor's components with every centroid: (codes, CENTROIDS)."""
        made = np.zeros((len(self.centroids), CENTROIDS))
        for s, (a, b, centroids) in enumerate(zip(self.cuts, self.cuts[1:], self.centroids)):
            made[s, : len(centroids)] = centroids @ anchor[a:b]
        return made


@dataclass
class Block:
    """Rows as a task holds them: ids, labels, whole-number vectors, places of their codes in a flat table, residual norms."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    places: np.ndarray
    residuals: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Block:
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1)
        places = (codes.astype(np.int32) + CENTROIDS * np.arange(codes.shape[1], dtype=np.int32)).T.copy()
        labels = np.array(table.column("label").to_pylist(), dtype=object)
        return Block(table.column("vec_id").to_numpy(), labels, _matrix(table.column("embedding")), places, table.column("residual").to_numpy())


def search(block: Block, allowed: np.ndarray, anchor: np.ndarray, book: Codebook, windows: list[tuple[float, float]], k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """The ``k`` best (row of the block, score) of each window of scores among the ``allowed`` rows, and how many were scored exactly."""
    table = book.table(anchor).ravel()
    rough = np.zeros(len(block.ids))
    for places in block.places:
        rough += table[places]
    reach = np.sqrt(anchor @ anchor) * block.residuals
    # rounding must not push a bound across a true score
    reach += 1e-9 * (np.abs(rough) + reach) + 1e-6
    upper, lower = rough + reach, rough - reach
    exact = np.full(len(block.ids), np.nan)
    found, scored = [], 0
    for low, high in windows:
        if low > high:
            found.append([])
            continue
        candidates = np.flatnonzero(allowed & (upper >= low) & (lower <= high))
        candidates = candidates[np.argsort(-upper[candidates], kind="stable")]
        best: list[tuple[int, int, int]] = []
        at, step = 0, 8 * k
        while at < len(candidates) and not (len(best) == k and upper[candidates[at]] < -best[-1][0]):
            part = candidates[at : at + step]
            new = part[np.isnan(exact[part])]
            exact[new] = np.clip(np.rint(block.vectors[new] @ anchor), -LARGEST, LARGEST)
            scored += len(new)
            inside = part[(exact[part] >= low) & (exact[part] <= high)]
            best = sorted([*best, *((-int(exact[i]), int(block.ids[i]), int(i)) for i in inside)])[:k]
            at, step = at + step, min(4096, 2 * step)
        found.append([(i, -score) for score, _, i in best])
    return found, scored


def _encoder(book: Codebook) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, left = book.encode(_matrix(batch.column("embedding")))
                batch = batch.append_column("codes", pa.array([c.tobytes() for c in codes], pa.binary()))
                yield batch.append_column("residual", pa.array(left))

    return run


def _searcher(book: Codebook, k: int, same_label: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Searches one block of rows for one block of anchors; an anchor's windows are lists of low and high scores."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        if anchors.num_rows and rows.num_rows:
            block, vectors = Block.of(rows), _matrix(anchors.column("embedding"))
            lows, highs = anchors.column("lows").to_pylist(), anchors.column("highs").to_pylist()
            allowed_of: dict[object, np.ndarray] = {}
            for i, (anchor_id, label) in enumerate(zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist())):
                if label not in allowed_of:
                    allowed_of[label] = (block.labels == label) == same_label
                allowed = allowed_of[label] & (block.ids != anchor_id)
                best, _ = search(block, allowed, vectors[i], book, list(zip(lows[i], highs[i])), k)
                found += [(anchor_id, w, int(block.ids[row]), score) for w, rows_of in enumerate(best) for row, score in rows_of]
        columns = list(zip(*found)) or [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor_id", "window", "vec_id", "score"])

    return run


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` highest scores of each key with their rank, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _grid(anchors: DataFrame, rows: DataFrame, keys: list[str], book: Codebook, k: int, same_label: bool, groups: int) -> DataFrame:
    """Each block of anchors against each block of rows, of which there are about ``groups`` pairs; both sides carry how many blocks the other has."""
    tasks = max(1, min(shuffle_partitions(rows.sparkSession), groups), groups // 4)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.select("*", each("row_blocks").alias("row_block")).drop("row_blocks", "anchor_blocks")
    right = rows.select("*", each("anchor_blocks").alias("anchor_block")).drop("row_blocks", "anchor_blocks")
    by = [*keys, "anchor_block", "row_block"]
    # new names for the anchors' columns, as both sides come from one table
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    left, right = left.repartition(tasks, *by), right.repartition(tasks, *by)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_searcher(book, k, same_label), FOUND_SCHEMA)


def _dealt_rows(rows: DataFrame, blocks: Column, name: str) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "embedding"), blocks).cast("int"))


def mine(embeddings: DataFrame, anchor: Column, label: Column | None = None, mining: Mining = Mining()) -> DataFrame:
    """Hard negatives of the rows of ``embeddings`` (vec_id, embedding, label) where ``anchor`` holds.

    ``label`` replaces the column's value. Returns anchor_id, positive_id,
    positive_rank, rank, negative_id, positive_score, negative_score.
    """
    spark = prepare(embeddings.sparkSession)
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("label") if label is None else label).alias("label"),
        "embedding",
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        F.size(vector).alias("dim"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & (F.col("dim") > 0))
    # a bounded table: dimensions that have anchors
    dims = [(r["dim"], r["n"], r["a"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).where("a > 0").collect()]
    parts = [_mined(rows.where(F.col("dim") == dim).drop("dim"), n, a, mining) for dim, n, a in dims]
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long")
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made


def _mined(rows: DataFrame, n_rows: int, n_anchors: int, mining: Mining) -> DataFrame:
    """:func:`mine` for the rows of one dimension."""
    sample = rows.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).orderBy("h").limit(mining.sample_rows).drop("h").toArrow()
    book = Codebook(_matrix(sample.column("embedding")), mining.components_per_code)
    stored = StructType([*rows.schema.fields, StructField("codes", BinaryType()), StructField("residual", DoubleType())])
    encoded = settled(rows.mapInArrow(_encoder(book), stored))
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "embedding"))
    anchors = encoded.where("is_anchor").select("vec_id", "label", "embedding").withColumn("n", first).where("n = 1").drop("n")
    rows = encoded.drop("is_anchor")

    # positives: the anchor's label has as many blocks as its rows need
    sizes = settled(encoded.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).where("a > 0"))
    blocks = sizes.select(
        "label", F.ceil(F.col("n") / mining.block_rows).cast("int").alias("row_blocks"), F.ceil(F.col("a") / mining.block_anchors).cast("int").alias("anchor_blocks")
    )
    shape = blocks.agg(F.count("*").alias("labels"), F.sum(F.col("row_blocks").cast("long") * F.col("anchor_blocks")).alias("groups")).first()
    groups, blocks = shape["groups"], small_side(blocks, shape["labels"])
    everywhere = F.array(F.lit(float("-inf")))
    own_anchors = _dealt_rows(anchors.join(blocks, "label"), F.col("anchor_blocks"), "anchor_block").withColumn("lows", everywhere).withColumn("highs", F.array(F.lit(float("inf"))))
    own_rows = _dealt_rows(rows.join(blocks, "label"), F.col("row_blocks"), "row_block")
    near = _grid(own_anchors, own_rows, ["label"], book, mining.positives, True, groups)
    positives = settled(_best(near, ["anchor_id"], mining.positives).select("anchor_id", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # negatives: every block of rows against every block of anchors, a window for each positive
    score = F.col("w.positive_score")
    windows = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("w"))
    bound = lambda percent: F.transform("w", lambda w: w.positive_score * percent / 100)
    row_blocks, anchor_blocks = -(-n_rows // mining.block_rows), -(-n_anchors // mining.block_anchors)
    asked = anchors.join(windows, F.col("anchor_id") == F.col("vec_id")).select("vec_id", "label", "embedding", bound(mining.low_percent).alias("lows"), bound(mining.high_percent).alias("highs"))
    asked = _dealt_rows(asked, F.lit(anchor_blocks), "anchor_block").withColumn("row_blocks", F.lit(row_blocks))
    dealt = _dealt_rows(rows, F.lit(row_blocks), "row_block").withColumn("anchor_blocks", F.lit(anchor_blocks))
    negatives = _best(_grid(asked, dealt, [], book, mining.negatives, False, row_blocks * anchor_blocks), ["anchor_id", "window"], mining.negatives)
    places = positives.withColumn("window", F.col("positive_rank") - 1)
    return negatives.join(places, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "positive_rank", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
