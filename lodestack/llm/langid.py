"""Language identification by the nearest of several centroids per language.

A text is the vector of its UTF-8 byte n-grams (ASCII letters lower-cased, runs
of other ASCII characters as one space), hashed to ``dims`` features, weighted ``(1 + log tf) * idf`` and scaled to unit
length. Each language has up to ``clusters`` centroids from spherical k-means
over a bounded sample of its labelled documents; idf counts all labelled
documents. A text gets the language of the centroid with the largest cosine. It
is *rejected* if that cosine is below its language's floor for texts of about its
length: a fraction of the cosine that all but a hundredth of the sample's texts of
that length reach, and no more than the floor of longer texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and rejected; they and rows with a null lang teach nothing; if nothing is labelled,
every text is ``und``; of centroids with the same cosine the language that sorts
first wins; n-grams of a text of any length are counted in slices; an empty table
gives no rows; repeated rows give repeated results; other columns, whatever their
names, are carried by :func:`annotate` and never reach the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import free_name, prepare, release_tables, text_slices, utf8_buffer

UNKNOWN = "und"
#: Classes of length (n-grams of a text) with a floor each: below 64, 256, 1024, and more.
LENGTH_CLASSES = (64, 256, 1024)
#: Share of a class's sample texts that may lie below what its floor is taken from.
LOW = 0.01


#: What each byte counts as.
_LETTERS = np.array([b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() and b < 128 else 32 for b in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class Features:
    """Hashed byte n-grams of ``orders``, in ``2 ** bits`` dimensions."""

    bits: int = 12
    orders: tuple[int, ...] = (2, 3, 4)

    @property
    def dims(self) -> int:
        return 1 << self.bits

    @staticmethod
    def _letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts with ASCII letters lower-cased and each run of other ASCII bytes as one space."""
        kept = _LETTERS[raw]
        ahead = np.concatenate([[0], kept[:-1]])
        # a text's first space doesn't depend on the text before it
        ahead[offsets[:-1][offsets[:-1] < len(raw)]] = 0
        keep = (kept != 32) | (ahead != 32)
        before = np.concatenate([[0], np.cumsum(keep)])
        return kept[keep], before[offsets]

    def counts(self, column: pa.Array) -> np.ndarray:
        """n-gram counts, one row per text."""
        lower, offsets = self._letters(*utf8_buffer(column))
        rows = len(offsets) - 1
        out = np.zeros(rows * self.dims, dtype=np.float32)
        step = 1 << 21
        of = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
        for at in range(0, len(lower), step):
            last = min(at + step, len(lower))
            part = lower[at : min(last + max(self.orders) - 1, len(lower))].astype(np.uint32)
            gram = part.copy()
            for order in range(2, max(self.orders) + 1):
                gram = (gram[:-1] << np.uint32(8)) | part[order - 1 :]
                if order not in self.orders:
                    continue
                n = min(len(gram), last - at)
                row = of[at : at + n]
                inside = row == of[at + order - 1 : at + order - 1 + n]
                slot = ((gram[:n] * np.uint32(2654435761) + np.uint32(order * 40503)) * np.uint32(2246822519)) >> np.uint32(32 - self.bits)
                cells = (row * self.dims + slot)[inside]
                low = int(row[0]) * self.dims if n else 0
                if len(cells):
                    made = np.bincount(cells - low)
                    out[low : low + len(made)] += made
        return out.reshape(rows, self.dims)

    @staticmethod
    def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        vectors = np.log1p(counts, out=counts) * idf
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        return vectors / np.where(norm > 0, norm, 1)[:, None]


def length_class(totals: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(LENGTH_CLASSES), totals, side="right")


def length_floors(cosines: np.ndarray, classes: np.ndarray, floor: float) -> list[float]:
    """``floor`` times a low cosine of each class of length, from the longest to the shortest.

    A short text's cosine is less sure, so no floor is above a longer class's; a
    class without texts takes the next longer one's, else the next shorter one's.
    """
    floors, least = [np.inf] * (len(LENGTH_CLASSES) + 1), np.inf
    for k in reversed(range(len(floors))):
        own = cosines[classes == k]
        least = min(least, float(np.quantile(own, LOW, method="lower"))) if len(own) else least
        floors[k] = floor * max(0.0, least)
    longest = next(x for x in reversed(floors) if np.isfinite(x))
    return [x if np.isfinite(x) else longest for x in floors]


def spherical_kmeans(vectors: np.ndarray, clusters: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids; the first is the mean, each next seed the vector farthest from the seeds so far."""
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
    seeds = unit(vectors.mean(axis=0, keepdims=True))
    while len(seeds) < min(clusters, len(vectors)):
        farthest = int(np.argmin((vectors @ seeds.T).max(axis=1)))
        seeds = np.vstack([seeds, vectors[farthest]])
    for _ in range(rounds):
        nearest = (vectors @ seeds.T).argmax(axis=1)
        made = [vectors[nearest == k].mean(axis=0) for k in range(len(seeds)) if (nearest == k).any()]
        seeds = unit(np.array(made))
    return seeds


@dataclass(frozen=True)
class CentroidModel:
    """Centroids (row by row), their languages, floors by length class, idf."""

    features: Features
    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    floors: np.ndarray

    def predict(self, column: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text; ``letters``: which texts have a letter."""
        counts = self.features.counts(column)
        classes = length_class(counts.sum(axis=1))
        if not self.langs:
            return [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), dtype=bool)
        cosines = Features.weighted(counts, self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1)
        rejected = score < self.floors[best, classes]
        known = letters.astype(bool)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0), rejected | ~known


def _sums(features: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        total, docs = np.zeros(features.dims, dtype=np.int64), 0
        for batch in batches:
            for low, high in text_slices(batch, "text", 1 << 20):
                for at in range(low, high, 512):
                    counts = features.counts(batch.column("text").slice(at, min(512, high - at)))
                    total += (counts > 0).sum(axis=0)
                    docs += len(counts)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(features.dims + 1), pa.int32()), pa.array([*total.tolist(), docs], pa.int64())], names=["slot", "df"])

    return run


def fit(labelled: DataFrame, sample_per_lang: int = 800, clusters: int = 4, floor: float = 0.7, features: Features = Features(), model_bytes: int = 1 << 30) -> CentroidModel:
    """Fit on ``labelled`` (doc_id, text, lang).

    Document frequencies cover all labelled texts. Centroids come from about
    ``sample_per_lang`` texts of each language, chosen by a hash of id and text,
    repeated rows once, so the sample's size is bounded whatever the size of the table. Every
    language has its centroids; a table with so many that they would take more
    than ``model_bytes`` (16,384 languages by default) raises ValueError.
    """
    spark = prepare(labelled.sparkSession)
    labelled = labelled.select(F.col("doc_id"), "text", "lang").where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    most = model_bytes // (4 * clusters * features.dims)
    per_lang = labelled.groupBy("lang").agg(F.count("*").alias("n")).checkpoint()
    n_langs = per_lang.count()
    if n_langs > most:
        raise ValueError(f"{n_langs} languages need more than model_bytes; {most} fit")
    df = labelled.select("text").mapInArrow(_sums(features), "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect()
    seen = {r["slot"]: r["df"] for r in df}
    docs = seen.get(features.dims, 0)
    idf = np.array([np.log((1 + docs) / (1 + seen.get(i, 0))) + 0.1 for i in range(features.dims)], dtype=np.float32)
    nothing = CentroidModel(features, idf, np.zeros((0, features.dims), np.float32), (), np.zeros((0, len(LENGTH_CLASSES) + 1)))
    if not n_langs:
        return nothing
    share = F.lit(float(sample_per_lang)) / F.col("n")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) / float(1 << 24)
    schema = "lang string, centroid binary, floors array<double>"

    def cluster(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        column = pa.chunked_array(table.column("text").chunks).combine_chunks()
        counts = np.vstack([features.counts(column.slice(at, 128)) for at in range(0, len(column), 128)])
        counts = counts[counts.sum(axis=1) > 0]
        if not len(counts):
            return pa.table([pa.array([], k) for k in (pa.string(), pa.binary(), pa.list_(pa.float64()))], names=["lang", "centroid", "floors"])
        classes = length_class(counts.sum(axis=1))
        vectors = Features.weighted(counts, idf)
        centroids = spherical_kmeans(vectors, clusters)
        cosines = (vectors @ centroids.T).max(axis=1)
        floors = length_floors(cosines, classes, floor)
        data = [[lang] * len(centroids), [c.astype("<f4").tobytes() for c in centroids], [floors] * len(centroids)]
        return pa.table([pa.array(d, k) for d, k in zip(data, (pa.string(), pa.binary(), pa.list_(pa.float64())))], names=["lang", "centroid", "floors"])

    drawn = labelled.withColumn("draw", draw).join(F.broadcast(per_lang), "lang").where(F.col("draw") < share)  # at most ``most`` rows
    rows = drawn.dropDuplicates(["lang", "doc_id", "text"]).select("lang", "text").groupBy("lang").applyInArrow(cluster, schema).collect()
    if not rows:
        return nothing
    rows = sorted(rows, key=lambda r: (r["lang"], bytes(r["centroid"])))
    centroids = np.array([np.frombuffer(r["centroid"], dtype="<f4") for r in rows])
    return CentroidModel(features, idf, centroids, tuple(r["lang"] for r in rows), np.array([r["floors"] for r in rows]))


def annotate(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """All columns of ``docs``, and lang_pred, score, rejected of its text.

    A column of ``docs`` with one of these names gives way to the prediction.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # at most model_bytes
    made = ("lang_pred", "score", "rejected")
    carried, marked = [c for c in docs.columns if c not in made], free_name(docs, "letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        fitted = shared.value
        for batch in batches:
            for low, high in text_slices(batch, "text", 1 << 20):
                for at in range(low, high, 512):
                    part = batch.slice(at, min(512, high - at))
                    langs, score, rejected = fitted.predict(part.column("text"), part.column(marked).to_numpy(zero_copy_only=False))
                    columns = [*(part.column(c) for c in carried), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*carried, *made])

    letters: Column = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = docs.select(*carried).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*carried, letters.alias(marked)).mapInArrow(run, schema)


def predict(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs`` (doc_id, text)."""
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")
