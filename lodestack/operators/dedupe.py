"""Duplicate links between postings and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.functions import vocabulary as V
from lodestack.functions.text import company_key, cosine
from lodestack.storage import grown, settled

GRAM = 3
#: Distinct vectors of a company's cell in one share of the comparisons.
SHARE = 2_000
#: Pivots of the index of vectors, and the vectors they are picked from.
PIVOTS, PIVOT_SAMPLE = 64, 2_000


def fingerprint_links(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Links (posting_id, canonical_id, similarity 1) of rows of ``new`` to the latest stored row of the same fingerprint."""
    latest = stored.groupBy("fingerprint").agg(F.max("posting_id").alias("canonical_id"))
    return new.join(latest, "fingerprint").select("posting_id", "canonical_id", F.lit(1.0).alias("similarity"))


def batch_links(postings: DataFrame) -> DataFrame:
    """Links within one batch: each row of a fingerprint to the first one by id."""
    first = postings.groupBy("fingerprint").agg(F.min("posting_id").alias("canonical_id"), F.count("*").alias("n")).where("n > 1")
    return postings.join(first, "fingerprint").where("posting_id > canonical_id").select("posting_id", "canonical_id", F.lit(1.0).alias("similarity"))


def matching_companies(a: Column, b: Column) -> Column:
    """Keys match if one contains the other; an empty key matches nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def company_pairs(names: DataFrame, named: bool = True) -> DataFrame:
    """All (a_key, b_key) of matching keys of the column ``company_name``, both ways and with themselves.

    Unless ``named``, the column has keys already.

    Keys, not postings, are compared. If one key contains another, all its
    three-letter grams are in the longer one, so candidates come from an index by
    the shorter key's rarest gram; keys too short for a gram are looked up among
    all runs of their length.
    """
    keys = settled(names.select((company_key(F.col("company_name")) if named else F.col("company_name")).alias("key")).where("key <> ''").distinct())
    short = keys.where(F.length("key") < GRAM)
    grams = lambda k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(k) - (GRAM - 1)), lambda i: F.substr(k, i, F.lit(GRAM))))
    # a dozen grams to a key, which Catalyst takes for as many rows as there are keys
    long = grown(keys.where(F.length("key") >= GRAM).withColumn("gram", F.explode(grams(F.col("key")))))
    counts = long.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = long.join(counts, "gram").groupBy("key").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    held = rarest.withColumnRenamed("key", "b").join(long.withColumnRenamed("key", "a"), "gram").where(F.contains("a", "b")).select("a", "b")
    # a key of one or two letters is looked up among all runs of that length
    runs = lambda k, n: F.when(F.length(k) >= n, F.transform(F.sequence(F.lit(1), F.length(k) - (n - 1)), lambda i: F.substr(k, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    pieces = keys.select(F.col("key").alias("a"), F.explode(F.array_distinct(F.concat(runs(F.col("key"), 1), runs(F.col("key"), 2)))).alias("b"))
    held = held.unionByName(pieces.join(short.withColumnRenamed("key", "b"), "b", "left_semi").select("a", "b")).distinct()
    return held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().select(F.col("a").alias("a_key"), F.col("b").alias("b_key"))


def pick_pivots(vectors: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Vectors that lie apart: each next one is the farthest from those before."""
    chosen, near = [0], vectors @ vectors[0]
    while len(chosen) < min(most, len(vectors)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _placing(pivots: np.ndarray | None, with_angles: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds each vector's cell (nearest pivot) and tilt (angle to it), or its angles to all pivots.

    A vector that isn't of unit length, or of another dimension, is in cell -1, which
    everything is compared with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column("vec"), batch.num_rows
            dim = 0 if pivots is None else pivots.shape[1]
            fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False), dtype=bool) & (dim > 0)
            angles = np.zeros((n, 0 if pivots is None else len(pivots)))
            if fits.any():
                flat = column.filter(pa.array(fits)).flatten()
                made = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
                unit = np.abs((made * made).sum(axis=1) - 1) < 1e-6
                fits[np.flatnonzero(fits)[~unit]] = False
                angles[fits] = np.arccos(np.clip(made[unit] @ pivots.T, -1, 1))
            cell = np.where(fits, angles.argmin(axis=1) if angles.shape[1] else -1, -1).astype(np.int32)
            if with_angles:
                shown = [a.tolist() if ok else None for a, ok in zip(angles, fits)]
                yield batch.append_column("angles", pa.array(shown, pa.list_(pa.float64())))
            else:
                tilt = np.where(fits, angles.min(axis=1, initial=np.inf), 0.0)
                yield batch.append_column("cell", pa.array(cell)).append_column("tilt", pa.array(tilt))

    return run


def _with(rows: DataFrame, extra: str) -> StructType:
    return StructType([*rows.schema.fields, *StructType.fromDDL(extra).fields])


def similar_candidates(new: DataFrame, candidates: DataFrame, threshold: float = V.DUPLICATE_SIMILARITY, index: bool = True) -> DataFrame:
    """The pairs that :func:`semantic_links` multiplies: posting_id, vec, other, other_seq, canonical_id.

    Vectors of a company are in cells around pivots, which are the same for all
    companies. A pair above the threshold has an angle of at most ``reach``, so its
    two angles to a pivot differ by no more: a cell is passed over if the new vector's
    angle to the pivot is farther than that from those of all vectors in it, and in
    the cells that are left a vector is passed over by its own angle. Without
    ``index`` all vectors of matching companies are paired.
    """
    keyed = lambda rows: rows.where("vec is not null").withColumn("key", F.col("key") if "key" in rows.columns else company_key(F.col("company_name"))).where("key <> ''")
    left, right = keyed(new).select("posting_id", "seq", "vec", "key"), keyed(candidates)
    # equal vectors of one key are one candidate, so repeats of a posting don't multiply
    first = right.groupBy("key", "vec").agg(F.min(F.struct("seq", "posting_id")).alias("first"))
    held = first.select(F.col("key").alias("b_key"), "vec", F.col("first.seq").alias("other_seq"), F.col("first.posting_id").alias("canonical_id"))
    # the pivots decide what is spared, not what is found, so a bounded sample will do; settled first, as
    # collecting an ordered limit sends the driver that many rows from every task
    sample = [r["vec"] for r in settled(right.select("vec").orderBy(F.xxhash64("vec")).limit(PIVOT_SAMPLE)).collect()] if index else []
    usable = [v for v in sample if v and len(v) == len(sample[0]) and None not in v and abs(sum(x * x for x in v) - 1) < 1e-6]
    pivots = pick_pivots(np.array(usable)) if usable else None
    left = settled(left.mapInArrow(_placing(pivots, True), _with(left, "angles array<double>")))
    held = settled(held.mapInArrow(_placing(pivots, False), _with(held, "cell int, tilt double")))
    pairs = company_pairs(left.select(F.col("key").alias("company_name")).unionByName(held.select(F.col("b_key").alias("company_name"))), named=False)
    reach = float(np.arccos(min(1.0, threshold))) + 1e-6
    # a cell with many vectors is dealt into shares, so that no task compares all of them
    cells = grown(held.groupBy("b_key", "cell").agg(F.min("tilt").alias("low"), F.max("tilt").alias("high"), F.ceil(F.count("*") / SHARE).cast("int").alias("shares")))
    to = pairs.join(cells, "b_key").select("a_key", "b_key", "cell", "low", "high", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    angle = F.when(F.col("cell") >= 0, F.get("angles", F.col("cell")))
    asked = grown(left.withColumnRenamed("key", "a_key")).join(to, "a_key").withColumn("angle", angle)
    asked = asked.where(F.col("angle").isNull() | F.col("angle").between(F.col("low") - reach, F.col("high") + reach)).drop("angles", "low", "high")
    held = held.join(cells.select("b_key", "cell", "shares"), ["b_key", "cell"]).withColumn("share", F.pmod(F.xxhash64("vec"), F.col("shares")).cast("int")).withColumnRenamed("vec", "other").drop("shares")
    met = asked.join(grown(held), ["b_key", "cell", "share"]).where(F.col("other_seq") < F.col("seq"))
    met = met.where(F.col("angle").isNull() | (F.abs(F.col("angle") - F.col("tilt")) <= reach))
    return met.select("posting_id", "vec", "other", "other_seq", "canonical_id")


def semantic_links(new: DataFrame, candidates: DataFrame, threshold: float = V.DUPLICATE_SIMILARITY) -> DataFrame:
    """Best link of each row of ``new`` to a matching company's row of smaller ``seq``.

    Both have posting_id, company_name (or key, the name's key), vec, seq. Ties go to
    the smaller seq.
    """
    joined = similar_candidates(new, candidates, threshold).withColumn("similarity", cosine(F.col("vec"), F.col("other"))).where(F.col("similarity") >= threshold)
    best = joined.groupBy("posting_id").agg(F.max_by(F.struct("canonical_id", "similarity"), F.struct("similarity", -F.col("other_seq"))).alias("best"))
    return best.select("posting_id", "best.canonical_id", "best.similarity")


def repost_increments(links: DataFrame, postings: DataFrame) -> DataFrame:
    """canonical_id, seen_at_ms and n: how many postings of a family a batch has brought.

    ``postings`` (posting_id, first_seen_at_ms) are the batch that ``links`` are of. A
    posting is linked once, in its own batch, so the counts of batches add up and
    a new batch only appends its own.
    """
    seen = grown(links).join(postings.select("posting_id", F.col("first_seen_at_ms").alias("seen_at_ms")), "posting_id")
    return seen.groupBy("canonical_id", "seen_at_ms").agg(F.countDistinct("posting_id").alias("n"))


def repost_counts(postings: DataFrame, links: DataFrame, now_ms: int, window_ms: int = V.REPOST_WINDOW_MS, increments: DataFrame | None = None) -> DataFrame:
    """posting_id and reposts: rows linked to the posting's canonical row and first seen within the window.

    ``increments`` are those of all batches so far; without them the links are counted.
    """
    one = links.groupBy("posting_id").agg(F.max("canonical_id").alias("canonical_id"))
    increments = repost_increments(links, postings) if increments is None else increments
    family = increments.where(F.col("seen_at_ms") >= now_ms - window_ms).groupBy("canonical_id").agg(F.sum("n").alias("reposts"))
    own = postings.select("posting_id").join(grown(one), "posting_id", "left").withColumn("canonical_id", F.coalesce("canonical_id", "posting_id"))
    return own.join(grown(family), "canonical_id", "left").select("posting_id", F.coalesce("reposts", F.lit(0)).alias("reposts"))


def links_of(links: DataFrame, postings: DataFrame) -> DataFrame:
    """canonical_id, posting_id, similarity, source, title and first_seen_at_ms of every posting that repeats another."""
    return links.join(postings.select("posting_id", "source", "title", "first_seen_at_ms"), "posting_id").select("canonical_id", "posting_id", "similarity", "source", "title", "first_seen_at_ms")
