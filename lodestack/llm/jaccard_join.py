"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct shingles. Documents of equal words form a
class, told by a SHA-256 digest of them, and classes are joined:

1. Shingles are ordered from rare to frequent, by counts in hashed slots whose
   table has a bounded size. Any common order gives right results; a good one
   gives short lists.
2. If two sets are similar enough, their ``l``-prefixes (the first ``n - need +
   l`` shingles) share ``l`` shingles; ``need`` is larger for the smaller set of
   a pair, so its part of the lists, the index prefix, is shorter. Each class
   picks the ``l`` for which the estimated cost of reading lists and checking
   candidates is least, and a pair is a candidate only if the prefixes share the
   smaller of both ``l``.
3. Linking rounds: in each shingle's list one class, the pivot, is checked with
   the others, and what is linked counts as one component from then on. So a
   large group of near copies takes one check per class, not one per pair.
4. All pairs of different components that share enough prefix shingles are
   then counted and checked, so no link between components is lost.

Candidates are found by 64-bit hashes of shingles; every one is verified on the whole
sets of the words themselves before it counts, and sizes are counted on them too.

No table that grows with the corpus is broadcast by hint: one text of each class is
stored in buckets of its digest, where a check joins it without moving the others.

Defined cases: words are as in ``words.PLAIN``; a text of fewer words than a
shingle is one shingle, a null text or one without words has none and is linked
with nothing; rows with a null id get no component; repeated rows and equal
texts fall into one class; a text of any length is one set, held whole in memory; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.blobs import groups_of, pack, unpack_all
from lodestack.llm.common import blocks, dealt, free_name, mix64, prepare, release_tables, shuffle_partitions, text_slices, tidy, utf8_buffer
from lodestack.llm.graph import components
from lodestack.llm.words import shingles_of, words_of
from lodestack.storage import remove_folder, shared_folder

POSTINGS = ("<u4", "<i8", "u1", "<i4", "<i4")  # shingle within its bucket, class, 2 l + 1 if in the index prefix, size of the set, place
#: Lower-cases A-Z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Join:
    """``percent`` of the union that the intersection needs; bounds and weights of the search.

    ``check_weight``: cost of checking a candidate, in entries of lists read.
    ``rounds`` bounds the linking rounds, which also end once they stop to pay;
    what they leave is done pair by pair, in shares of ``share`` entries of a list.
    """

    shingle: int = 4
    percent: int = 85
    most_l: int = 4
    check_weight: float = 20.0
    most_slots: int = 1 << 26
    rounds: int = 6
    share: int = 512
    block_bytes: int = 1 << 20


def sets_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their rows."""
    hashes, rows = shingles_of(words_of(*utf8_buffer(column)), size)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def plain_words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text."""
    return (text or "").encode().translate(LOWER).split()


def shingle_set(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of ``size`` words, as they are; fewer words are one run."""
    return set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else {tuple(words)} if words else set()


def _describe(j: Join):
    """Size of each text's set, and a digest of its words that no two sequences of words share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for batch in batches:
            sizes, digests = [], []
            for text in batch.column("text"):
                words = plain_words(text.as_py())
                sizes.append(len(shingle_set(words, j.shingle)))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "tag", "n", "key"])

    return run


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text that has a word, with the digest of its words."""
    release_tables()
    for batch in batches:
        rows = [(hashlib.sha256(b" ".join(words)).digest(), text) for text in batch.column("text").to_pylist() if (words := plain_words(text))]
        keys, kept = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(kept, pa.string())], names=["key", "text"])


def _slot_counts(j: Join, bits: int, ranges: int):
    """Of each batch how many sets have a shingle in each slot, as blobs by ranges of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for batch in blocks(batches, "text", 16 * j.block_bytes):
            found = []
            for low, high in text_slices(batch, "text", j.block_bytes):
                hashes, _ = sets_of(batch.column("text").slice(low, high - low), j.shingle)
                found.append((hashes >> np.uint64(64 - bits)).astype(np.uint32))
            slots, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            cuts = np.searchsorted(slots, (np.arange(ranges + 1) << bits) // ranges)
            parts = np.flatnonzero(np.diff(cuts))
            blobs = [pack([np.diff(slots[a:b], prepend=np.uint32(0)).astype("<u4"), counts[a:b].astype("<u4")]) for a, b in zip(cuts[parts], cuts[parts + 1])]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return run


def _slot_levels(bits: int, ranges: int):
    """Quarter powers of two of each slot's count, one byte per slot of the range."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        low, high = (part << bits) // ranges, ((part + 1) << bits) // ranges
        counts = np.zeros(high - low, dtype=np.int64)
        for blob in table.column("blob").to_pylist():
            steps, n = unpack_all([blob], ("<u4", "<u4"))
            counts[np.cumsum(steps.astype(np.int64)) - low] += n
        levels = np.minimum(255, np.floor(4 * np.log2(1 + counts))).astype(np.uint8)
        return pa.table([pa.array([part], pa.int64()), pa.array([pa.compress(levels, codec="zstd", asbytes=True)], pa.binary())], names=["part", "blob"])

    return run


def slot_levels(docs: DataFrame, j: Join, bits: int, words: int) -> np.ndarray:
    """For each of ``2 ** bits`` hash slots a level of how many sets have a shingle there; ``words`` shingles in all."""
    ranges = max(16, min(1 << (bits - 10), words >> 21))
    counted = dealt(docs.select("text").mapInArrow(_slot_counts(j, bits, ranges), "part long, blob binary"), "part", ranges)
    rows = counted.groupBy("part").applyInArrow(_slot_levels(bits, ranges), "part long, blob binary").collect()
    levels = np.zeros(1 << bits, dtype=np.uint8)
    for r in rows:
        low, high = (r["part"] << bits) // ranges, ((r["part"] + 1) << bits) // ranges
        levels[low:high] = np.frombuffer(pa.decompress(bytes(r["blob"]), decompressed_size=high - low, codec="zstd"), dtype=np.uint8)
    return levels


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that a set of ``n`` needs with any linked set."""
    return -(-percent * n // 100)


def need_of_smaller(n: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that a set of ``n`` needs with any linked set of at least its size."""
    return -(-2 * percent * n // (100 + percent))


def prefixes(hashes: np.ndarray, rows: np.ndarray, levels: np.ndarray, usual: float, bits: int, j: Join) -> tuple[np.ndarray, ...]:
    """Prefix shingles of each set, their rows, whether they are in the index prefix, their place, and each set's ``l`` and size.

    ``usual`` is the median level.
    """
    level = levels[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
    key = (level.astype(np.uint64) << np.uint64(56)) | (mix64(hashes) >> np.uint64(8))
    order = np.lexsort((key, rows))
    hashes, level = hashes[order], level[order]
    edges = groups_of(rows)
    begin, n = edges[:-1], np.diff(edges)
    if not len(n) or not len(hashes):
        return hashes, rows, np.zeros(0, dtype=bool), *[np.zeros(0, dtype=np.int64)] * 3
    # a slot's count above the usual one is taken for the shingle's own
    counts = np.maximum(2.0 ** (level / 4.0) - 2.0 ** (usual / 4.0), 1.0)
    sums = np.concatenate([[0.0], np.cumsum(counts)])
    least = need(n, j.percent)
    cost = []
    for l in range(1, j.most_l + 1):  # noqa: E741
        # most partners are of about the same size, for which the index prefix is read
        lists = sums[begin + np.minimum(n - need_of_smaller(n, j.percent) + l, n)] - sums[begin]
        cost.append(np.where(l <= least, lists * (1 + j.check_weight / l), np.inf))
    best = np.argmin(np.array(cost), axis=0) + 1
    place = np.arange(len(hashes)) - np.repeat(begin, n)
    keep = place < np.repeat(n - least + best, n)
    index = place < np.repeat(n - need_of_smaller(n, j.percent) + best, n)
    return hashes[keep], rows[keep], index[keep], place[keep], best, n


def _postings(j: Join, bits: int, buckets: int, levels: Broadcast):
    """Prefix shingles of each class of a batch, as blobs for their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        table = levels.value
        usual = float(np.median(table))
        for batch in blocks(batches, "text", 16 * j.block_bytes):
            found = []
            for low, high in text_slices(batch, "text", j.block_bytes):
                part = batch.slice(low, high - low)
                hashes, rows = sets_of(part.column("text"), j.shingle)
                filled = np.unique(rows)
                hashes, rows, index, place, best, n = prefixes(hashes, rows, table, usual, bits, j)
                which = np.searchsorted(filled, rows)
                found.append((mix64(hashes + np.uint64(1)), part.column("node").to_numpy()[rows], (2 * best[which] + index).astype("u1"), n[which].astype("<i4"), place.astype("<i4")))
            key, *rest = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
            bucket = (key >> np.uint64(32)) % np.uint64(buckets)
            short = key.astype(np.uint32)
            order = np.lexsort((short, bucket))
            cuts = groups_of(bucket[order])
            made = [(int(bucket[o[0]]), pack([short[o], *(x[o] for x in rest)])) for o in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]
            columns = list(zip(*made)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["bucket", "blob"])

    return run


LISTED = "token long, node long, l int, n int, indexed int, place int, weight long"


def _shared_lists(table: pa.Table) -> pa.Table:
    """Entries of the shingles that several classes have in their prefixes; shingles of one list are one, with a weight.

    Shingles of a passage often have the same list, so a pair that shares the
    passage meets less often than once per shingle. Of their places the first
    stays.
    """
    short, nodes, l, n, place = unpack_all(table.column("blob").to_pylist(), POSTINGS)  # noqa: E741
    order = np.lexsort((nodes, short))
    size = np.diff(groups_of(short[order]))
    chosen, size = order[np.repeat(size > 1, size)], size[size > 1]
    own = mix64(nodes[chosen].view(np.uint64) * np.uint64(2) + (l[chosen] & 1))
    begin = np.cumsum(size) - size
    digest = np.repeat(mix64(np.add.reduceat(own, begin) + size.astype(np.uint64)), size) if len(begin) else np.zeros(0, np.uint64)
    order = np.lexsort((place[chosen], nodes[chosen], digest))
    chosen, digest = chosen[order], digest[order]
    cuts = groups_of(digest ^ mix64(nodes[chosen].view(np.uint64)))
    at, weight = chosen[cuts[:-1]], np.diff(cuts)
    columns = [digest[cuts[:-1]].view(np.int64), nodes[at], (l[at] >> 1).astype(np.int32), n[at].astype(np.int32), (l[at] & 1).astype(np.int32), place[at].astype(np.int32), weight.astype(np.int64)]
    return pa.table([pa.array(c) for c in columns], names=[f.split()[0] for f in LISTED.split(", ")])


def _verify(j: Join):
    """Pairs (pivot, node) whose sets are similar enough, shingles compared word by word."""

    def run(table: pa.Table) -> pa.Table:
        release_tables()
        pivot, salt, node = (table.column(c).to_numpy() for c in ("pivot", "salt", "node"))
        texts, good = table.column("text"), []
        # a portion's pivot comes first
        order = np.lexsort((pivot != node, salt, pivot))
        group, lead = None, set()
        for at in order.tolist():
            own = shingle_set(plain_words(texts[at].as_py()), j.shingle)
            if (pivot[at], salt[at]) != group:
                group, lead = (pivot[at], salt[at]), own if pivot[at] == node[at] else set()
                continue
            shared = len(lead & own)
            if shared and 100 * shared >= j.percent * (len(lead) + len(own) - shared):
                good.append(at)
        return pa.table([pa.array(pivot[good]), pa.array(node[good])], names=["u", "v"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, j: Join, group_bytes: int = 2 << 20) -> tuple[DataFrame, int]:
    """The rows of ``pairs`` (pivot, node, n: size of the node's set) that are links, and how many pairs there are.

    ``texts``: node, key, text of every class, in buckets of key, so that only
    the pairs move to their texts. A pivot's partners are dealt into portions of
    bounded size, each with the pivot's text.
    """
    spark = pairs.sparkSession
    totals = pairs.agg(F.sum("n").alias("n"), F.count("*").alias("pairs")).first()
    if not totals["pairs"]:
        return spark.createDataFrame([], "u long, v long"), 0
    groups = max(2 * shuffle_partitions(spark), -(-totals["n"] * 16 // group_bytes))
    portion = F.ceil(F.col("all_n") * 16 / (group_bytes // 4)).cast("long")
    per_pivot = pairs.groupBy("pivot").agg(F.sum("n").alias("all_n"))
    wanted = pairs.join(per_pivot, "pivot").select("pivot", "node", F.pmod(F.xxhash64("node"), portion).alias("salt"))
    leads = wanted.select("pivot", "salt").distinct().withColumn("node", F.col("pivot"))
    keyed = wanted.unionByName(leads).join(texts.select("node", "key"), "node")
    rows = texts.select("key", "text").join(keyed.hint("shuffle_hash"), "key").drop("key").withColumn("part", F.pmod(F.xxhash64("pivot", "salt"), F.lit(groups)))
    return dealt(rows, "part", groups).groupBy("part").applyInArrow(_verify(j), "u long, v long"), totals["pairs"]


def linked(texts: DataFrame, words: int, j: Join = Join()) -> DataFrame:
    """``node`` and ``root`` of every class that is linked with another.

    ``texts``: node (long), key, text, one row per class, in buckets of key;
    ``words``: about how many shingles all have.
    """
    spark = prepare(texts.sparkSession)
    bits = max(16, min(j.most_slots, max(1, words // 32)).bit_length())
    levels = spark.sparkContext.broadcast(slot_levels(texts, j, bits, words))  # most_slots bytes at most
    buckets = max(2 * shuffle_partitions(spark), -(-words * 3 // (8 << 20)))
    postings = dealt(texts.select("node", "text").mapInArrow(_postings(j, bits, buckets, levels), "bucket long, blob binary"), "bucket", buckets)
    lists = (
        postings.groupBy("bucket").applyInArrow(_shared_lists, LISTED)
        .groupBy("token", "node").agg(F.max("l").alias("l"), F.max("n").alias("n"), F.max("indexed").alias("indexed"), F.min("place").alias("place"), F.sum("weight").alias("weight"))
    )
    # an edit makes prefix shingles of its own, so the text that others are edited from shares most of them
    lists = lists.withColumn("central", F.sum("weight").over(Window.partitionBy("node")) / F.col("n")).checkpoint()
    entries = lists.count()
    roots, checked = None, None

    def labelled() -> DataFrame:
        """Entries with their component, of lists that more than one component is in."""
        if roots is None:
            return lists.withColumn("root", F.col("node"))
        known = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_lists = known.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("token")
        return known.join(open_lists, "token", "left_semi")

    def with_roots(new: DataFrame) -> DataFrame:
        """``new`` links, and one of each linked class to its root, which stands for all earlier ones."""
        return new if roots is None else new.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))

    fits = lambda a, b: 100 * F.least(a, b) >= j.percent * F.greatest(a, b)
    for round_number in range(j.rounds):
        tidy(spark)
        here = labelled().checkpoint()
        per_root = here.groupBy("token", "root").agg(F.count("*").alias("c"), F.sum("indexed").alias("i"))
        per_list = per_root.groupBy("token").agg((F.sum("c") * F.sum("i") - F.sum(F.col("c") * F.col("i"))).alias("pairs"))
        load = per_list.agg(F.sum("pairs").alias("pairs")).first()["pairs"] or 0
        if load <= 2 * entries + 10_000:
            break
        # first the most central class of each list leads, then another one in each round
        draw = F.struct(F.col("central") if round_number == 0 else F.lit(0.0), F.xxhash64("node", F.lit(round_number)))
        leads = here.groupBy("token").agg(F.max_by(F.struct("node", "n", "root"), draw).alias("lead"))
        pairs = here.join(leads, "token").where((F.col("node") != F.col("lead.node")) & (F.col("root") != F.col("lead.root")) & fits(F.col("n"), F.col("lead.n")))
        pairs = pairs.select(F.col("lead.node").alias("pivot"), "node", "n").distinct()
        pairs = (pairs if checked is None else pairs.join(checked, ["pivot", "node"], "left_anti")).checkpoint()
        new, n_pairs = verified(pairs, texts, j)
        if not n_pairs:
            break
        tried = pairs.select("pivot", "node")
        checked = tried if checked is None else checked.unionByName(tried)
        new = new.checkpoint()
        pays = 50 * new.count() > n_pairs
        roots = components(with_roots(new)).checkpoint()
        if not pays:
            break
    # what is left, pair by pair
    tidy(spark)
    here = labelled()
    # long lists are dealt into a grid of shares, so that no task meets all of one
    shares = here.groupBy("token").agg(F.ceil(F.count("*") / j.share).cast("int").alias("shares"))
    here = here.join(shares, "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    columns = ("node", "root", "l", "n", "place")
    smaller = here.where("indexed = 1").select("token", F.col("own").alias("a"), each.alias("b"), *columns, "weight")
    larger = here.select("token", each.alias("a"), F.col("own").alias("b"), *[F.col(c).alias(f"{c}2") for c in columns])
    in_order = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("node") < F.col("node2")))
    # the sizes tell what this pair needs to share, and so how long the prefixes have to be
    whole = 100 + j.percent
    spare = F.least("l", "l2") - 1 - F.floor((j.percent * (F.col("n") + F.col("n2")) + whole - 1) / whole)
    early = (F.col("place") <= F.col("n") + spare) & (F.col("place2") <= F.col("n2") + spare)
    pairs = smaller.join(larger, ["token", "a", "b"]).where(in_order & early & (F.col("root") != F.col("root2")) & fits(F.col("n"), F.col("n2")))
    pairs = pairs.groupBy(F.col("node").alias("pivot"), F.col("node2").alias("node")).agg(F.sum("weight").alias("shared"), F.min(F.least("l", "l2")).alias("enough"), F.max("n2").alias("n")).where("shared >= enough").select("pivot", "node", "n")
    if checked is not None:
        turned = checked.unionByName(checked.select(F.col("node").alias("pivot"), F.col("pivot").alias("node")))
        pairs = pairs.join(turned, ["pivot", "node"], "left_anti")
    new, _ = verified(pairs.checkpoint(), texts, j)
    new = new.checkpoint()
    tidy(spark)
    return components(with_roots(new))


def _keyed(docs: DataFrame, name: str = "tag") -> DataFrame:
    """``docs`` with a digest that tells rows of one id apart by their text."""
    return docs.withColumn(name, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))


def _classes(docs: DataFrame, j: Join) -> tuple[DataFrame, DataFrame]:
    """Every row's set (doc_id, tag, n, key), and the classes (key, doc_id and tag of the first row, root)."""
    spark = docs.sparkSession
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    described = docs.mapInArrow(_describe(j), "doc_id long, tag binary, n int, key binary").checkpoint()
    inside = described.where("doc_id is not null and n > 0")
    firsts = inside.groupBy("key").agg(F.min(F.struct("doc_id", "tag")).alias("rep"), F.first("n").alias("n"))
    keyed = docs.where("doc_id is not null").select("text").mapInArrow(_with_key, "key binary, text string").dropDuplicates(["key"])
    # numbers are unique whatever the keys
    stored = keyed.join(firsts, "key").select(F.monotonically_increasing_id().alias("node"), "key", "n", F.col("rep.doc_id").alias("doc_id"), F.col("rep.tag").alias("tag"), "text")
    name = f"classes_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    try:
        stored.write.bucketBy(shuffle_partitions(spark), "key").format("parquet").option("path", folder).saveAsTable(name)
        texts = spark.table(name)
        classes = texts.select("node", "key", "n", "doc_id", "tag").checkpoint()
        roots = linked(texts.select("node", "key", "text"), classes.agg(F.sum("n")).first()[0] or 0, j)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(spark, folder)
    grouped = classes.drop("n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return described, grouped


def similarity_components(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links.
    """
    prepare(docs.sparkSession)
    described, grouped = _classes(docs, j)
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(least, "root").select("key", "component_id")
    out = described.join(named, "key", "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """``docs`` with the row of smallest id of each group of linked rows.

    Rows without an id or without words are kept as they are.
    """
    prepare(docs.sparkSession)
    described, grouped = _classes(docs, j)
    tag, own_id = free_name(docs, "tag"), free_name(docs, "doc_id_")
    first = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("first")).select(F.col("first.doc_id").alias(own_id), F.col("first.tag").alias(tag)).checkpoint()
    keyed = _keyed(docs, tag).withColumn(own_id, F.col("doc_id").cast("long"))
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = keyed.join(first.hint("shuffle_hash"), [own_id, tag], "left_semi").where(words)
    if _repeats(described):
        kept = kept.dropDuplicates([own_id, tag])
    return kept.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull() | ~words))


def _repeats(described: DataFrame) -> bool:
    """Whether some row occurs more than once."""
    return bool(described.groupBy("doc_id", "tag").count().where("count > 1").take(1))
