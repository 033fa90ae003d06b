"""Removal of long strings that repeat across documents, by distributed suffix sorting.

A byte is removed if a string of ``length`` bytes covers it that also starts in
a document with a smaller id. Sorting all suffixes of a corpus in one place is
out of question, so suffixes that can be equal over ``length`` bytes are brought
together first:

* Every window of ``length`` bytes has an *anchor*, its ``k``-mer of smallest
  hash. Equal windows have equal anchors at equal places, and neighbouring
  windows mostly share theirs; a maximal run of windows with one anchor is a
  *span*, about 20 windows in 70 bytes.
* Spans go to buckets by their anchor's hash, as compressed blobs. Within a
  block of documents equal spans are merged before the shuffle: only the
  smallest document's leaves the task, the others are repeats already. So a
  passage that a third of all documents share reaches its bucket once per block.
* A bucket drops spans whose anchor's surroundings occur in one document only.
  It orders the rest by deep-shallow sorting (see ``deep_shallow``), first as
  whole spans, then, for spans that differ but share an anchor, suffix by
  suffix, without those whose bytes next to the anchor occur in one document
  only; a class of equal suffixes keeps its smallest document.
* Repeated ranges go back to the documents by hash groups of bounded size.

Defined cases: null text is empty; ids count as signed numbers, a null id as the
largest one; rows of one id never repeat each other, so repeated rows get the
same ranges, found in other ids; equal strings of several ids tie for the smallest
of them, which keeps its own; texts shorter than ``length`` stay whole, longer
ones are worked on in slices that overlap by a window; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.blobs import flags_to_runs, gather, groups_of, loads, pack, runs_to_flags, unpack_all
from lodestack.llm.common import BROADCAST_ROWS, blocks, dealt, free_name, mix64, prepare, release_tables, shuffle_partitions, utf8_buffer
from lodestack.llm.deep_shallow import sort_groups

LAST_ID = (1 << 63) - 1
SPANS = ("<i8", "<i8", "<u2", "<u2", "<u4", "<u4", "u1")  # id steps, tag, length, anchor's place, number of places, places, texts
RANGES = ("<i8", "<i8", "<u4", "<u4")  # id, tag, start, end
DOCS = ("<i8", "<i8", "u1", "<i8", "u1")  # id, tag, id is null, length, texts
KEPT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


@dataclass(frozen=True)
class Plan:
    """Lengths, and over how many buckets and groups the work is dealt."""

    length: int
    k: int
    buckets: int
    groups: int
    shallow: int
    block_bytes: int = 16 << 20


def _hash_places(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` (8 to 16) bytes at each place."""
    low, high = loads(raw, 8)[: len(raw) - k + 1], loads(raw, 8)[k - 8 :]
    return mix64(low * np.uint64(0x9E3779B97F4A7C15) ^ mix64(high + np.uint64(k)))


def find_spans(raw: np.ndarray, offsets: np.ndarray, p: Plan, chunk: int = (1 << 20) - 64) -> tuple[np.ndarray, ...]:
    """First and last window and anchor of each span, all as places in ``raw``, and its text's row."""
    width = p.length - p.k + 1
    long = np.flatnonzero(np.diff(offsets) >= p.length)
    begin, end = offsets[:-1][long], offsets[1:][long] - p.length + 1  # first window of a text, and past its last one
    firsts, lasts, anchors = [], [], []
    last_window = len(raw) - p.length + 1
    place_bits = np.uint64((1 << 20) - 1)
    for at in range(0, max(0, last_window), chunk):
        stop = min(at + chunk, last_window)
        part = raw[at : stop + p.length - 1]
        least = (_hash_places(part, p.k) & ~place_bits) | np.arange(len(part) - p.k + 1, dtype=np.uint64)
        covered = 1
        while covered < width:
            step = min(covered, width - covered)
            least = np.minimum(least[:-step], least[step:])
            covered += step
        anchor = (least & place_bits).astype(np.int64) + at
        change = np.ones(stop - at, dtype=bool)
        change[1:] = anchor[1:] != anchor[:-1]
        for edge in (begin, end):
            change[edge[(edge >= at) & (edge < stop)] - at] = True
        cuts = np.flatnonzero(change) + at
        owner = np.searchsorted(begin, cuts, side="right") - 1
        good = owner >= 0
        good[good] = cuts[good] < end[owner[good]]
        firsts.append(cuts[good])
        lasts.append(np.append(cuts[1:], stop)[good] - 1)
        anchors.append(anchor[cuts[good] - at])
    if not firsts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    first = np.concatenate(firsts)
    return first, np.concatenate(lasts), np.concatenate(anchors), long[np.searchsorted(begin, first, side="right") - 1]


def span_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each ``raw[s:s + n]``, for n of at least 8; ``raw`` has 8 bytes to spare."""
    words = loads(raw, 8)
    out = mix64(lengths.astype(np.uint64))
    for at in range(0, int(lengths.max(initial=0)), 8):
        live = np.flatnonzero(lengths > at)
        # the last word of a text may overlap the one before
        place = np.minimum(at, lengths[live] - 8) + starts[live]
        out[live] = mix64(out[live] * np.uint64(0xD1B54A32D192ED03) + words[place])
    return out


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    words = loads(raw, 8)
    same = np.ones(len(a), dtype=bool)
    for at in range(0, int(lengths.max(initial=0)), 8):
        shift = np.minimum(at, lengths - 8)
        same &= words[a + shift] == words[b + shift]
    return same


def merge_equal(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each span the first one of the same bytes by (id, place); spans of equal hash but other bytes stay apart."""
    key = span_hashes(raw, starts, lengths)
    order = np.lexsort((starts, ids, key))
    cuts = groups_of(key[order])
    head = np.repeat(order[cuts[:-1]], np.diff(cuts))
    equal = (lengths[head] == lengths[order]) & (ids[head] <= ids[order])
    others = equal & (head != order)
    equal[others] = same_bytes(raw, starts[head[others]], starts[order[others]], lengths[order[others]])
    out = np.empty(len(starts), dtype=np.int64)
    out[order] = np.where(equal, head, order)
    return out


def _groups(ids: np.ndarray, tags: np.ndarray, n: int) -> np.ndarray:
    return (mix64(ids.astype(np.uint64) ^ (tags.astype(np.uint64) << np.uint64(40))) % np.uint64(n)).astype(np.int64)


def _dealt(key: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``arrays`` cut by ``key``."""
    order = np.argsort(key, kind="stable")
    cuts = groups_of(key[order])
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        chosen = order[low:high]
        yield int(key[chosen[0]]), [a[chosen] for a in arrays]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "kind", "blob"])


def _columns(part: pa.RecordBatch, doc_id: str = "doc_id", tag: str = "tag") -> tuple[np.ndarray, np.ndarray]:
    ids = part.column(doc_id).fill_null(LAST_ID).to_numpy().astype(np.int64)
    return ids, part.column(tag).to_numpy().astype(np.int64)


def _emit(p: Plan):
    """Of each block of documents: spans for the buckets (kind 0) and ranges found repeated within it (kind 1)."""

    def block(part: pa.RecordBatch) -> list[tuple[int, int, bytes]]:
        raw, offsets = utf8_buffer(part.column("text"))
        ids, tags = _columns(part)
        first, last, anchor, row = find_spans(raw, offsets, p)
        if not len(first):
            return []
        lengths = last - first + p.length
        padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
        head = merge_equal(padded, first, lengths, ids[row])
        place = first - offsets[:-1][row]
        rows = []
        later = ids[row] > ids[row[head]]
        for bucket, arrays in _dealt(_groups(ids[row[later]], tags[row[later]], p.buckets), [ids[row[later]], tags[row[later]], place[later], lengths[later]]):
            at, tag, start, n = arrays
            rows.append((bucket, 1, pack([at, tag, start.astype("<u4"), (start + n).astype("<u4")])))
        # places of a span's text in its smallest document stay with it; those of other rows of that id are texts of their own
        own = np.flatnonzero(~later)
        lead = np.where((row[own] == row[head[own]]), head[own], own)
        order = np.lexsort((place[own], lead))
        own, lead = own[order], lead[order]
        cuts = groups_of(lead)
        heads, counts = lead[cuts[:-1]], np.diff(cuts)
        bucket = (mix64(_hash_at(padded, anchor[heads], p.k)) % np.uint64(p.buckets)).astype(np.int64)
        order = np.lexsort((heads, bucket))
        edges = groups_of(bucket[order])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            chosen = order[low:high]
            h = heads[chosen]
            places = place[gather(own, cuts[:-1][chosen], counts[chosen])]
            rows.append((int(bucket[chosen[0]]), 0, pack([
                np.diff(ids[row[h]], prepend=0), tags[row[h]], lengths[h].astype("<u2"), (anchor[h] - first[h]).astype("<u2"),
                counts[chosen].astype("<u4"), places.astype("<u4"), gather(raw, first[h], lengths[h]),
            ], level=3)))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for part in blocks(batches, "text", p.block_bytes):
            yield _batch(block(part))

    return run


def _hash_at(raw: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    words = loads(raw, 8)
    return mix64(words[places] * np.uint64(0x9E3779B97F4A7C15) ^ mix64(words[places + k - 8] + np.uint64(k)))


def _shared_context(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray, ids: np.ndarray, p: Plan) -> np.ndarray:
    """Spans whose anchor and some bytes before or after it occur in another id as well.

    A window holds at least ``half`` bytes on one side of its anchor.
    """
    half = (p.length - p.k) // 2
    keep = np.zeros(len(starts), dtype=bool)
    for able, begin in ((at >= half, starts + at - half), (lengths - at - p.k >= half, starts + at)):
        able = np.flatnonzero(able)
        key = span_hashes(raw, begin[able], np.full(len(able), half + p.k, dtype=np.int64))
        order = np.argsort(key, kind="stable")
        cuts = groups_of(key[order])
        if not len(able):
            continue
        own = ids[able][order]
        several = np.minimum.reduceat(own, cuts[:-1]) != np.maximum.reduceat(own, cuts[:-1])
        keep[able[order[np.repeat(several, np.diff(cuts))]]] = True
    return keep


def _shared_reach(raw: np.ndarray, anchors: np.ndarray, room: np.ndarray, ids: np.ndarray, p: Plan, left: bool) -> np.ndarray:
    """How many words of eight bytes next to each anchor occur there in another id as well; ``room`` is how many bytes a span has there."""
    reach = np.zeros(len(anchors), dtype=np.int64)
    live = np.arange(len(anchors))
    for n in range(8, p.length - p.k + 1, 8):
        live = live[room[live] >= n]
        if not len(live):
            break
        key = span_hashes(raw, anchors[live] - (n if left else 0), np.full(len(live), n + p.k, dtype=np.int64))
        order = np.argsort(key, kind="stable")
        cuts = groups_of(key[order])
        own = ids[live][order]
        several = np.minimum.reduceat(own, cuts[:-1]) != np.maximum.reduceat(own, cuts[:-1])
        live = np.sort(live[order[np.repeat(several, np.diff(cuts))]])
        reach[live] += 1
    return reach


def bucket_ranges(spans: list[np.ndarray], p: Plan) -> tuple[np.ndarray, ...]:
    """Repeated ranges (id, tag, start, end) among the spans of one bucket; ids are absolute here."""
    ids, tags, lengths, at, counts, places, raw = spans
    lengths, at, counts, places = (x.astype(np.int64) for x in (lengths, at, counts, places))
    starts = np.cumsum(lengths) - lengths
    place_at = np.cumsum(counts) - counts
    raw = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    found: list[tuple[np.ndarray, ...]] = []

    def tell(which: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Range [low, high) of each span ``which`` is repeated, at all its places."""
        n = counts[which]
        base = places[gather(np.arange(len(places)), place_at[which], n)]
        each = lambda x: np.repeat(x, n)
        found.append((each(ids[which]), each(tags[which]), base + each(low), base + each(high)))

    kept = np.flatnonzero(_shared_context(raw, starts, lengths, at, ids, p))
    anchor = _hash_at(raw, starts + at, p.k)
    # whole spans: one anchor, place of it and length make a group
    key = mix64(anchor[kept] + mix64((at[kept] << 16 | lengths[kept]).astype(np.uint64)))
    _, group = np.unique(key, return_inverse=True)
    _, classes = sort_groups(raw, starts[kept], lengths[kept], group, p.shallow)
    order = np.lexsort((ids[kept], classes))
    cuts = groups_of(classes[order])
    least = np.repeat(order[cuts[:-1]], np.diff(cuts))
    later = ids[kept[order]] > ids[kept[least]]
    which = kept[order[later]]
    tell(which, np.zeros(len(which), dtype=np.int64), lengths[which])
    # suffix by suffix: spans that share an anchor with another class of spans
    rest = kept[order[~later]]
    if len(rest):
        _, group, size = np.unique(anchor[rest], return_inverse=True, return_counts=True)
        rest, group = rest[size[group] > 1], group[size[group] > 1]
        windows = lengths[rest] - p.length + 1
        span = np.repeat(np.arange(len(rest)), windows)
        shift = np.arange(len(span)) - np.repeat(np.cumsum(windows) - windows, windows)
        # a window that occurs in another id has there what is left and right of its anchor
        before = at[rest][span] - shift
        sides = (_shared_reach(raw, (starts + at)[rest], room[rest], ids[rest], p, left) for room, left in ((at, True), (lengths - at - p.k, False)))
        fits = np.logical_and(*(n // 8 <= reach[span] for n, reach in zip((before, p.length - p.k - before), sides)))
        span, shift, before = span[fits], shift[fits], before[fits]
        begin = starts[rest][span] + shift
        suffix_group = group[span] * p.length + before
        order = np.argsort(suffix_group, kind="stable")
        cuts = groups_of(suffix_group[order])
        several = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
        span, shift, begin, suffix_group = (x[order[several]] for x in (span, shift, begin, suffix_group))
        _, classes = sort_groups(raw, begin, np.full(len(begin), p.length, dtype=np.int64), suffix_group, p.shallow)
        own = ids[rest][span]
        order = np.lexsort((own, classes))
        cuts = groups_of(classes[order])
        least = np.repeat(own[order[cuts[:-1]]], np.diff(cuts))
        late = order[own[order] > least]
        late = late[np.lexsort((shift[late], span[late]))]
        # windows of one span that follow each other make one range
        if len(late):
            new = np.ones(len(late), dtype=bool)
            new[1:] = (span[late][1:] != span[late][:-1]) | (shift[late][1:] != shift[late][:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(late)) - 1
            tell(rest[span[late][head]], shift[late][head], shift[late][tail] + p.length)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, dtype=d) for d in RANGES)


def _bucket(p: Plan):
    def run(table: pa.Table) -> pa.Table:
        release_tables()
        kinds = table.column("kind").to_numpy()
        blobs = table.column("blob").to_pylist()
        parts = [unpack_all([b], SPANS) for b, k in zip(blobs, kinds) if k == 0]
        local = unpack_all([b for b, k in zip(blobs, kinds) if k == 1], RANGES)
        ranges = [np.zeros(0, dtype=d) for d in RANGES]
        if len(parts) > 0:
            spans = [np.concatenate([np.cumsum(x[0]) if i == 0 else x[i] for x in parts]) for i in range(len(SPANS))]
            ranges = list(bucket_ranges(spans, p))
        ids, tags, low, high = (np.concatenate([a, b]) for a, b in zip(ranges, local))
        rows = [(g, pack([a[0], a[1], a[2].astype("<u4"), a[3].astype("<u4")])) for g, a in _dealt(_groups(ids, tags, p.groups), [ids, tags.astype("<i8"), low, high])]
        columns = list(zip(*rows)) or [(), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["pack", "blob"])

    return run


def _bodies(p: Plan):
    """Documents as compressed blobs for their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for part in blocks(batches, "text", p.block_bytes):
            raw, offsets = utf8_buffer(part.column("text"))
            ids, tags = _columns(part)
            null = part.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype("u1")
            n = np.diff(offsets)
            rows = []
            for group, (i, t, z, m, s) in _dealt(_groups(ids, tags, p.groups), [ids, tags, null, n, offsets[:-1]]):
                rows.append((group, pack([i, t, z, m, gather(raw, s, m)], level=3)))
            columns = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["pack", "blob"])

    return run


def named_documents(ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray, ranges: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Bring ``ranges`` (id, tag, start, end) to the documents of a group.

    Rows of one id and tag are the same text: the first stands for all. Returns
    the documents' offsets, for each the one that stands for it, and of each
    range its document and its start and end as places in the joined texts.
    """
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    every_id, every_tag = np.concatenate([ids, ranges[0]]), np.concatenate([tags, ranges[1]])
    order = np.lexsort((every_tag, every_id))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (every_id[order][1:] != every_id[order][:-1]) | (every_tag[order][1:] != every_tag[order][:-1])
    name = np.empty(len(order), dtype=np.int64)
    name[order] = np.cumsum(new) - 1
    first = np.full(int(name.max(initial=-1)) + 1, -1, dtype=np.int64)
    first[name[: len(ids)][::-1]] = np.arange(len(ids))[::-1]
    owner = first[name[len(ids) :]]
    known = owner >= 0
    owner = owner[known]
    low, high = (offsets[owner] + np.minimum(x[known].astype(np.int64), lengths[owner]) for x in ranges[2:4])
    return offsets, first[name[: len(ids)]], owner, low, high


def cut_documents(docs: list[np.ndarray], ranges: list[np.ndarray]) -> Iterator[tuple[int | None, int, int, int, bytes]]:
    """Id, length, removed bytes, removed runs and kept bytes of each document of a group."""
    ids, tags, null, lengths, raw = docs
    offsets, first, _, low, high = named_documents(ids, tags, lengths, ranges)
    gone = runs_to_flags(len(raw), low, high)
    begin = flags_to_runs(gone, offsets[1:-1])[0] if len(raw) else np.zeros(0, dtype=np.int64)
    runs = np.bincount(np.searchsorted(offsets, begin, side="right") - 1, minlength=len(ids))
    for i, j in enumerate(first.tolist()):
        text, flags = raw[offsets[j] : offsets[j + 1]], gone[offsets[j] : offsets[j + 1]]
        yield None if null[i] else int(ids[i]), len(text), int(flags.sum()), int(runs[j]), text[~flags].tobytes()


def _finish(digest: bool):
    def run(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        release_tables()
        rows = cut_documents(unpack_all(docs.column("blob").to_pylist(), DOCS), unpack_all(ranges.column("blob").to_pylist(), RANGES)) if docs.num_rows else ()
        made = [(i, n, m, k, hashlib.sha256(t).hexdigest() if digest else t) for i, n, m, k, t in rows]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept")
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*made)) or [()] * 5, kinds)], names=list(names))

    return run


def plan(docs: DataFrame, length: int = 50, shallow: int = 32, bucket_bytes: int = 12 << 20, group_bytes: int = 4 << 20) -> Plan:
    """Deal the work so that a bucket and a group hold about the given numbers of bytes, whatever the corpus."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    least = 2 * shuffle_partitions(docs.sparkSession)
    k = min(12, length - 1)
    return Plan(length, k, max(least, -(-4 * total // bucket_bytes)), max(least, -(-total // group_bytes)), shallow)


def tagged(docs: DataFrame, name: str = "tag") -> DataFrame:
    """``docs`` with what tells rows of one doc_id apart: a 64-bit hash of the text where the id is null or has several rows, else 0.

    Tags travel with every span, and random ones don't compress.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    repeated = free_name(docs, "many")
    many = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(repeated)).where(F.col(repeated) > 1).select(F.col("doc_id").alias(repeated))
    n = many.count()
    if n > BROADCAST_ROWS:
        return docs.withColumn(name, text)
    if not n:
        return docs.withColumn(name, F.when(F.col("doc_id").isNull(), text).otherwise(F.lit(0).cast("long")))
    joined = docs.join(F.broadcast(many), F.col("doc_id") == F.col(repeated), "left")
    return joined.withColumn(name, F.when(F.col("doc_id").isNull() | F.col(repeated).isNotNull(), text).otherwise(F.lit(0).cast("long"))).drop(repeated)


def remove_repeats(docs: DataFrame, length: int = 50, digest: bool = False, shallow: int = 32) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans and what is kept.

    ``kept`` is binary, as a cut may fall inside a character; with ``digest`` it
    is its SHA-256 in hexadecimal instead, as kept_sha256. ``length`` is 16 to 200.
    """
    if not 16 <= length <= 200:
        raise ValueError("length must be 16 to 200")
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    p = plan(docs, length, shallow)
    rows = tagged(docs)
    spans = dealt(rows.mapInArrow(_emit(p), "bucket long, kind int, blob binary"), "bucket", p.buckets)
    ranges = dealt(spans.groupBy("bucket").applyInArrow(_bucket(p), "pack long, blob binary"), "pack", p.groups)
    bodies = dealt(rows.mapInArrow(_bodies(p), "pack long, blob binary"), "pack", p.groups)
    schema = KEPT_SCHEMA.replace("kept binary", "kept_sha256 string") if digest else KEPT_SCHEMA
    return bodies.groupBy("pack").cogroup(ranges.groupBy("pack")).applyInArrow(_finish(digest), schema)
