"""Substring deduplication by content-defined chunking with a gear rolling hash.

A chunk ends after each byte at which the gear hash of the last 16 bytes has its
top ``bits`` bits zero, unless another such byte lies less than ``least`` bytes
before it. Borders so depend on nearby bytes only: an insertion changes the
chunks it touches and no others. Chunks are compared by a 128-bit BLAKE2b digest. A chunk
is a repeat if its digest also occurs in a document with a smaller id; a maximal
run of repeats is removed if it is long enough and its chunks say enough, short
ones that recur by chance saying nothing.

Digests go to buckets as compressed blobs, those of one block of documents merged
before the shuffle; what is found goes back to the documents by hash groups.

Defined cases: null text is empty, and stays null when rewritten; a null id
counts as the largest one; rows of one id never repeat each other, so equal rows
are cut alike; a chunk that several ids tie for stays with the smallest; texts of
any length are cut in slices of ``block_bytes`` or a text each; an empty table
gives no rows; other columns are ignored by :func:`remove_repeated_chunks` and
carried by :func:`deduplicated`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestack.llm.blobs import flags_to_runs, gather, pack, runs_to_flags, unpack_all
from lodestack.llm.common import blocks, dealt, free_name, mix64, prepare, release_tables, shuffle_partitions, text_slices, utf8_buffer
from lodestack.llm.suffix_dedup import DOCS, RANGES, _batch, _bodies, _columns, _dealt, _groups, named_documents, tagged

WINDOW = 16
WORD = re.compile(r"[^\x20\x09-\x0D]")
#: A 16-bit gear for each byte value.
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
CHUNKS = ("<u8", "<u8", "<i8", "<i8", "<u4", "<u4", "<u4")  # digest in two halves, id, tag, length, number of places, places
KEPT_SCHEMA = "doc_id long, tag long, n_bytes long, n_removed long, n_spans long, n_chunks long, n_repeated_chunks long, text string"


@dataclass(frozen=True)
class Chunking:
    """Shape of chunks, and what a run of repeats needs: bytes, and bytes beyond ``silent`` of each chunk."""

    bits: int = 4
    least: int = 8
    most: int = 1024
    run_bytes: int = 80
    silent: int = 12
    evidence: int = 48


@dataclass(frozen=True)
class _Names:
    """Columns of our own beside the caller's."""

    doc_id: str
    tag: str
    pack: str


@dataclass(frozen=True)
class Plan:
    chunking: Chunking
    buckets: int
    groups: int
    block_bytes: int = 12 << 20


def gear_hashes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: over the last 16 bytes of its text, in 16 bits."""
    rows = len(offsets) - 1
    gap = WINDOW - 1
    place = np.arange(len(raw)) + np.repeat(gap * np.arange(1, rows + 1), np.diff(offsets))
    sums = np.zeros(len(raw) + gap * (rows + 1), dtype=np.uint16)
    sums[place] = GEAR[raw]
    step = 1
    while step < WINDOW:
        sums[step:] += sums[:-step] << np.uint16(step)
        step *= 2
    return sums[place]


def chunks_of(raw: np.ndarray, offsets: np.ndarray, c: Chunking) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all texts, as places in ``raw``."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cut = np.flatnonzero(gear_hashes(raw, offsets) >> np.uint16(16 - c.bits) == 0) + 1
    row = np.searchsorted(offsets, cut - 1, side="right")
    keep = np.ones(len(cut), dtype=bool)
    keep[1:] = (np.diff(cut) >= c.least) | (row[1:] != row[:-1])
    cut = cut[keep]
    # a text's own borders always count, and keep no others away
    edges = np.unique(np.concatenate([cut, offsets[1:], offsets[:1]]))
    starts, ends = edges[:-1], edges[1:]
    parts = -(-(ends - starts) // c.most)
    if parts.max(initial=1) > 1:
        shift = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        limit = np.repeat(ends, parts)
        starts = np.repeat(starts, parts) + shift * c.most
        ends = np.minimum(starts + c.most, limit)
    return starts, ends


def digests_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 128-bit BLAKE2b digest of each ``raw[s:e]``, in two halves: what a text is made of cannot make two equal."""
    held, digest = memoryview(np.ascontiguousarray(raw)), hashlib.blake2b
    found = b"".join([digest(held[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(found, dtype="<u8").reshape(-1, 2)


def _cuts(digest: np.ndarray) -> np.ndarray:
    """Edges of the runs of equal digests."""
    if not len(digest):
        return np.zeros(1, dtype=np.int64)
    new = (digest[1:] != digest[:-1]).any(axis=1)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(digest)]])


def _emit(p: Plan):
    """Of each block: chunks for the buckets (kind 0), one document's of each digest, and repeats within the block (kind 1)."""

    def chunked(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Row, place in its text, length and digest of each chunk; in slices, as hashing needs memory for every byte."""
        found = []
        for low, high in text_slices(part, "text", 2 << 20):
            raw, offsets = utf8_buffer(part.column("text").slice(low, high - low))
            starts, ends = chunks_of(raw, offsets, p.chunking)
            row = np.searchsorted(offsets, starts, side="right") - 1
            found.append((row + low, starts - offsets[:-1][row], ends - starts, digests_of(raw, starts, ends)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def block(part: pa.RecordBatch) -> list[tuple[int, int, bytes]]:
        ids, tags = _columns(part)
        row, place, length, digest = chunked(part)
        if not len(row):
            return []
        order = np.lexsort((row, ids[row], digest[:, 1], digest[:, 0]))
        cuts = _cuts(digest[order])
        least = ids[row[order[cuts[:-1]]]]
        later = np.empty(len(row), dtype=bool)
        later[order] = ids[row[order]] > np.repeat(least, np.diff(cuts))
        rows = []
        r = row[later]
        for bucket, (i, t, s, e) in _dealt(_groups(ids[r], tags[r], p.buckets), [ids[r], tags[r], place[later], length[later]]):
            rows.append((bucket, 1, pack([i, t, s.astype("<u4"), (s + e).astype("<u4")])))
        # a digest's places in one row stand together
        own = order[~later[order]]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (digest[own][1:] != digest[own][:-1]).any(axis=1) | (row[own][1:] != row[own][:-1])
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(own)))
        lead = own[heads]
        key = (digest[lead, 0] % np.uint64(p.buckets)).astype(np.int64)
        for bucket, (at, first, n) in _dealt(key, [lead, heads, counts]):
            places = place[own[gather(np.arange(len(own)), first, n)]]
            r = row[at]
            rows.append((bucket, 0, pack([digest[at, 0], digest[at, 1], ids[r], tags[r], length[at].astype("<u4"), n.astype("<u4"), places.astype("<u4")])))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for part in blocks(batches, "text", p.block_bytes):
            yield _batch(block(part))

    return run


def _bucket(p: Plan):
    def run(table: pa.Table) -> pa.Table:
        release_tables()
        kinds, blobs = table.column("kind").to_numpy(), table.column("blob").to_pylist()
        *halves, ids, tags, lengths, counts, places = unpack_all([b for b, k in zip(blobs, kinds) if k == 0], CHUNKS)
        local = unpack_all([b for b, k in zip(blobs, kinds) if k == 1], RANGES)
        digest = np.stack(halves, axis=1)
        order = np.lexsort((ids, digest[:, 1], digest[:, 0]))
        cuts = _cuts(digest[order])
        later = order[ids[order] > np.repeat(ids[order[cuts[:-1]]], np.diff(cuts))] if len(order) else order
        n = counts[later].astype(np.int64)
        at = places[gather(np.arange(len(places)), (np.cumsum(counts, dtype=np.int64) - counts)[later], n)]
        each = lambda x: np.repeat(x[later], n)
        ranges = (each(ids), each(tags), at, at + each(lengths))
        i, t, low, high = (np.concatenate([a, b]) for a, b in zip(ranges, local))
        rows = [(g, pack([a[0], a[1], a[2].astype("<u4"), a[3].astype("<u4")])) for g, a in _dealt(_groups(i, t, p.groups), [i, t.astype("<i8"), low, high])]
        columns = list(zip(*rows)) or [(), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["pack", "blob"])

    return run


def removed_runs(size: int, offsets: np.ndarray, low: np.ndarray, high: np.ndarray, c: Chunking) -> tuple[np.ndarray, np.ndarray]:
    """Flags of removed bytes, and the removed runs' starts, from repeated chunks ``[low, high)``."""
    flags = runs_to_flags(size, low, high)
    if not size:
        return flags, np.zeros(0, dtype=np.int64)
    begin, end = flags_to_runs(flags, offsets[1:-1])
    said = np.bincount(np.searchsorted(begin, low, side="right") - 1, weights=np.maximum(high - low - c.silent, 0), minlength=len(begin))
    good = (end - begin >= c.run_bytes) & (said >= c.evidence)
    return runs_to_flags(size, begin[good], end[good]), begin[good]


@dataclass(frozen=True)
class _Cut:
    """What became of the texts of one group: removed bytes, and counts of each row."""

    raw: np.ndarray
    offsets: np.ndarray
    first: np.ndarray  # the row that stands for each row
    gone: np.ndarray
    runs: np.ndarray
    repeats: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray, raw: np.ndarray, blobs: list[bytes], c: Chunking) -> _Cut:
        offsets, first, owner, low, high = named_documents(ids, tags, lengths, unpack_all(blobs, RANGES))
        # repeated rows tell their ranges more than once; chunks of a text begin at different places
        low, at = np.unique(low, return_index=True)
        high = high[at]
        gone, begin = removed_runs(len(raw), offsets, low, high, c)
        count = lambda places: np.bincount(np.searchsorted(offsets, places, side="right") - 1, minlength=len(ids))
        return cls(raw, offsets, first, gone, count(begin), count(low))

    def text(self, row: int) -> tuple[bytes, int]:
        """The bytes left of a row's text, and how many were removed."""
        part = slice(self.offsets[self.first[row]], self.offsets[self.first[row] + 1])
        flags = self.gone[part]
        removed = int(flags.sum())
        return (self.raw[part][~flags] if removed else self.raw[part]).tobytes(), removed


def _finish(p: Plan):
    """One row per document of a group: its text without repeats, and counts."""

    def run(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        release_tables()
        rows: list[tuple] = []
        if docs.num_rows:
            ids, tags, null, lengths, raw = unpack_all(docs.column("blob").to_pylist(), DOCS)
            cut = _Cut.of(ids, tags, lengths, raw, ranges.column("blob").to_pylist(), p.chunking)
            starts, _ = chunks_of(raw, cut.offsets, p.chunking)
            chunks = np.bincount(np.searchsorted(cut.offsets, starts, side="right") - 1, minlength=len(ids))
            for i, j in enumerate(cut.first.tolist()):
                kept, removed = cut.text(i)
                rows.append((None if null[i] else int(ids[i]), int(tags[i]), int(lengths[i]), removed, int(cut.runs[j]), int(chunks[i]), int(cut.repeats[j]), kept.decode("utf-8", "replace")))
        columns = list(zip(*rows)) or [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in KEPT_SCHEMA.split(", ")])

    return run


def _packed(p: Plan, names: _Names):
    """Rows as they are, with the group that each belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for part in batches:
            ids, tags = _columns(part, names.doc_id, names.tag)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_groups(ids, tags, p.groups))], names=[*part.schema.names, names.pack])

    return run


def _rewritten(p: Plan, names: _Names, columns: list[str]):
    """The rows of a group with their new texts; those left without a word are dropped."""

    def run(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        release_tables()
        rest = docs.select(columns)
        if not docs.num_rows:
            return rest
        column = docs.column("text").combine_chunks()
        raw, offsets = utf8_buffer(column)
        ids, tags = _columns(docs.combine_chunks().to_batches()[0], names.doc_id, names.tag)
        cut = _Cut.of(ids, tags, np.diff(offsets), raw, ranges.column("blob").to_pylist(), p.chunking)
        texts, keep = [], []
        for i, known in enumerate(column.is_valid().to_pylist()):
            text, removed = cut.text(i)
            text = text.decode("utf-8", "replace")
            keep.append(not removed or WORD.search(text) is not None)
            texts.append(text if known else None)
        at = rest.schema.get_field_index("text")
        return rest.set_column(at, rest.schema.field(at), pa.array(texts, rest.schema.field(at).type)).filter(pa.array(keep))

    return run


def plan(docs: DataFrame, chunking: Chunking, bucket_bytes: int = 4 << 20, group_bytes: int = 2 << 20) -> Plan:
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    least = 2 * shuffle_partitions(docs.sparkSession)
    return Plan(chunking, max(least, -(-total // bucket_bytes)), max(least, -(-total // group_bytes)))


def remove_repeated_chunks(docs: DataFrame, chunking: Chunking = Chunking()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the text without repeated runs, and counts.

    Columns doc_id, tag (see :func:`tagged`), n_bytes, n_removed, n_spans (runs
    removed), n_chunks, n_repeated_chunks, text. Cuts that fall inside a
    character leave U+FFFD.
    """
    prepare(docs.sparkSession)
    return _chunks_removed(tagged(docs.select("doc_id", "text")), chunking)


def _ranges(rows: DataFrame, p: Plan) -> DataFrame:
    """Repeated chunks of ``rows`` (doc_id, text, tag), as blobs for the documents' groups."""
    found = dealt(rows.mapInArrow(_emit(p), "bucket long, kind int, blob binary"), "bucket", p.buckets)
    return dealt(found.groupBy("bucket").applyInArrow(_bucket(p), "pack long, blob binary"), "pack", p.groups)


def _chunks_removed(tagged_docs: DataFrame, chunking: Chunking) -> DataFrame:
    rows = tagged_docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "tag")
    p = plan(rows, chunking)
    bodies = dealt(rows.mapInArrow(_bodies(p), "pack long, blob binary"), "pack", p.groups)
    return bodies.groupBy("pack").cogroup(_ranges(rows, p).groupBy("pack")).applyInArrow(_finish(p), KEPT_SCHEMA)


def deduplicated(docs: DataFrame, chunking: Chunking = Chunking()) -> DataFrame:
    """``docs`` without repeated runs in ``text``; rows that they left without a word are dropped.

    All other columns, whatever their names, go with their rows to the texts' groups.
    """
    prepare(docs.sparkSession)
    names = _Names(*(free_name(docs, n) for n in ("doc_id_", "tag", "pack")))
    keyed = tagged(docs, names.tag).withColumn(names.doc_id, F.col("doc_id").cast("long"))
    rows = keyed.select(F.col(names.doc_id).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(names.tag).alias("tag"))
    p = plan(rows, chunking)
    whole = keyed.mapInArrow(_packed(p, names), StructType([*keyed.schema.fields, StructField(names.pack, LongType())]))
    return dealt(whole, names.pack, p.groups).groupBy(names.pack).cogroup(_ranges(rows, p).groupBy("pack")).applyInArrow(_rewritten(p, names, docs.columns), docs.schema)
