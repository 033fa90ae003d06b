"""Packing of tokenised documents into windows by bounded-space online placement.

Every partition packs its own documents as they come, with at most ``open_windows``
windows open:

1. a document's whole windows of ``capacity`` tokens are emitted at once; what is
   left of it goes, uncut, into the open window where least room remains (best fit);
2. if it fits nowhere and fewer windows are open, it opens one;
3. if it fits nowhere and all are open, the fullest is emitted: the document is cut
   so that its beginning fills that window, and its rest is placed anew. A gap of at
   most ``spare`` tokens, and a window whose length is a power of two and thus needs
   no padding, is emitted as it is instead.

At the partition's end its open windows are merged, the emptiest into the fullest,
which leaves one part-filled window. Such leftovers travel with their ids, one a
partition, and are merged again in groups of ``merge_partitions`` partitions. What a
group then has left is cut into lengths that are powers of two, which need no
padding either. So with ``spare=0`` nothing is padded, and apart from documents
longer than a window only one document a window is cut.

A task holds its open windows' ids, at most ``open_windows * capacity`` of them, and
one slice of texts; a merging task holds at most ``merge_partitions * capacity``.
The first stage is kept in the shared folder, as a window's pieces belong together
and must not be made twice.

Defined cases: a null text is an empty one (just the end id); an empty table gives no
rows; repeated rows are packed once each; null doc_ids are carried along; a text of
any length is cut into windows; among windows of equal room the one opened first is
taken; other input columns are ignored. Which documents meet in a window depends on
how rows are dealt to partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import prepare, text_slices, worker_table
from lodestack.llm.packing import WordIds
from lodestack.storage import settled

PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PLACED_SCHEMA = PIECES_SCHEMA + ", ids binary, leftover int"
#: Sequence ids of merged windows begin here; a partition's own are its number times 2^32 and on.
MERGED = 1 << 62


@dataclass(frozen=True)
class Shape:
    """Tokens a window, windows open at a time, the gap emitted as padding, and the partitions whose leftovers meet."""

    capacity: int = 4096
    open_windows: int = 64
    spare: int = 0
    merge_partitions: int = 16


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, tokens: int) -> tuple[Piece, Piece]:
        """Its first ``tokens`` and the rest."""
        return self._replace(ids=self.ids[: 4 * tokens]), self._replace(start=self.start + tokens, ids=self.ids[4 * tokens :])


@dataclass
class OpenWindow:
    pieces: list[Piece] = field(default_factory=list)
    length: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.length += piece.length


def padding(length: int, capacity: int) -> int:
    """Tokens of padding behind ``length`` ones."""
    return 0 if length & (length - 1) == 0 else capacity - length


class Packer:
    """Bounded-space best-fit packing of one stream of documents."""

    def __init__(self, shape: Shape) -> None:
        self.shape = shape
        #: Open windows by their room, oldest first, and which rooms there are as a bit mask.
        self.by_room: dict[int, list[OpenWindow]] = {}
        self.rooms, self.open = 0, 0

    def _hold(self, window: OpenWindow) -> None:
        room = self.shape.capacity - window.length
        self.by_room.setdefault(room, []).append(window)
        self.rooms |= 1 << room
        self.open += 1

    def _release(self, room: int) -> OpenWindow:
        held = self.by_room[room]
        window = held.pop(0)
        if not held:
            del self.by_room[room]
            self.rooms &= ~(1 << room)
        self.open -= 1
        return window

    def put(self, document: Piece) -> Iterator[OpenWindow]:
        """Place a document; gives the windows that this emits."""
        capacity = self.shape.capacity
        rest = document
        while rest.length >= capacity:
            whole, rest = rest.cut(capacity)
            yield OpenWindow([whole], capacity)
        while rest.length:
            fitting = self.rooms >> rest.length
            if fitting:
                window = self._release((fitting & -fitting).bit_length() - 1 + rest.length)
            elif self.open < self.shape.open_windows:
                window = OpenWindow()
            else:
                room = (self.rooms & -self.rooms).bit_length() - 1
                window = self._release(room)
                if room > self.shape.spare and padding(window.length, capacity):
                    filling, rest = rest.cut(room)
                    window.add(filling)
                yield window
                continue
            window.add(rest)
            if window.length == capacity:
                yield window
            else:
                self._hold(window)
            return

    def windows(self) -> list[OpenWindow]:
        """What is still open, fullest first."""
        return [w for room in sorted(self.by_room) for w in self.by_room[room]]


def merge(windows: Iterable[OpenWindow], shape: Shape) -> tuple[list[OpenWindow], OpenWindow | None]:
    """Part-filled windows put together: the full ones this makes and at most one that is left.

    The fullest window is filled from the emptiest ones, piece by piece; the piece
    that doesn't fit is cut.
    """
    held = sorted(windows, key=lambda w: -w.length)
    full: list[OpenWindow] = []
    first, last = 0, len(held) - 1
    while first < last:
        target, source = held[first], held[last]
        room = shape.capacity - target.length
        if room <= shape.spare:
            full.append(target)
            first += 1
            continue
        piece = source.pieces.pop()
        source.length -= piece.length
        if piece.length > room:
            piece, rest = piece.cut(room)
            source.add(rest)
        target.add(piece)
        if not source.pieces:
            last -= 1
    if first == last and shape.capacity - held[first].length <= shape.spare:
        full.append(held[first])
        first += 1
    return full, held[first] if first == last else None


def in_powers(window: OpenWindow) -> Iterator[OpenWindow]:
    """The window's pieces in windows whose lengths are powers of two, largest first."""
    pieces = list(reversed(window.pieces))
    left = window.length
    while left:
        size = 1 << (left.bit_length() - 1)
        made = OpenWindow()
        while made.length < size:
            piece = pieces.pop()
            if piece.length > size - made.length:
                piece, rest = piece.cut(size - made.length)
                pieces.append(rest)
            made.add(piece)
        yield made
        left -= size


def _rows(window: OpenWindow, sequence: int, with_ids: bool, leftover: int | None = None) -> Iterator[tuple]:
    at = 0
    for p in window.pieces:
        yield p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, sequence, at, p.ids if with_ids or leftover is not None else None, leftover
        at += p.length


def _batch(rows: list[tuple], with_leftover: bool = True) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.int32()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "leftover"]
    columns = list(zip(*rows)) or [()] * 9
    width = 8 + with_leftover
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)][:width], names=names[:width])


def _packer(path: str, end_id: int, shape: Shape, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = worker_table(WordIds, path), Packer(shape)
        partition = TaskContext.get().partitionId()
        end, sequence = np.array([end_id], dtype="<u4").tobytes(), partition << 32
        for batch in batches:
            for low, high in text_slices(batch, "text", 8 << 20):
                part = batch.slice(low, high - low)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = words.ids(text or "") + end
                    for window in packer.put(Piece(doc_id, 0, ids, len(ids) // 4)):
                        rows += _rows(window, sequence, with_ids)
                        sequence += 1
                yield _batch(rows)
        full, left = merge(packer.windows(), shape)
        rows = []
        for window in full:
            rows += _rows(window, sequence, with_ids)
            sequence += 1
        if left:
            rows += _rows(left, sequence, with_ids, leftover=partition)
        yield _batch(rows)

    return run


def _merger(shape: Shape, with_ids: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        windows: dict[int, OpenWindow] = {}
        for r in sorted(table.to_pylist(), key=lambda r: (r["leftover"], r["offset"])):
            windows.setdefault(r["leftover"], OpenWindow()).add(Piece(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        sequence = MERGED + (min(windows) // shape.merge_partitions << 32)
        full, left = merge(windows.values(), shape)
        rows: list[tuple] = []
        for window in [*full, *(in_powers(left) if left else ())]:
            rows += _rows(window, sequence, with_ids)
            sequence += 1
        return pa.Table.from_batches([_batch(rows, with_leftover=False)])

    return run


def pack_windows(docs: DataFrame, tokenizer_path: str, end_id: int, shape: Shape = Shape(), with_ids: bool = False) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and pack them: one row per piece.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    if asked for, ids (little-endian unsigned 32-bit).
    """
    prepare(docs.sparkSession)
    names = PIECES_SCHEMA.replace(" long", "").split(", ") + ["ids"] * with_ids
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = settled(read.mapInArrow(_packer(tokenizer_path, end_id, shape, with_ids), PLACED_SCHEMA))
    left = placed.where("leftover is not null")
    merged = left.groupBy(F.floor(F.col("leftover") / shape.merge_partitions)).applyInArrow(_merger(shape, with_ids), PIECES_SCHEMA + ", ids binary")
    return placed.where("leftover is null").select(names).unionByName(merged.select(names))


def sequences(pieces: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """The windows themselves, from pieces with ids: sequence_id, ids (binary), length, padding and the pieces' documents in order."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    joined = pieces.groupBy("sequence_id").agg(inside.alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x.ids))
    length = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x.length)
    padded = F.when(F.bit_count("length") == 1, 0).otherwise(shape.capacity - F.col("length"))
    return joined.select("sequence_id", ids.alias("ids"), length.alias("length"), F.col("p.doc_id").alias("doc_ids")).withColumn("padding", padded)
