"""Best-fit packing of tokenised documents by bin completion.

Every document becomes token ids, is cut into pieces of at most ``capacity``
tokens and its pieces are placed into sequences. Pieces are dealt by hash into
groups of a bounded number of documents, so that no task depends on the size of
the corpus; within a group the packer

1. builds a best-fit-decreasing solution as the first incumbent,
2. stops if it meets the volume bound ``ceil(tokens / capacity)``,
3. otherwise runs bin completion: the largest open piece starts a sequence, all
   undominated fillings of its rest are enumerated by waste, and a branch ends
   once its waste exceeds what one sequence less than the incumbent allows.
   ``node_limit`` ends the search with the best solution so far.

At most one sequence per group can stay part empty because of the grouping.

Defined cases: a null text is an empty one (just the end id); an empty table
gives no rows; repeated rows are packed once each; null doc_ids are carried
along; a text of any length is cut into pieces of ``capacity``; among fillings of
equal waste those with the largest pieces come first; other input columns are
ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import prepare, segments, text_slices, worker_table

#: Words, and bytes of long ones, in a generation of a worker's word table; two generations are kept.
TABLE_ENTRIES, TABLE_BYTES = 400_000, 32 << 20
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
IDS_SCHEMA = PIECES_SCHEMA + ", ids binary"
PACKED_SCHEMA = PIECES_SCHEMA + ", sequence_id long, offset long, optimal boolean"
#: Fillings that a group's search looks at.
NODE_LIMIT = 6_000
#: Texts by which a vocabulary is told to be one that :class:`WordIds` can take apart.
PROBES = ("", "a", "Hello, World. don't", " two  spaces\nand a line ", "Été über ÀÉ", "1,234.5 a.. b.,", "<|endoftext|> x", "日本 é́ ﬁ", "under_score e-mail@x.org", "İstanbul ΣΑΣ")


#: The letter by which a byte-level vocabulary writes a byte: itself where it can be seen, else the next one from 256 on.
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: chr(b) if b in _SEEN else chr(256 + sum(x not in _SEEN for x in range(b))) for b in range(256)}


def _is_plain(word: str) -> bool:
    """Whether a word is of lower-case Latin letters only, which are as they are in every normal form."""
    return word.isalpha() and max(word) < "\u0250" and word == word.lower()


class WordIds:
    """Ids of white-space separated words, each distinct word encoded once.

    No token of the vocabulary spans a space or a line feed, so a text's ids are
    its words' ids one after another.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.letters = 0
        self.marks = {m: array("I", self.tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in ("", ".", ",")}
        for text in PROBES:
            if self.ids(text) != array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes():
                raise ValueError(f"{path}: words of this vocabulary can't be encoded one by one, see {text!r}")

    @staticmethod
    def _core(word: str) -> tuple[str, str]:
        """What of a word is to be encoded, and the mark after it.

        The case of plain words doesn't count, and a full stop or comma after
        one is a token of its own.
        """
        mark = word[-1:] if word[-1:] in (".", ",") else ""
        if mark and _is_plain(low := word[:-1].lower()):
            return low, mark
        low = word.lower()
        return (low if _is_plain(low) else word), ""

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of ``text``."""
        if len(text) > 1 << 20:
            return b"".join(map(self._ids, segments(text)))
        return self._ids(text)

    def _ids(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        table = self.table
        try:
            return b"".join(map(table.__getitem__, words))
        except KeyError:
            pass
        new = set(words).difference(table)
        self.letters += sum(map(len, new))
        if len(table) + len(new) > TABLE_ENTRIES or self.letters > TABLE_BYTES:
            # words in use move on to the new generation, the others are forgotten with the one before
            self.older, self.table = table, {"": b""}
            table, new = self.table, set(words)
            self.letters = sum(map(len, new))
        cores, older = {}, self.older
        for word in new:
            known = older.get(word)
            if known is None:
                cores[word] = self._core(word)
            else:
                table[word] = known
        unknown = []
        for core in {c for c, _ in cores.values()}:
            if core in older:
                table[core] = older[core]
            elif core not in table:
                unknown.append(core)
        other = []
        for core in unknown:
            if _is_plain(core):
                # such a word passes the normaliser unchanged and is one piece for the model
                piece = core if core.isascii() else core.encode().decode("latin-1").translate(_BYTE_LETTERS)
                table[core] = array("I", [token.id for token in self.model.tokenize(piece)]).tobytes()
            else:
                other.append(core)
        for core, coded in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            table[core] = array("I", coded.ids).tobytes()
        for word, (core, mark) in cores.items():
            table[word] = table[core] + self.marks[mark]
        return b"".join(map(table.__getitem__, words))


def _cutter(path: str, capacity: int, end_id: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_table(WordIds, path)
        end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            for low, high in text_slices(batch, "text", 8 << 20):
                part = batch.slice(low, high - low)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = words.ids(text or "") + end
                    for piece, at in enumerate(range(0, len(ids), width)):
                        own = ids[at : at + width]
                        rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)][: 5 + with_ids], names=names[: 5 + with_ids])

    return cut


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each document (doc_id, text): ids plus ``end_id``.

    Columns doc_id, piece, start, length, ids_crc32 and, if asked for, ids
    (little-endian unsigned 32-bit).
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cutter(tokenizer_path, capacity, end_id, with_ids), IDS_SCHEMA if with_ids else PIECES_SCHEMA
    )


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into ``sizes``: each piece, largest first, goes where least room is left over."""
    room: dict[int, list[int]] = {}
    open_rooms, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = open_rooms >> sizes[i]
        if fits:
            left = ((fits & -fits).bit_length() - 1) + sizes[i]
            b = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left -= sizes[i]
        if left:
            room.setdefault(left, []).append(b)
            open_rooms |= 1 << left
    return bins


class _Stock:
    """How many pieces of each size are open, and which sizes there are (as a bit mask)."""

    def __init__(self, sizes: list[int]) -> None:
        self.count: dict[int, int] = {}
        self.mask = 0
        for s in sizes:
            self.put(s)

    def put(self, size: int) -> None:
        self.count[size] = self.count.get(size, 0) + 1
        self.mask |= 1 << size

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.mask &= ~(1 << size)

    def _reach(self, room: int) -> tuple[list[int], list[int]]:
        """Open sizes up to ``room``, and which sums the first few of them make (as bit masks), for each number of them."""
        sizes, reach, sums, fits = [], [1], 1, (1 << (room + 1)) - 1
        mask = self.mask & fits
        while mask:
            size = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            left, step = min(self.count[size], room // size), 1
            while left:
                # so many pieces at once, doubling, reach what any number of them does
                step = min(step, left)
                sums |= (sums << (step * size)) & fits
                left, step = left - step, 2 * step
            sizes.append(size)
            reach.append(sums)
        return sizes, reach

    def fillings(self, room: int, waste: int) -> Iterator[tuple[int, ...] | None]:
        """All undominated fillings of ``room`` that leave at most ``waste`` of it, least waste first, largest pieces first.

        None stands for each dominated one on the way, so that a search can count
        them. Sets of pieces are found by their sum: the sums that smaller sizes
        reach tell which choices end in a filling. Those tables are made anew
        when a search comes back, as it may hold many open levels.
        """
        held = list(self._reach(room))
        sums = held[1][-1]
        for total in range(room, max(0, room - waste) - 1, -1):
            if sums >> total & 1:
                for chosen in self._of_sum(held, total):
                    if self._dominated(chosen, room, room - total):
                        yield None
                        continue
                    held.clear()
                    yield chosen
                    held.extend(self._reach(room))

    def _of_sum(self, held: list[list[int]], total: int) -> Iterator[tuple[int, ...]]:
        """Sets of pieces of exactly ``total``, those with the largest pieces first; ``held``: sizes and their sums."""
        stack = [(len(held[0]), total, ())]
        while stack:
            i, left, chosen = stack.pop()
            if not left:
                yield chosen
                continue
            sizes, reach = held
            # sizes that can't be in a set of this sum are passed over
            while reach[i - 1] >> left & 1 and sizes[i - 1] > left:
                i -= 1
            size = sizes[i - 1]
            for n in range(min(self.count[size], left // size) + 1):
                if reach[i - 1] >> (left - n * size) & 1:
                    stack.append((i - 1, left - n * size, chosen + (size,) * n))
            # the tables must be free to go while the caller works with what it got
            del sizes, reach

    def _dominated(self, chosen: tuple[int, ...], room: int, waste: int) -> bool:
        """Whether an open piece could take the place of some of ``chosen`` (or of none) that are no larger together.

        What it replaces could then go where it would have gone, so the filling
        with it is at least as good.
        """
        sums, alone, used = 1, 1, {}
        several = 0
        for s in chosen:
            several |= (several | alone & ~1) << s
            alone |= 1 << s
            sums |= sums << s
            used[s] = used.get(s, 0) + 1
        others = self.mask & ((1 << (room + 1)) - 1)
        for s, n in used.items():
            if self.count[s] == n:
                others &= ~(1 << s)
        if not others:
            return False
        # sizes from a sum of several pieces, or beyond nothing or a single piece, up to the waste more
        reached, width = several | alone << 1, 1
        if not waste:
            return bool(several & others)
        while width < waste:
            step = min(width, waste - width)
            reached |= reached << step
            width += step
        return bool((reached | several | several << waste) & others)


def bin_completion(sizes: list[int], capacity: int, node_limit: int | None = NODE_LIMIT) -> list[list[int]]:
    """The bins of :func:`completed_bins`."""
    return completed_bins(sizes, capacity, node_limit)[0]


def completed_bins(sizes: list[int], capacity: int, node_limit: int | None = NODE_LIMIT) -> tuple[list[list[int]], bool]:
    """Bins of indexes into ``sizes``, never more than best-fit decreasing gives, and whether fewer are known to be impossible.

    Depth-first over sequences: each level completes the sequence begun by the
    largest open piece by every undominated filling whose waste still allows
    fewer sequences than the incumbent. The result is optimal unless the search
    ends by ``node_limit`` (fillings looked at, dominated ones too; None for no
    limit), with the best solution found so far.
    """
    incumbent = best_fit_decreasing(sizes, capacity)
    total = sum(sizes)
    bound = -(-total // capacity)
    if len(incumbent) <= bound:
        return incumbent, True
    limit = float("inf") if node_limit is None else node_limit
    stock, path, stack, waste, nodes = _Stock(sizes), [], [], 0, 0
    allowed = (len(incumbent) - 1) * capacity - total
    best: list[tuple[int, ...]] | None = None

    def options() -> Iterator[tuple[int, ...] | None]:
        lead = stock.mask.bit_length() - 1
        stock.take(lead)
        for chosen in stock.fillings(capacity - lead, allowed - waste):
            stock.put(lead)
            yield None if chosen is None else (lead, *chosen)
            # the search has put back what it took
            stock.take(lead)
        stock.put(lead)

    stack.append(options())
    while stack:
        chosen = next(stack[-1], ()) if nodes < limit else ()
        nodes += 1
        if chosen is None:
            continue
        if not chosen or waste + capacity - sum(chosen) > allowed:
            stack.pop()
            if path:
                done = path.pop()
                waste -= capacity - sum(done)
                for s in done:
                    stock.put(s)
            if nodes >= limit:
                break
            continue
        for s in chosen:
            stock.take(s)
        path.append(chosen)
        waste += capacity - sum(chosen)
        if stock.mask:
            stack.append(options())
            continue
        # the waste of a whole solution is within what one sequence less allows
        best = list(path)
        if len(best) <= bound:
            break
        allowed = (len(best) - 1) * capacity - total
        stack.append(iter(()))
    optimal = nodes < limit or best is not None and len(best) <= bound
    if best is None:
        return incumbent, optimal
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    return [[by_size[s].pop() for s in chosen] for chosen in best], optimal


def _packer(capacity: int, node_limit: int | None) -> Callable[[pa.Table], pa.Table]:
    def pack(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_pylist()
        group = table.column("pack_group")[0].as_py()
        sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        full = [i for i, s in enumerate(sizes) if s >= capacity]
        rest = [i for i, s in enumerate(sizes) if s < capacity]
        sequence[full] = (group << 32) + np.arange(len(full))
        bins, optimal = completed_bins([sizes[i] for i in rest], capacity, node_limit)
        for b, members in enumerate(bins):
            at = 0
            for k in members:
                i = rest[k]
                sequence[i], offset[i] = (group << 32) + len(full) + b, at
                at += sizes[i]
        placed = table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return placed.append_column("optimal", pa.array([optimal] * len(sizes), pa.bool_()))

    return pack


def pack(pieces: DataFrame, documents: int, capacity: int = 4096, group_documents: int = 4096, node_limit: int | None = NODE_LIMIT) -> DataFrame:
    """Place pieces (columns of :func:`token_pieces`) into sequences.

    ``documents`` is their documents' number, from which the number of groups
    follows. Adds sequence_id, offset and optimal: whether the piece's group is known
    to need as many sequences as it got, or its search ended by ``node_limit``.
    """
    prepare(pieces.sparkSession)
    groups = max(1, -(-documents // group_documents))
    # a row's place spreads repeated rows and documents without an id
    key = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    return (
        pieces.select("doc_id", "piece", "start", "length", "ids_crc32", key.alias("pack_group"))
        .groupBy("pack_group")
        .applyInArrow(_packer(capacity, node_limit), PACKED_SCHEMA)
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, group_documents: int = 4096, node_limit: int | None = NODE_LIMIT) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text): one row per piece, see :func:`pack`."""
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), docs.count(), capacity, group_documents, node_limit)
