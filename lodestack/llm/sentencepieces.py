"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary goes on past a white-space marker or holds a line
feed, so merges never cross from one marked word to the next. A text is cut
before each run of markers and each line feed, every distinct chunk is segmented
and decoded once by the library, and ids and texts are joined back by position.
:func:`check_vocabulary` refuses models for which this does not hold.

Defined cases: a null text is encoded as an empty one (begin and end id only);
an empty table gives no rows; repeated rows give repeated results; null ids are
carried along; a text of any length is coded a MiB or so at a time, cut only where
chunks are; other input columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import prepare, text_slices, worker_table

MARK = "▁"
CHUNKS = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
#: Chunks, and letters of them, in a generation of a worker's table; two generations are kept.
TABLE_ENTRIES, TABLE_LETTERS = 300_000, 16 << 20
CODED_SCHEMA = "doc_id long, ids binary, decoded string"


def check_vocabulary(processor) -> None:
    """Raise ValueError if some piece crosses a marker or holds a line feed, or the text is normalised."""
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if MARK in piece.lstrip(MARK) or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a chunk's border")
    probe = "  AÅﬁ　 b "
    if processor.decode(processor.encode(probe)) != probe:
        raise ValueError("the model normalises texts; chunks would have to be cut after that")


class ChunkTable:
    """Ids and decoded bytes of distinct chunks."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        check_vocabulary(self.processor)
        self.begin, self.end = (np.array([x], dtype="<u4").tobytes() for x in (self.processor.bos_id(), self.processor.eos_id()))
        self.lead = self.processor.encode("a")  # decodes to 'a', so that what follows keeps its spaces
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.letters = 0

    def _add(self, chunks: list[str]) -> None:
        # the library puts a marker in front: a marked chunk gives up one, a line's chunk drops it afterwards
        coded = self.processor.encode([c[1:].replace(MARK, " ") if c[0] == MARK else c for c in chunks], num_threads=1)
        coded = [x if c[0] == MARK else x[1:] for c, x in zip(chunks, coded)]
        # a lone marker stands for an empty text, which the library gives no ids
        coded = [x or [self.processor.piece_to_id(MARK)] for x in coded]
        decoded = self.processor.decode([self.lead + x for x in coded], num_threads=1)
        for chunk, ids, text in zip(chunks, coded, decoded):
            self.ids[chunk] = array("I", ids).tobytes()
            self.texts[chunk] = text[1:].encode()

    def code(self, text: str) -> tuple[bytes, bytes]:
        """Ids with begin and end id, and what they decode to, as UTF-8."""
        if not text:
            return self.begin + self.end, b""
        ids, texts = [self.begin], []
        marked = MARK + text.replace(" ", MARK)
        at, size = 0, 1 << 20
        while at < len(marked):
            # very long texts are cut at a line feed or marked word so that the list of chunks stays small
            cut = len(marked)
            if cut - at > 2 * size and (m := re.compile(f"(?<!{MARK}){MARK}|\n").search(marked, at + size)):
                cut = m.start()
            chunks = CHUNKS.findall(marked, at, cut)
            try:
                ids.append(b"".join(map(self.ids.__getitem__, chunks)))
            except KeyError:
                new = set(chunks).difference(self.ids)
                self.letters += sum(map(len, new))
                if len(self.ids) + len(new) > TABLE_ENTRIES or self.letters > TABLE_LETTERS:
                    # chunks in use move on to the new generation, the others are forgotten with the one before
                    self.older, self.ids, self.texts = (self.ids, self.texts), {}, {}
                    new = set(chunks)
                    self.letters = sum(map(len, new))
                ids_before, texts_before = self.older
                for chunk in new:
                    if chunk in ids_before:
                        self.ids[chunk], self.texts[chunk] = ids_before[chunk], texts_before[chunk]
                self._add([c for c in new if c not in self.ids])
                ids.append(b"".join(map(self.ids.__getitem__, chunks)))
            texts.append(b"".join(map(self.texts.__getitem__, chunks)))
            at = cut
        return b"".join([*ids, self.end]), b"".join(texts)[1:]


def coder(path: str, finish: Callable[[bytes, bytes], tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]):
    """A mapInArrow function from (doc_id, text) to doc_id and what ``finish`` makes of ids and decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(ChunkTable, path)
        for batch in batches:
            for low, high in text_slices(batch, "text", 4 << 20):
                part = batch.slice(low, high - low)
                made = [finish(*table.code(text or "")) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*made), kinds))], names=["doc_id", *names])

    return run


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit, begin and end id included), decoded."""
    prepare(docs.sparkSession)
    run = coder(model_path, lambda ids, text: (ids, text.decode()), ("ids", "decoded"), (pa.binary(), pa.string()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CODED_SCHEMA)
