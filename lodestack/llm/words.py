"""Words of many texts at once, as 64-bit hashes, by array operations on UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lodestack.llm.blobs import loads
from lodestack.llm.common import mix64

_FACTOR = np.uint64(0xD1B54A32D192ED03)
_FULL = np.uint64((1 << 64) - 1)
#: Bytes of a range that are hashed at once.
BLOCK = 256

#: Byte classes: what a byte counts as in a word, 0 for a byte between words.
PLAIN = np.array([0 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
PLAIN[0] = 128 + 64  # a NUL is part of a word; the byte 0xC0 never occurs in UTF-8
LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], dtype=np.uint8)


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each ``raw[s:e]``, whatever its length and place.

    Eight bytes at a time go through a finaliser that mixes all bits; longer ranges
    are the hashes of their blocks, hashed in turn. Good for finding candidates: a
    text made for it can collide, so what is found has to be compared.
    """
    words = loads(np.concatenate([raw, np.zeros(8, dtype=np.uint8)]), 8)
    lengths = ends - starts
    out = mix64(lengths.astype(np.uint64) + np.uint64(1))
    live, at = np.flatnonzero((lengths > 0) & (lengths <= BLOCK)), 0
    while len(live):
        left = lengths[live] - at
        word = words[starts[live] + at] & (_FULL >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
        out[live] = mix64((out[live] ^ word) * _FACTOR + np.uint64(at + 1))
        live, at = live[left > 8], at + 8
    long = np.flatnonzero(lengths > BLOCK)
    if len(long):
        parts = -(-lengths[long] // BLOCK)
        first = np.cumsum(parts) - parts
        begin = np.repeat(starts[long], parts) + BLOCK * (np.arange(int(parts.sum())) - np.repeat(first, parts))
        inner = range_hashes(raw, begin, np.minimum(begin + BLOCK, np.repeat(ends[long], parts)))
        out[long] = mix64(out[long] * _FACTOR + range_hashes(inner.view(np.uint8), 8 * first, 8 * (first + parts)))
    return out


@dataclass(frozen=True)
class Words:
    """Words in text order: hash, and the row of the text that each is in."""

    hashes: np.ndarray
    rows: np.ndarray

    def per_row(self, rows: int) -> np.ndarray:
        """First word of each row, and the end; rows + 1 places."""
        return np.searchsorted(self.rows, np.arange(rows + 1))


def words_of(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray = PLAIN) -> Words:
    """Words of the texts ``raw[offsets[i]:offsets[i + 1]]``.

    A word is a longest run of bytes whose class isn't 0; equal words have equal
    hashes, and unequal ones practically never have.
    """
    size = len(raw)
    if not size:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    seen = classes[raw]
    inside = seen != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # a text's first byte begins a word even if the text before ends with one
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = inside[starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = starts[1:] - 1
    last[ends] = inside[ends]
    last[-1] = inside[-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = range_hashes(seen, begin, end)
    return Words(hashes, np.searchsorted(offsets, begin, side="right") - 1)


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of ``size`` words; a text of fewer words is one run."""
    n = len(words.hashes)
    run = words.hashes.copy()
    length = np.ones(n, dtype=np.int64)
    for k in range(1, size):
        same = np.zeros(n, dtype=bool)
        if k < n:
            same[:-k] = words.rows[k:] == words.rows[:-k]
        following = np.zeros(n, dtype=np.uint64)
        following[:-k or None] = words.hashes[k:] if k else words.hashes
        run = np.where(same, mix64(run * _FACTOR + following), run)
        length += same
    first = np.ones(n, dtype=bool)
    first[1:] = words.rows[1:] != words.rows[:-1]
    keep = (length == size) | first
    return mix64(run + length.astype(np.uint64))[keep], words.rows[keep]
