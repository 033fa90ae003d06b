"""Arrays as compressed blobs, so that a shuffle moves few large rows instead of many small ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(arrays: list[np.ndarray], level: int = 1) -> bytes:
    """The bytes of ``arrays`` one after another, compressed; their dtypes are the reader's to know."""
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], dtype="<i8").tobytes()
    plain = b"".join([sizes, *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return len(plain).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(plain, asbytes=True)


def unpack(blob: bytes, dtypes: tuple[str, ...]) -> list[np.ndarray]:
    plain = pa.Codec("zstd").decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), asbytes=True)
    sizes = np.frombuffer(plain, dtype="<i8", count=len(dtypes), offset=8)
    out, at = [], 8 * (1 + len(dtypes))
    for dtype, size in zip(dtypes, sizes):
        out.append(np.frombuffer(plain, dtype=dtype, count=int(size) // np.dtype(dtype).itemsize, offset=at))
        at += int(size)
    return out


def unpack_all(blobs: list[bytes], dtypes: tuple[str, ...]) -> list[np.ndarray]:
    """Each array of all ``blobs``, concatenated."""
    parts = [unpack(b, dtypes) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=d) for i, d in enumerate(dtypes)]


def gather(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, portion: int = 1 << 18) -> np.ndarray:
    """``raw[s:s + n]`` of all (s, n), concatenated; indexes are made for a portion of the places at a time."""
    total = int(lengths.sum())
    if not total:
        return raw[:0]
    ends = np.cumsum(lengths)
    if total >= 512 * len(lengths):
        return np.concatenate([raw[s:e] for s, e in zip(starts.tolist(), (starts + lengths).tolist())])
    out = np.empty(total, dtype=raw.dtype)
    low = 0
    while low < len(lengths):
        begin = int(ends[low] - lengths[low])
        high = max(low + 1, int(np.searchsorted(ends, begin + portion, side="right")))
        n = lengths[low:high]
        size = int(n.sum())
        out[begin : begin + size] = raw[np.arange(begin, begin + size) + np.repeat(starts[low:high] - (ends[low:high] - n), n)]
        low = high
    return out


def loads(raw: np.ndarray, width: int) -> np.ndarray:
    """The little-endian unsigned number of ``width`` (4 or 8) bytes at every place of ``raw``."""
    raw = np.ascontiguousarray(raw)
    if len(raw) < width:
        return np.zeros(0, dtype=f"<u{width}")
    return np.ndarray(len(raw) - width + 1, dtype=f"<u{width}", buffer=raw.data, strides=(1,))


def groups_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted keys, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def runs_to_flags(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for each place of ``range(size)`` inside some run."""
    change = np.zeros(size + 1, dtype=np.int8)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    # runs that overlap or touch are one, so no place changes by more than one
    if len(starts):
        new = np.concatenate([[True], starts[1:] > ends[:-1]])
        change[starts[new]] = 1
        change[ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]] -= 1
    return np.cumsum(change[:size], dtype=np.int8).view(bool)


def flags_to_runs(flags: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True; no run goes across one of ``cuts``."""
    begin, end = flags.copy(), flags.copy()
    begin[1:] &= ~flags[:-1]
    end[:-1] &= ~flags[1:]
    inner = cuts[(cuts > 0) & (cuts < len(flags))]
    begin[inner] = flags[inner]
    end[inner - 1] = flags[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1
