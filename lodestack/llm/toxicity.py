"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models over words, one of toxic and one of ordinary texts, share
their lowest order: the continuation counts of both classes together. Each
order is discounted and interpolated with the one below,

    p_c(w | v) = max(n_c(v w) - d, 0) / n_c(v) + d t_c(v) / n_c(v) * p_c(w)
    p_c(w)     = max(k_c(w) - d, 0) / k_c      + d t_c / k_c       * p_0(w)
    p_0(w)     = (k(w) + 1/2) / (k + (words + 1) / 2)

with bigrams n, context types t and continuation counts k (of distinct words
before a word). So a rare expression weighs the same in both classes until one
of them has seen it. A text is described by length-normalised log-ratios of the
two classes: per word over the whole text, by either order; over its strongest
``WINDOW`` words, three words and one word; and by how many of its words are about
as telling as a word can be. A logistic curve over these gives the score. It is
fitted on a bounded sample of the labelled texts, described by the counts of all
others; every other text is described by the counts of all labelled ones.

The counts grow with the corpus and are neither capped, collected nor broadcast.
Texts are read once, in *packs* of bounded size. A pack sends each bucket of
words its distinct bigrams that begin with them, with their counts by class:
these are its share of the model and its questions at once. Buckets add the
counts up, exchange continuation counts (:func:`_contributed`), and answer each
pack (:func:`_answered`), which meets its words again (:func:`_finished`). Of words
that many texts are full of, the bigrams are dealt by their second word instead,
so that no bucket gathers a frequent word's.

Words are 48-bit hashes.

Defined cases: null and empty texts and texts without a word score 0; rows
without a label teach nothing; of several labels of an id the highest counts; if
a class is missing, every score is 0; an empty table gives no rows; repeated
rows teach and are scored once each; a text of any length is one row of a pack;
other columns are ignored, whatever their names. ``docs`` must give the same rows
when a lost task reads them again, as files do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.blobs import groups_of
from lodestack.llm.common import blocks, dealt, mix64, prepare, release_tables, small_side, text_slices, utf8_buffer
from lodestack.llm.words import LETTERS, Words, words_of

WINDOW = 8
LEVEL = 6
DISCOUNT = 0.75
#: Keys from here on are packs', those below buckets'.
PACKS = 1 << 62
ASK, BODY = 0, 1


@dataclass(frozen=True)
class Settings:
    """Rows of the logistic fit; bytes of text for a pack and a bucket, least buckets; what makes a word frequent, and bytes of text to look for such words."""

    fit_rows: int = 5_000
    pack_bytes: int = 32 << 20
    bucket_bytes: int = 64 << 20
    buckets: int = 16
    frequent: float = 1e-4
    probe_bytes: int = 64 << 20


def squeezed(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as compressed planes of their bytes; ``rising`` ones by their steps."""
    values = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    planes = np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T
    raw = planes.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True) if raw else b"")


def loosened(blob: bytes, kind: str, rising: bool = False) -> np.ndarray:
    size, kind = int.from_bytes(blob[:8], "little"), np.dtype(kind)
    if not size:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd"), dtype=np.uint8)
    values = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=kind) if rising else values


def bundled(parts: list[bytes]) -> bytes:
    return b"".join([len(parts).to_bytes(4, "little"), *(len(x).to_bytes(8, "little") for x in parts), *parts])


def unbundled(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    ends = np.cumsum([4 + 8 * n, *(int.from_bytes(blob[4 + 8 * i : 12 + 8 * i], "little") for i in range(n))]).tolist()
    return [blob[a:b] for a, b in zip(ends[:-1], ends[1:])]


def word_slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the words of all texts, none of them 0, and their rows."""
    hashes, rows, at = [], [], 0
    table = pa.RecordBatch.from_arrays([column], names=["text"])
    for low, high in text_slices(table, "text", 1 << 20):
        words = words_of(*utf8_buffer(column.slice(low, high - low)), LETTERS)
        hashes.append(np.maximum(words.hashes >> np.uint64(16), np.uint64(1)))
        rows.append((words.rows + low).astype(np.int32))
        at = high
    if not at:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    return np.concatenate(hashes), np.concatenate(rows)


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(words) % np.uint64(buckets)).astype(np.int64)


def pairs_of(sequence: np.ndarray, rows: np.ndarray, words: int) -> np.ndarray:
    """A number for each word's bigram: the word before it (0 before a text's first one) and itself."""
    before = np.zeros(len(sequence), dtype=np.int64)
    before[1:] = np.where(rows[1:] == rows[:-1], sequence[:-1], 0)
    return before * words + sequence


@dataclass(frozen=True)
class Deal:
    """How many buckets there are, and the sorted hashes of frequent words."""

    buckets: int
    frequent: np.ndarray

    def is_frequent(self, words: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(words), dtype=bool)
        return self.frequent[np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)] == words


def of_buckets(pairs: np.ndarray, bucket: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The bucket of each pair: its first word's, or its second one's if the first is frequent."""
    first, second = pairs // len(bucket), pairs % len(bucket)
    return np.where(frequent[first], bucket[second], bucket[first])


def _emitted(s: Settings, deal: Deal):
    """Of each pack its bigrams for the buckets (ASK) and its words (BODY)."""

    def pack(key: int, part: pa.RecordBatch) -> list[tuple]:
        slots, rows = word_slots(part.column("text"))
        words, sequence = np.unique(np.append(np.uint64(0), slots), return_inverse=True)
        sequence = sequence[1:]
        pairs = pairs_of(sequence, rows, len(words))
        toxic = part.column("toxic").fill_null(-1).to_numpy()
        drawn = part.column("drawn").to_numpy(zero_copy_only=False).astype(bool)
        distinct = np.unique(pairs)
        counts = np.zeros((4, len(distinct)), dtype="<u4")
        of, held = toxic[rows], drawn[rows]
        for c, chosen in enumerate((of == 0, of == 1, (of == 0) & held, (of == 1) & held)):
            seen, n = np.unique(pairs[chosen], return_counts=True)
            counts[c, np.searchsorted(distinct, seen)] = n
        bucket, frequent = bucket_of(words, deal.buckets), deal.is_frequent(words)
        made = []
        of_pair = of_buckets(distinct, bucket, frequent)
        by_pair, by_word = np.argsort(of_pair, kind="stable"), np.argsort(bucket, kind="stable")
        cuts, word_cuts = (np.searchsorted(x, np.arange(deal.buckets + 1)) for x in (of_pair[by_pair], bucket[by_word]))
        for b in range(deal.buckets):
            chosen, own = by_pair[cuts[b] : cuts[b + 1]], by_word[word_cuts[b] : word_cuts[b + 1]]
            if not (len(chosen) or len(own)):
                continue
            first, second = distinct[chosen] // len(words), distinct[chosen] % len(words)
            known = np.unique(np.concatenate([own, first, second]))
            heads = groups_of(first)
            blob = bundled([
                squeezed(words[known], True), squeezed(np.isin(known, own, assume_unique=True)), squeezed(np.searchsorted(known, first[heads[:-1]]).astype("<u4"), True),
                squeezed(np.diff(heads).astype("<u4")), squeezed(np.searchsorted(known, second).astype("<u4")), *(squeezed(x) for x in counts[:, chosen]),
            ])
            made.append((b, ASK, key, blob))
        # frequent words have small numbers in the body
        rank = np.argsort(-np.bincount(sequence, minlength=len(words)), kind="stable")
        number = np.empty(len(words), dtype="<u4")
        number[rank] = np.arange(len(words))
        ids = part.column("doc_id")
        body = bundled([
            squeezed(number[sequence]), squeezed(rank.astype("<u4")), squeezed(bucket.astype("<u4")), squeezed(frequent),
            squeezed(np.bincount(rows, minlength=part.num_rows).astype("<u4")), squeezed(ids.fill_null(0).to_numpy().astype("<i8")),
            squeezed(ids.is_null().to_numpy(zero_copy_only=False)), squeezed(toxic.astype("i1")), squeezed(drawn),
        ])
        return [*made, (PACKS + key, BODY, key, body)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        task = TaskContext.get().partitionId()
        for number, part in enumerate(blocks(batches, "text", s.pack_bytes)):
            yield _rows(pack((task << 24) + number, part))

    return run


ROWS = "key long, kind int, pack long, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["key", "kind", "pack", "blob"])


@dataclass(frozen=True)
class Asked:
    """What a pack sent to a bucket: words, which of them are the bucket's own, and bigrams with their counts."""

    words: np.ndarray
    own: np.ndarray
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray  # ordinary, toxic; of the drawn texts among them ordinary, toxic

    @classmethod
    def of(cls, blob: bytes) -> Asked:
        parts = unbundled(blob)
        first = np.repeat(loosened(parts[2], "<u4", True), loosened(parts[3], "<u4"))
        return cls(loosened(parts[0], "<u8", True), loosened(parts[1], "?"), first, loosened(parts[4], "<u4"), np.array([loosened(x, "<u4") for x in parts[5:9]]))

    def keys(self) -> np.ndarray:
        """A 64-bit hash of each bigram."""
        return mix64(mix64(self.words)[self.first] * np.uint64(0xD1B54A32D192ED03) + self.words[self.second])


@dataclass(frozen=True)
class Counts:
    """All labelled bigrams of a bucket by hash, with their words and counts as in Asked."""

    keys: np.ndarray
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, blobs: list[bytes]) -> Counts:
        parts = []
        for blob in blobs:
            asked = Asked.of(blob)
            taught = np.flatnonzero(asked.counts[0] + asked.counts[1])
            parts.append((asked.keys()[taught], asked.words[asked.first[taught]], asked.words[asked.second[taught]], asked.counts[:, taught].astype(np.float64)))
        keys, first, second, counts = (np.concatenate([p[i] for p in parts], axis=-1) for i in range(4))
        keys, at, place = np.unique(keys, return_index=True, return_inverse=True)
        return cls(keys, first[at], second[at], np.array([np.bincount(place, weights=x, minlength=len(keys)) for x in counts]))

    def models(self) -> list[np.ndarray]:
        """Counts of all labelled texts, and of those that were not drawn for the curve."""
        return [self.counts[:2], self.counts[:2] - self.counts[2:]]


#: Numbers of a word in either model: as a context n and t of each class; continuations k of each class and of both.
STATISTICS = 14
TOTALS = 12


def _statistics(counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Words of the bigrams, and what these bigrams give to the words' numbers."""
    words, place = np.unique(np.concatenate([counts.first, counts.second]), return_inverse=True)
    first, second = place[: len(counts.first)], place[len(counts.first) :]
    add = lambda at, weights: np.bincount(at, weights=weights, minlength=len(words))
    made = []
    for n in counts.models():
        made += [add(first, n[0]), add(first, n[1]), add(first, n[0] > 0), add(first, n[1] > 0), add(second, n[0] > 0), add(second, n[1] > 0), add(second, (n[0] > 0) | (n[1] > 0))]
    return words, np.array(made).reshape(STATISTICS, len(words))


def _contributed(buckets: int):
    """What the bigrams of a bucket give to the numbers of words, for the words' own buckets."""

    def run(table: pa.Table) -> pa.Table:
        release_tables()
        blobs = [b for b, k in zip(table.column("blob").to_pylist(), table.column("kind").to_pylist()) if k == ASK]
        rows = []
        if blobs:
            words, numbers = _statistics(Counts.of(blobs))
            bucket = bucket_of(words, buckets)
            for b in np.unique(bucket):
                chosen = bucket == b
                rows.append((int(b), ASK, 0, bundled([squeezed(words[chosen], True), *(squeezed(x[chosen].astype("<u8")) for x in numbers)])))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _added(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of a bucket and their numbers, from all contributions."""
    parts = [unbundled(b) for b in blobs]
    words, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *(loosened(p[0], "<u8", True) for p in parts)]), return_inverse=True)
    numbers = [np.concatenate([np.zeros(0), *(loosened(p[1 + i], "<u8").astype(np.float64) for p in parts)]) for i in range(STATISTICS)]
    return words, np.array([np.bincount(place, weights=x, minlength=len(words)) for x in numbers]).reshape(STATISTICS, len(words))


def _summed(table: pa.Table) -> pa.Table:
    """Of one bucket, for either model: continuation counts of each class and both, words of each class and all."""
    release_tables()
    _, numbers = _added(table.column("blob").to_pylist())
    sums = []
    for k in (numbers[4:7], numbers[11:14]):
        sums += [*k.sum(axis=1).tolist(), *(k > 0).sum(axis=1).tolist()]
    return pa.table([pa.array([float(x)], pa.float64()) for x in sums], names=[f"s{i}" for i in range(TOTALS)])


def _answered(asked: pa.Table, given: pa.Table) -> pa.Table:
    """For each pack that asked: its words' numbers and its bigrams' counts."""
    release_tables()
    questions = [(p, b) for p, k, b in zip(*(asked.column(c).to_pylist() for c in ("pack", "kind", "blob"))) if k == ASK]
    rows = []
    if questions:
        words, numbers = _added(given.column("blob").to_pylist())
        counts = Counts.of([b for _, b in questions])
        bucket = asked.column("key")[0].as_py()
        for number, blob in questions:
            pack = Asked.of(blob)
            told = found_in(words, numbers, pack.words[pack.own]).astype("<u8")
            told[7:] = told[:7] - told[7:]  # few texts are drawn, so most differences are 0
            held = found_in(counts.keys, counts.counts, pack.keys()).astype("<u4")
            rows.append((PACKS + number, bucket, 0, bundled([*map(squeezed, told), *map(squeezed, held)])))
    return pa.Table.from_batches([_rows(rows)])


@dataclass(frozen=True)
class Totals:
    """Sums of the continuation counts (ordinary, toxic, both), and words of each class and in all."""

    k: tuple[float, float, float]
    types: tuple[float, float, float]

    @property
    def whole(self) -> bool:
        return self.types[0] > 0 and self.types[1] > 0

    def lower(self, k: np.ndarray) -> np.ndarray:
        """p_0(w), p_1(w) of words with continuation counts ``k``."""
        shared = (k[2] + 0.5) / (self.k[2] + (self.types[2] + 1) / 2)
        return np.array([(np.maximum(k[c] - DISCOUNT, 0) + DISCOUNT * self.types[c] * shared) / self.k[c] for c in (0, 1)])

    def telling(self) -> float:
        """The log-ratio from which on a word alone counts as telling: near that of a word of many toxic texts and no other."""
        p = self.lower(np.array([[0.0], [1e12], [1e12]]))
        return 0.9 * float(np.log(p[1] / p[0])[0])


def found_in(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Columns of ``values`` at ``asked`` among the sorted ``keys``, 0 where it isn't there."""
    if not len(keys):
        return np.zeros((len(values), len(asked)), dtype=values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[:, at], 0)


FEATURES = 6


def features(paired: np.ndarray, ratio: np.ndarray, words: Words, rows: int, telling: float) -> np.ndarray:
    """What describes each text (see above) by its words' log-ratios, zeros for a text without words."""
    out = np.zeros((rows, FEATURES))
    if not len(words.hashes):
        return out
    place = words.per_row(rows)
    length = np.diff(place)
    filled = np.flatnonzero(length)
    out[filled, 0] = np.add.reduceat(np.clip(paired, -6, 6), place[filled]) / length[filled]
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    out[filled, 1] = (sums[place[filled + 1]] - sums[place[filled]]) / length[filled]
    # a window ends with its text, if that is shorter
    first = np.arange(len(ratio))
    last = np.minimum(first + WINDOW, place[words.rows + 1])
    window = (sums[last] - sums[first]) / np.minimum(WINDOW, length[words.rows])
    out[filled, 2] = np.maximum.reduceat(window, place[filled])
    out[filled, 3] = np.maximum.reduceat(ratio, place[filled])
    # the three strongest words: only those for the toxic class can be among them
    high = np.flatnonzero(ratio > 0)
    order = high[np.lexsort((-ratio[high], words.rows[high]))]
    rank = np.arange(len(order)) - np.searchsorted(words.rows[order], words.rows[order])
    top = order[rank < 3]
    out[:, 4] = np.bincount(words.rows[top], weights=ratio[top], minlength=rows) / 3
    out[:, 5] = np.log1p(np.bincount(words.rows[ratio >= telling], minlength=rows))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression by Newton's method on standardised features."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[0, 0] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + penalty @ w
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    return np.concatenate([[w[0] - (weights * mean).sum()], weights])


MADE_SCHEMA = "doc_id long, toxic int, drawn boolean, n_words long, x array<double>, rest array<double>"


def _finished(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """The rows of a pack and their features; of drawn ones also those by the counts of texts that weren't drawn."""
    release_tables()
    names, kinds = [f.split()[0] for f in MADE_SCHEMA.split(", ")], (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    bodies = [unbundled(b) for b, k in zip(texts.column("blob").to_pylist(), texts.column("kind").to_pylist()) if k == BODY]
    if not bodies:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    body = bodies[0]
    rank = loosened(body[1], "<u4").astype(np.int64)
    sequence = rank[loosened(body[0], "<u4")]
    bucket, frequent, lengths = loosened(body[2], "<u4").astype(np.int64), loosened(body[3], "?"), loosened(body[4], "<u4").astype(np.int64)
    ids, null, toxic, drawn = loosened(body[5], "<i8"), loosened(body[6], "?"), loosened(body[7], "i1"), loosened(body[8], "?")
    rows = np.repeat(np.arange(len(lengths)), lengths)
    pairs = pairs_of(sequence, rows, len(bucket))
    distinct = np.unique(pairs)
    of_pair = of_buckets(distinct, bucket, frequent)
    by_pair, by_word = np.argsort(of_pair, kind="stable"), np.argsort(bucket, kind="stable")
    numbers, counts = np.zeros((STATISTICS, len(bucket)), dtype=np.float32), np.zeros((4, len(distinct)), dtype=np.float32)
    sorted_pairs, sorted_words = of_pair[by_pair], bucket[by_word]
    told = dict(zip(answers.column("kind").to_pylist(), answers.column("blob").to_pylist()))
    if set(told) != set(np.unique(np.concatenate([of_pair, bucket])).tolist()):
        raise RuntimeError("a pack was read again with other rows: checkpoint the texts first")
    for b, blob in told.items():
        parts = unbundled(blob)
        own = by_word[np.searchsorted(sorted_words, b) : np.searchsorted(sorted_words, b, side="right")]
        chosen = by_pair[np.searchsorted(sorted_pairs, b) : np.searchsorted(sorted_pairs, b, side="right")]
        for i in range(STATISTICS):
            numbers[i, own] = loosened(parts[i], "<u8")
        numbers[7:, own] = numbers[:7, own] - numbers[7:, own]
        for i in range(4):
            counts[i, chosen] = loosened(parts[STATISTICS + i], "<u4")
    sums = answers.column("totals")[0].as_py()
    totals = [Totals(tuple(sums[f"s{i}"] for i in range(m, m + 3)), tuple(sums[f"s{i}"] for i in range(m + 3, m + 6))) for m in (0, 6)]
    x, rest = np.zeros((len(ids), FEATURES)), np.zeros((len(ids), FEATURES))
    edges = np.concatenate([[0], np.cumsum(lengths)])
    low = 0
    while low < len(ids):
        # as many texts as hold about half a million words
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + 500_000, side="right")) - 1)
        part = slice(edges[low], edges[high])
        words = Words(sequence[part], rows[part] - low)
        pair, before = np.searchsorted(distinct, pairs[part]), pairs[part] // len(bucket)
        for m, (out, total) in enumerate(((x, totals[0]), (rest, totals[1]))):
            if not total.whole or (m and not drawn[low:high].any()):
                continue
            n = counts[:2] if m == 0 else counts[:2] - counts[2:]
            of_word = numbers[7 * m : 7 * m + 7, words.hashes].astype(np.float64)
            of_context = numbers[7 * m : 7 * m + 4, before].astype(np.float64)
            p = total.lower(of_word[4:7])
            logs = []
            for c in (0, 1):
                full = (np.maximum(n[c, pair] - DISCOUNT, 0) + DISCOUNT * of_context[2 + c] * p[c]) / np.maximum(of_context[c], 1)
                logs.append(np.log(np.where(of_context[c] > 0, full, p[c])))
            out[low:high] = features(logs[1] - logs[0], np.log(p[1]) - np.log(p[0]), words, high - low, total.telling())
        low = high
    columns = [
        pa.array(ids, mask=null), pa.array(toxic.astype(np.int32), mask=toxic < 0), pa.array(drawn), pa.array(lengths),
        pa.array(x.tolist(), kinds[4]), pa.array([r if d else None for r, d in zip(rest.tolist(), drawn.tolist())], kinds[5]),
    ]
    return pa.table([c.cast(k) for c, k in zip(columns, kinds)], names=names)


def frequent_words(docs: DataFrame, total: int, s: Settings) -> np.ndarray:
    """Sorted hashes of words that make up about ``s.frequent`` of all words or more: 2 / s.frequent at most.

    They only decide in which bucket counts meet, not what the counts are, so
    they are looked for in texts of about ``s.probe_bytes``.
    """
    share = min(1.0, s.probe_bytes / max(1, total))
    probe = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for part in blocks(batches, "text", s.pack_bytes // 4):
            words, n = np.unique(word_slots(part.column("text"))[0], return_counts=True)
            often = n >= s.frequent / 2 * n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.append(words[often], np.uint64(0)).view(np.int64)), pa.array(np.append(n[often], n.sum()))], names=["word", "n"])

    # a row of the word 0 holds the number of all words
    found = probe.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.col("word") != 0, F.desc("n"), "word").limit(1 + int(2 / s.frequent)).collect()
    words = next((r["n"] for r in rows if r["word"] == 0), 0)
    return np.array(sorted(r["word"] for r in rows if r["word"] and r["n"] >= s.frequent / 2 * words), dtype=np.uint64)


def described(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, toxic, drawn (for the curve), n_words and features of every row of ``docs`` (doc_id, text, toxic); cut off from its lineage."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    totals = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("toxic").alias("labelled")).first()
    total = totals["bytes"] or 0
    share = min(0.2, s.fit_rows / max(1, totals["labelled"]))
    drawn = F.col("toxic").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 20)) < share * (1 << 20))
    deal = Deal(max(s.buckets, -(-total // s.bucket_bytes)), frequent_words(docs, total, s))
    groups = deal.buckets + -(-total // s.pack_bytes)
    emitted = dealt(docs.withColumn("drawn", F.coalesce(drawn, F.lit(False))).mapInArrow(_emitted(s, deal), ROWS), "key", groups)
    given = dealt(emitted.groupBy("key").applyInArrow(_contributed(deal.buckets), ROWS), "key", groups)
    sums = given.groupBy("key").applyInArrow(_summed, ", ".join(f"s{i} double" for i in range(TOTALS)))
    sums = sums.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(TOTALS)]).select(F.struct("*").alias("totals"))
    answers = emitted.groupBy("key").cogroup(given.groupBy("key")).applyInArrow(_answered, ROWS)
    answers = dealt(answers.select("key", "kind", "blob", sums.scalar().alias("totals")), "key", groups)
    return emitted.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(_finished, MADE_SCHEMA).checkpoint()


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text, toxic); rows with a toxic of 0 or 1 teach, the others don't."""
    made = described(docs, s)
    rows = made.where("drawn and n_words > 0").select("toxic", "rest").collect()  # about s.fit_rows at most
    y = np.array([r["toxic"] for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return made.select("doc_id", F.lit(0.0).alias("score"))
    weights = logistic(np.array([r["rest"] for r in rows]), y, ridge=1e-3)
    terms: Column = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:]):
        terms = terms + F.lit(float(w)) * F.get("x", F.lit(i))
    return made.select("doc_id", F.when(F.col("n_words") > 0, 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), terms))))).otherwise(0.0).alias("score"))


def with_labels(docs: DataFrame, labels: DataFrame, teaches: Column) -> DataFrame:
    """doc_id, text and toxic (0 or 1, null without a label or where ``teaches`` does not hold) of every row of ``docs``."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    joined = docs.select("doc_id", "text", teaches.alias("teaches")).join(small_side(known, labels.count()), "doc_id", "left")
    return joined.select("doc_id", "text", F.when(F.col("teaches") & F.col("toxic").isNotNull(), (F.col("toxic") > 0).cast("int")).alias("toxic"))
