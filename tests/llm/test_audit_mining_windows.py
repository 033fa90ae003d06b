"""Filter audit, hard negatives and window packing against plain versions."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import filter_audit, hard_negatives, window_packing
from lodestack.llm.hard_negatives import Codebook, Mining
from lodestack.llm.window_packing import OpenWindow, Packer, Piece, Shape

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, part string, mask int, n string, good string"


# filter audit


@pytest.mark.parametrize("size", range(1, 7))
def test_plain_changes_visit_all_orders(size):
    order, seen = list(range(size)), []
    for at in filter_audit.plain_changes(size):
        if at is not None:
            order[at], order[at + 1] = order[at + 1], order[at]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(size)))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=16, max_size=16), st.lists(st.integers(0, 9), min_size=16, max_size=16))
def test_walk_as_by_hand(n, marked):
    cells = np.array([n, marked], dtype=np.int64).T
    orders, shapley = filter_audit.walk(cells, "WXYZ")
    expected = [0] * 4
    for order, steps in orders:
        left = {m: cells[m] for m in range(16)}
        for place, letter in enumerate(order):
            f = "WXYZ".index(letter)
            gone = [left.pop(m) for m in list(left) if m >> f & 1]
            assert steps[place].tolist() == np.sum(gone, axis=0).tolist() if gone else not steps[place].any()
            expected[f] += int(steps[place][0])
    assert len({o for o, _ in orders}) == 24 and shapley.tolist() == expected


def audit_by_hand(docs, labels):
    """Every order over every part, document by document."""
    good, toxic = ({i for i, *v in labels if i is not None and v[m] == 1} for m in (0, 1))
    least = {}
    for doc_id, text, *_ in docs:
        at = filter_audit.LAST if doc_id is None else doc_id
        least[text or ""] = min(least.get(text or "", at), at)
    parts = {}
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        words = text.encode().split()
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        fails |= {"D"} if set(text) & set("#$%&*|") else set()
        fails |= {"E"} if least[text] < (filter_audit.LAST if doc_id is None else doc_id) else set()
        parts.setdefault(lang or "", []).append((fails, doc_id in good, doc_id in toxic))
    rows, sums = set(), {}
    for part, own in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                failing = sum(letter in d[0] for d in own)
                sums[part, letter] = sums.get((part, letter), 0) + len(gone)
                rows.add((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[0] == {letter} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)))
    return sorted((*r, sums[r[0], r[1][r[2] - 1]]) for r in rows)


def audit_docs():
    rng = random.Random(3)
    plain = [f"w{k}" for k in range(150)]
    texts = [None, "", " \n\t ", " ".join(plain), " ".join(plain[:50] * 3), " ".join(plain).upper(), "a # b", " ".join([*plain, "100%"]), "\x1c".join(plain), "x" * 300_000, "É" * 9, " ".join(plain * 400)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""]), "p", 1, "n", "g") for i in range(60)]
    return [*rows, rows[0], rows[7], (None, texts[3], "en", "p", 1, "n", "g"), (None, texts[3], "en", "p", 1, "n", "g"), (None, "only here", "fr", "p", 1, "n", "g"), (70, "same id", "en", "p", 1, "n", "g"), (70, "other text", "en", "p", 1, "n", "g")]


def test_audit_as_by_hand(spark):
    docs = audit_docs()
    labels = [(i, i % 2 if i % 5 else None, i % 3 == 0 and 1 or 0) for i in range(0, 80, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (70, 1, None), (999, 1, 1)]
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audit_by_hand(docs, labels)


def test_audit_of_an_empty_table_and_without_labels(spark):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(empty, labels, {"good": F.col("quality") == 1}).count() == 0
    two = [filter_audit.Filter("S", lambda text: F.length(text) < 3), filter_audit.Filter("L", lambda text: F.length(text) > 5)]
    got = filter_audit.audit(spark.createDataFrame([(1, "ab", "x", "", 0, "", ""), (2, "abcdef", "x", "", 0, "", ""), (3, "abcd", "x", "", 0, "", "")], DOCS), None, {}, two)
    assert sorted(map(tuple, got.collect())) == [("x", "LS", 1, 2, 1, 0, 1, 2), ("x", "LS", 2, 1, 1, 0, 1, 2), ("x", "SL", 1, 2, 1, 0, 1, 2), ("x", "SL", 2, 1, 1, 0, 1, 2)]


# hard negatives


def mined_by_hand(rows, positives=5, negatives=5, low=80, high=100):
    kept = [(i, lab, [int(np.floor(256 * float(x))) for x in e]) for i, e, lab, *_ in rows if i is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    found, asked = set(), set()
    for anchor_id, label, a in sorted(kept, key=lambda r: (r[0], r[1], r[2])):
        if anchor_id % 10 or anchor_id in asked:
            continue
        asked.add(anchor_id)
        scored = [(-sum(x * y for x, y in zip(a, e)), i, lab) for i, lab, e in kept if i != anchor_id and len(e) == len(a)]
        for place, (p, pos, _) in enumerate(sorted(s for s in scored if s[2] == label)[:positives]):
            inside = sorted(s for s in scored if s[2] != label and -low * p <= -100 * s[0] <= -high * p)
            found |= {(anchor_id, pos, place + 1, rank + 1, neg, -p, -n) for rank, (n, neg, _) in enumerate(inside[:negatives])}
    return found


def vector_rows(seed, count=240, dim=6):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).astype("float32").tolist(), int(rng.integers(0, 4)), "c", 0.5) for i in range(count)]
    rows += [(1000 + i, rows[5][1], i % 2, "c", 0.5) for i in range(30)]  # ties
    rows += [(20, rows[3][1], 1, "c", 0.5), (21, rows[21][1], rows[21][2], "c", 0.5)]  # repeated ids
    odd = [(None, rows[1][1], 1), (500, None, 1), (510, [None] * dim, 1), (520, [float("nan")] * dim, 1), (530, [float("inf")] * dim, 0), (540, [], 0), (550, rows[2][1], None), (560, [0.5] * (dim + 1), 2), (570, [0.4] * (dim + 1), 2), (571, [0.35] * (dim + 1), 3), (580, [0.0] * dim, 1)]
    return rows + [(*r, "c", 0.5) for r in odd]


VECTORS = "vec_id bigint, embedding array<float>, label int, codes string, residual double"


@pytest.mark.parametrize("mining", [Mining(), Mining(block_rows=32, block_anchors=4, sample_rows=50, components_per_code=4), Mining(positives=3, negatives=2, low_percent=50, high_percent=120)])
def test_mining_as_by_hand(spark, mining):
    rows = vector_rows(1)
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 10 == 0, mining=mining)
    expected = mined_by_hand(rows, mining.positives, mining.negatives, mining.low_percent, mining.high_percent)
    got = [tuple(r) for r in got.collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_mining_of_an_empty_table(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 10 == 0).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 7), st.integers(1, 5))
def test_bounds_hold_and_spare_work(seed, per_code, k):
    rng = np.random.default_rng(seed)
    vectors = np.floor(256 * rng.normal(size=(400, 7)))
    book = Codebook(vectors[:300], per_code)
    codes, left = book.encode(vectors)
    made = np.zeros_like(vectors)
    for s, (a, b) in enumerate(zip(book.cuts, book.cuts[1:])):
        made[:, a:b] = book.centroids[s][codes[:, s]]
    assert (np.linalg.norm(vectors - made, axis=1) <= left + 1e-6).all()
    places = (codes.astype(np.int32) + 256 * np.arange(codes.shape[1], dtype=np.int32)).T.copy()
    block = hard_negatives.Block(np.arange(400), np.zeros(400), vectors, places, left)
    anchor = vectors[0]
    exact = vectors @ anchor
    high = float(np.sort(exact)[-6])
    (found,), scored = hard_negatives.search(block, np.ones(400, dtype=bool), anchor, book, [(0.8 * high, high)], k)
    inside = sorted((-int(s), i) for i, s in enumerate(exact) if 0.8 * high <= s <= high)[:k]
    assert found == [(i, -s) for s, i in inside]
    assert scored < 400


# window packing


def pieces_of(ids):
    return Piece(1, 0, np.arange(ids, dtype="<u4").tobytes(), ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 5), st.sampled_from([0, 3]))
def test_online_placement(lengths, open_windows, spare):
    shape = Shape(capacity=32, open_windows=open_windows, spare=spare)
    packer, emitted = Packer(shape), []
    for number, length in enumerate(lengths):
        before = packer.windows()
        out = list(packer.put(Piece(number, 0, np.arange(length, dtype="<u4").tobytes(), length)))
        emitted += out
        assert packer.open == len(packer.windows()) <= open_windows
        rest = length % 32
        fits = [w for w in before if 32 - w.length + 0 >= rest]
        if rest and fits and not any(p.doc_id != number for w in out for p in w.pieces):
            # uncut in the window with least room
            assert any(w.pieces[-1].doc_id == number and w.pieces[-1].length == rest for w in [*packer.windows(), *out] if w.pieces)
    full, left = window_packing.merge(packer.windows(), shape)
    final = list(window_packing.in_powers(left)) if left else []
    for w in [*emitted, *full]:
        assert w.length == 32 or 32 - w.length <= spare or w.length & (w.length - 1) == 0
    assert all(w.length & (w.length - 1) == 0 for w in final)
    got = {}
    for w in [*emitted, *full, *final]:
        assert sum(p.length for p in w.pieces) == w.length <= 32
        for p in w.pieces:
            got.setdefault(p.doc_id, []).append((p.start, p.ids))
    for number, length in enumerate(lengths):
        assert b"".join(ids for _, ids in sorted(got[number])) == np.arange(length, dtype="<u4").tobytes()


def test_the_fullest_is_emitted_filled_by_a_cut():
    packer = Packer(Shape(capacity=16, open_windows=2))
    assert not [w for n in (10, 12) for w in packer.put(pieces_of(n))]
    (out,) = packer.put(pieces_of(7))
    assert [p.length for p in out.pieces] == [12, 4] and sorted(w.length for w in packer.windows()) == [13]
    packer = Packer(Shape(capacity=16, open_windows=2, spare=4))
    assert not [w for n in (10, 12) for w in packer.put(pieces_of(n))]
    (out,) = packer.put(pieces_of(7))
    assert [p.length for p in out.pieces] == [12] and sorted(w.length for w in packer.windows()) == [7, 10]


def packing_texts():
    rng = random.Random(5)
    return [None, "", " ", "Hello, WORLD. don't stop.", "日本語 テキスト", *(" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(5)) for _ in range(rng.choice([3, 80, 900, 4000]))) for _ in range(60))]


@pytest.mark.parametrize("shape", [Shape(), Shape(open_windows=2, merge_partitions=2), Shape(spare=100)])
def test_window_packing(spark, shape):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = packing_texts()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").selectExpr("doc_id", "text", "1 AS start", "2 AS length", "3 AS leftover").repartition(5)
    rows = window_packing.pack_windows(frame, WORD_BPE, 2, shape, with_ids=True).collect()
    documents, places = {}, {}
    for r in rows:
        documents.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] > 0 and r["ids_crc32"] == zlib.crc32(r["ids"])
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for start, own in sorted(documents[i]):
            assert start == at
            at += len(own) // 4
        assert b"".join(own for _, own in sorted(documents[i])) == ids.tobytes()
        assert {r["doc_tokens"] for r in rows if r["doc_id"] == i} == {len(ids)}
    padded = 0
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padded += window_packing.padding(at, 4096)
    assert padded <= shape.spare * len(places)
    windows = window_packing.sequences(window_packing.pack_windows(frame, WORD_BPE, 2, shape, with_ids=True), shape).collect()
    assert sum(w["length"] for w in windows) == sum(r["length"] for r in rows) and all(len(w["ids"]) == 4 * w["length"] for w in windows)


def test_window_packing_of_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert window_packing.pack_windows(spark.createDataFrame([], schema), WORD_BPE, 2).count() == 0
    rows = window_packing.pack_windows(spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None)], schema), WORD_BPE, 2).collect()
    assert sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == [1, 3, 3] and sum(r["length"] for r in rows) == 7


def test_left_over_windows_merge():
    windows = []
    for n in (9, 20, 31, 5, 5):
        windows.append(OpenWindow())
        windows[-1].add(pieces_of(n))
    full, left = window_packing.merge(windows, Shape(capacity=32))
    assert [w.length for w in full] == [32, 32] and left.length == 6
