"""Suffix, chunk and Jaccard deduplication against plain versions of the same rules."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import chunk_dedup, jaccard_join, suffix_dedup
from lodestack.llm.blobs import gather, runs_to_flags
from lodestack.llm.deep_shallow import BlindTrie, sort_groups
from lodestack.llm.graph import components
from lodestack.llm.words import PLAIN, range_hashes, shingles_of, words_of

SCHEMA = "doc_id bigint, text string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 90).split(" ")
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = prose(rng, rng.randint(0, 80))
        elif kind == 1:
            text = prose(rng, 15) + " " + passage + " " + prose(rng, 10)
        elif kind == 2:
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            text = " ".join(words)
        elif kind == 3:
            text = " ".join(base)
        elif kind == 4:
            text = "a" * rng.choice([10, 49, 50, 51, 200])
        else:
            text = prose(rng, 3) + "\n" + "the same line again and again and again, to the end of it\n" * 3
        rows.append((i * 3 % 61, text))
    return [*rows, (None, passage), (None, None), (7, rows[3][1]), (7, rows[3][1]), (900, ""), (901, None), rows[5], rows[5], (-4, passage[10:200])]


def removed_by_hand(rows, length):
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            key = (1 << 63) - 1 if i is None else i
            g = b[p : p + length]
            first[g] = min(first.get(g, key), key)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        key = (1 << 63) - 1 if i is None else i
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key:
                gone[p : p + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [50, 24, 134, 200])
def test_repeats_are_removed_as_by_hand(spark, length):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 AS tag", "'x' AS blob").repartition(5)
    got = suffix_dedup.remove_repeats(frame, length, digest=True)
    assert sorted(map(tuple, got.collect()), key=repr) == removed_by_hand(rows, length)


def test_long_runs_of_one_passage(spark):
    passage = prose(random.Random(4), 400)
    rows = [(1, passage), (2, "x" + passage), (3, passage[200:] + "y")]
    for length in (133, 150, 200):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), length, digest=True)
        assert sorted(map(tuple, got.collect()), key=repr) == removed_by_hand(rows, length)


def test_very_long_texts(spark):
    """Texts beyond the slices of 1 and 2 MiB, repeated rows among them."""
    rng = random.Random(12)
    words = [prose(rng, 1) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(700_000))
    assert len(long.encode()) > 5 << 19
    rows = [(1, long), (2, "first " + long[1_000_000:1_000_400] + " last"), (3, long), (3, long)]
    docs = spark.createDataFrame(rows, SCHEMA)
    size, part = len(long.encode()), rows[1][1].encode()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs, 50, digest=True).collect())
    assert got[0] == (1, size, 0) and got[2:] == [(3, size, size)] * 2
    assert got[1][:2] == (2, len(part)) and len(part) - got[1][2] <= 12
    cut = sorted((r["doc_id"], r["n_removed"]) for r in chunk_dedup.remove_repeated_chunks(docs).collect())
    assert cut[0] == (1, 0) and cut[1][1] > 200 and all(n > size - 200 for _, n in cut[2:])
    joined = jaccard_join.similarity_components(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in joined) == [(1, 1), (2, 2), (3, 1), (3, 1)]


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA), 50).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00", min_size=12, max_size=12), min_size=1, max_size=40), st.integers(0, 12))
def test_deep_shallow_sorts(strings, shallow):
    raw = np.frombuffer("".join(strings).encode() + b"\0" * 8, dtype=np.uint8)
    starts = np.arange(len(strings)) * 12
    order, classes = sort_groups(raw, starts, np.full(len(strings), 12), np.zeros(len(strings), dtype=np.int64), shallow)
    assert [strings[i] for i in order] == sorted(strings)
    ranks = {s: k for k, s in enumerate(sorted(set(strings)))}
    assert [ranks[s] for s in strings] == classes.tolist()


def test_copies_need_no_trie(monkeypatch):
    """A trie gets what differs from its group's first suffix; groups of copies get none."""
    added = []
    monkeypatch.setattr(BlindTrie, "add", lambda self, text, member, add=BlindTrie.add: (added.append(member), add(self, text, member))[1])
    rng = random.Random(3)
    lead = prose(rng, 40)[:32]
    copies = [lead[:31] + "x" + prose(rng, 20)[:18]] * 50
    mixed = [lead + "b" * 18, *[lead + "c" * 18] * 50, lead + "a" * 18, *[lead + "b" * 18] * 30]
    strings = [s.encode()[:50].ljust(50) for s in copies + mixed]
    raw = np.frombuffer(b"".join(strings) + b"\0" * 8, dtype=np.uint8)
    groups = np.array([0] * len(copies) + [1] * len(mixed))
    order, classes = sort_groups(raw, np.arange(len(strings)) * 50, np.full(len(strings), 50), groups)
    assert [strings[i] for i in order] == sorted(strings[:50]) + sorted(strings[50:])
    assert classes.tolist() == [0] * 50 + [{b"a": 1, b"b": 2, b"c": 3}[s[-1:]] for s in strings[50:]]
    assert len(added) == 52


def test_windows_of_one_document_are_not_sorted(monkeypatch):
    """Of spans that share an anchor, only windows go to the sorter that agree next to it with another document."""
    given_to = []
    monkeypatch.setattr(suffix_dedup, "sort_groups", lambda raw, starts, *rest: (given_to.append(len(starts)), sort_groups(raw, starts, *rest))[1])
    rng = random.Random(9)
    common = prose(rng, 60).encode()[:112]  # around one anchor
    p = suffix_dedup.Plan(50, 12, 1, 1, 32)
    spans = []
    for i in range(40):
        # documents 0 and 1 agree in 40 bytes before and 12 after the anchor, the others in the anchor and 24 bytes after it
        own = bytes(rng.choice(b"vwxyz") for _ in range(62)) + b"vw"[i % 2 :][:1] + bytes(rng.choice(b"vwxyz") for _ in range(25))
        spans.append(common[:38] + common[38:50] + common[50:62] + own[62:] if i < 2 else own[:38] + common[38:50] + common[50:74] + own[74:])
    arrays = [np.arange(40), np.zeros(40, dtype=np.int64), np.full(40, 88), np.full(40, 38), np.ones(40, dtype=np.int64), np.zeros(40, dtype=np.int64), np.frombuffer(b"".join(spans), dtype=np.uint8)]
    ranges = suffix_dedup.bucket_ranges(arrays, p)
    assert [x.tolist() for x in ranges] == [[1], [0], [0], [62]]
    assert given_to[1] <= 2 * 16 + 40 * 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=6), min_size=1, max_size=50))
def test_blind_trie(strings):
    trie = BlindTrie()
    for i, s in enumerate(strings):
        trie.add(s, i)
    assert [[strings[i] for i in leaf] for leaf in trie.leaves()] == [[s] * n for s, n in sorted(Counter(strings).items())]


def chunks_by_hand(b, c):
    cuts = []
    for i in range(len(b)):
        h = 0
        for j in range(max(0, i - chunk_dedup.WINDOW + 1), i + 1):
            h = ((h << 1) + int(chunk_dedup.GEAR[b[j]])) & 0xFFFF
        if h >> (16 - c.bits) == 0:
            cuts.append(i + 1)
    kept = [x for k, x in enumerate(cuts) if k == 0 or x - cuts[k - 1] >= c.least]
    edges = sorted({0, len(b), *kept})
    return [(x, min(x + c.most, t)) for s, t in zip(edges, edges[1:]) for x in range(s, t, c.most)]


def cut_by_hand(rows, c):
    """doc_id, bytes, removed bytes and runs, chunks, repeated chunks and text left of each row."""
    last = (1 << 63) - 1
    owner, cut = {}, []
    for i, text in rows:
        b = (text or "").encode()
        cut.append((last if i is None else i, b, chunks_by_hand(b, c)))
        for s, e in cut[-1][2]:
            owner[b[s:e]] = min(owner.get(b[s:e], last), cut[-1][0])
    out = []
    for (i, _), (key, b, chunks) in zip(rows, cut):
        repeat = [owner[b[s:e]] < key for s, e in chunks]
        gone, k, runs = np.zeros(len(b), dtype=bool), 0, 0
        while k < len(chunks):
            m = k
            while m < len(chunks) and repeat[m]:
                m += 1
            if m > k:
                s, e = chunks[k][0], chunks[m - 1][1]
                if e - s >= c.run_bytes and sum(max(0, y - x - c.silent) for x, y in chunks[k:m]) >= c.evidence:
                    gone[s:e] = True
                    runs += 1
            k = max(m, k + 1)
        out.append((i, len(b), int(gone.sum()), runs, len(chunks), sum(repeat), np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "replace")))
    return out


def test_chunks_as_by_hand(spark):
    rows, c = corpus(2), chunk_dedup.Chunking(most=64)
    got = chunk_dedup.remove_repeated_chunks(spark.createDataFrame(rows, SCHEMA).repartition(5), c).drop("tag")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(cut_by_hand(rows, c), key=repr)


def test_chunks_resist_insertions():
    rng = random.Random(5)
    text = prose(rng, 300).encode()
    c = chunk_dedup.Chunking()
    cut = lambda b: {b[s:e] for s, e in zip(*chunk_dedup.chunks_of(np.frombuffer(b, np.uint8), np.array([0, len(b)]), c))}
    before, after = cut(text), cut(text[:500] + b"inserted" + text[500:])
    assert len(before - after) <= 4


def test_deduplicated_keeps_columns(spark):
    passage = prose(random.Random(3), 80)
    rows = [(1, passage, "a"), (2, "head words here " + passage + " tail", "b"), (3, passage, "c"), (4, None, "d"), (5, "", "e"), (None, "alone it is", "f")]
    got = {r["source"]: r["text"] for r in chunk_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA + ", source string")).collect()}
    # all of 3 repeats 1, except for the edges of chunks; what is left of 2 keeps its own words
    assert got["a"] == passage and "head words" in got["b"] and len(got["b"]) < 150
    assert got["d"] is None and got["e"] == "" and got["f"] == "alone it is"
    assert "c" not in got


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_by_hand(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components_by_hand(rows, size, percent):
    sets = [(i, sets_by_hand(t, size)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for b, (k, t) in enumerate(sets[:a]):
            n = len(s & t)
            if i is not None and k is not None and n and 100 * n >= percent * len(s | t):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[find(a)].append(i)
    return sorted(((i, len(s), None if i is None else min(x for x in least[find(a)] if x is not None)) for a, (i, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("size, percent, rounds", [(4, 85, 6), (4, 85, 0), (2, 60, 6), (5, 80, 1)])
def test_components_as_by_hand(spark, size, percent, rounds):
    rng = random.Random(size)
    rows = corpus(3, 90)
    base = prose(rng, 120).split(" ")
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((1000 + i, " ".join(words)))
    rows = list(dict.fromkeys(rows))
    join = jaccard_join.Join(shingle=size, percent=percent, rounds=rounds)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "5 AS node", "6 AS n", "7 AS tag").repartition(4)
    got = jaccard_join.similarity_components(frame, join)
    assert sorted(map(tuple, got.collect()), key=repr) == components_by_hand(rows, size, percent)


def test_keep_one(spark):
    text = prose(random.Random(9), 50).replace("é", "e")
    rows = [(1, text, "a"), (2, text, "b"), (3, text.upper(), "c"), (4, "other words", "d"), (4, "other words", "d"), (5, "", "e"), (None, text, "f"), (6, None, "g")]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, SCHEMA + ", source string"))
    assert got.columns == ["doc_id", "text", "source"]
    assert sorted(r["source"] for r in got.collect()) == ["a", "d", "e", "f", "g"]
    assert jaccard_join.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    hinted, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: hinted.append(df.columns) or broadcast(df))
    rows = [*corpus(4, 90), (2000, "\u00a0"), (2001, "\x1c"), (2002, " \u00a0\n")]
    tables = len(spark.catalog.listTables())
    joined = jaccard_join.similarity_components(spark.createDataFrame(rows, SCHEMA))
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, SCHEMA))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in joined.collect()}
    assert got[2000] == got[2002] == (1, 2000) and got[2001] == (1, 2001)
    assert {2000, 2001} <= {r["doc_id"] for r in kept.collect()} and len(spark.catalog.listTables()) == tables
    # the least neighbours of a bounded number of edges only
    assert all(columns == ["u", "m"] for columns in hinted)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aA é\n\t\x00\x1f", max_size=20), max_size=6))
def test_words_and_shingles(texts):
    encoded = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in encoded])]).astype(np.int64)
    words = words_of(np.frombuffer(b"".join(encoded), np.uint8), offsets, PLAIN)
    plain = [(row, w) for row, t in enumerate(texts) for w in WORD.findall(t.translate(LOWER))]
    assert words.rows.tolist() == [r for r, _ in plain]
    assert len(set(words.hashes.tolist())) == len({w for _, w in plain})
    hashes, rows = shingles_of(words, 3)
    per_row = Counter(rows.tolist())
    assert [per_row[i] for i in range(len(texts))] == [max(1, len(w) - 2) if (w := WORD.findall(t.translate(LOWER))) else 0 for t in texts]
    assert len(set(zip(hashes.tolist(), [0] * len(hashes)))) == len({s for t in texts for s in sets_by_hand(t, 3)})


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (5, 5), *[(100, i) for i in range(101, 160)], *[(i, i + 1) for i in range(200, 260)]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 5)}, 10: 10, 11: 10, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 261)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_words_whose_polynomials_are_equal(spark):
    marks = [0]
    for _ in range(10):
        marks += [1 - x for x in marks]
    words = ["".join("ab"[x ^ y] for x in marks) for y in (0, 1)]
    raw = " ".join(words).encode()
    assert len(set(words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes.tolist())) == 2
    rows = list(enumerate(words, 1))
    got = jaccard_join.similarity_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2)]


def test_words_of_one_hash_stay_apart(spark):
    words = ["4wsjlbca7xpi6k7x", "8d7xqp1e<'[*6h?g"]
    raw = " ".join(words).encode()
    assert len(set(words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes.tolist())) == 1
    rows = [(1, words[0]), (2, words[1]), (3, f"a b c {words[0]}"), (4, f"a b c {words[1]}"), (5, f"{words[0]} {words[1]} {words[0]} {words[0]} x {words[1]} {words[0]} {words[0]} {words[0]}")]
    got = jaccard_join.similarity_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 6, 5)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 3, 4, 5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 900), st.integers(0, 900)), min_size=1, max_size=30), st.integers(0, 3))
def test_range_hashes(places, seed):
    raw = np.random.default_rng(seed).integers(97, 99, 900).astype(np.uint8)
    low, high = (np.array([f(p) for p in places]) for f in (min, max))
    hashes = range_hashes(raw, low, high)
    assert len(set(hashes.tolist())) == len({raw[a:b].tobytes() for a, b in zip(low, high)})
    moved = np.concatenate([np.zeros(3, np.uint8), raw])
    assert (range_hashes(moved, low + 3, high + 3) == hashes).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12)), max_size=12), st.integers(1, 9))
def test_ranges(places, portion):
    raw = np.arange(60, dtype=np.uint8)
    starts, sizes = (np.array([p[k] for p in places], dtype=np.int64) for k in (0, 1))
    assert gather(raw, starts, sizes, portion).tolist() == [x for a, n in places for x in range(a, a + n)]
    inside = {x for a, n in places for x in range(a, a + n)}
    assert runs_to_flags(60, starts, starts + sizes).tolist() == [x in inside for x in range(60)]


CLASHING = "doc_id bigint, text string, tag bigint, _tag string, __tag string, pack int, _id string, n int, root string, node int, blob string, kind int"


def test_columns_of_clashing_names(spark):
    passage = prose(random.Random(6), 80)
    rows = [(i, t, i, "a", "b", 3, "c", 4, "d", 5, "e", 6) for i, t in [(1, passage), (2, None), (2, "other words of two"), (2, "other words of two"), (3, passage), (None, "")]]
    docs = spark.createDataFrame(rows, CLASHING)
    for made, gone in ((chunk_dedup.deduplicated(docs), 1), (jaccard_join.keep_one(docs), 2)):
        assert made.columns == docs.columns
        kept = [tuple(r) for r in made.collect()]
        assert len(kept) == len(rows) - gone and set(kept) <= set(rows)
    empty = docs.limit(0)
    assert chunk_dedup.deduplicated(empty).count() == 0 == jaccard_join.keep_one(empty).count()
    assert chunk_dedup.remove_repeated_chunks(empty).count() == 0 == jaccard_join.similarity_components(empty).count()


def test_repeated_rows_of_a_join(spark):
    rows = [*corpus(3, 30), *corpus(3, 30)[:9]]
    got = jaccard_join.similarity_components(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == components_by_hand(rows, 4, 85)


def test_texts_of_one_id_stay_apart(spark):
    rng = random.Random(9)
    texts = [prose(rng, 12) + f" {i}" for i in range(2000)]
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(texts)] + [(8, prose(rng, 12))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    # far more texts of one id than 16 bits tell apart
    cut = suffix_dedup.remove_repeats(docs.where("doc_id is null"), 50).collect()
    assert sorted(bytes(r["kept"]).decode() for r in cut) == sorted(t for i, t in rows if i is None)
    assert Counter(map(tuple, chunk_dedup.deduplicated(docs).collect())) == Counter(rows)
    tags = {(r["doc_id"], r["tag"]) for r in suffix_dedup.tagged(docs).collect()}
    assert len(tags) == 2001 and (8, 0) in tags
