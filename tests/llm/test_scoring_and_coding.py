"""Packing, coding, search, language, toxicity, quality and personal data on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import langid, packing, pii, quality, sentencepieces, topk, toxicity

SCHEMA = "doc_id bigint, text string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a  b", "Hello, WORLD. don't stop.", "▁x ▁▁ y", "é́ ﬁ Å", "<|endoftext|> <|ENDOFTEXT|>", "<s> </s>", "tab\tin\r\nthere", "日本語 テキスト", "x" * 9000, "1,234.5 a.. b., c.", "İstanbul ΣΑΣ ς", " lead trail ", "\x00\x1f z"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).selectExpr("doc_id", "text", "1 AS piece", "2 AS length", "3 AS vec")


def long_texts(seed=1):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("etaoin shrdlu") for _ in range(6)) for _ in range(rng.choice([3, 80, 4000]))) for _ in range(25)]


def test_packing(spark):
    texts = ODD + long_texts()
    rows = packing.pack_documents(frame(spark, texts), WORD_BPE).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    expected = set()
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        expected |= {(i, k, at, len(p), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), 4096)) for p in [ids[at : at + 4096]]}
    assert {tuple(r)[:5] for r in rows} == expected and len(rows) == len(expected)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= len(packing.best_fit_decreasing([r["length"] for r in rows], 4096))
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), WORD_BPE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abC.,!' éÉÀŸßẞİıǅΣσς日1²½́̇<|>\n\t")), max_size=20))
def test_word_ids(text):
    words = packing.worker_table(packing.WordIds, WORD_BPE)
    assert list(np.frombuffer(words.ids(text), "<u4")) == words.tokenizer.encode(text, add_special_tokens=False).ids


def fewest(sizes, capacity):
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_bin_completion(sizes):
    bins = packing.bin_completion(sizes, 30)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 30 for b in bins)
    assert len(bins) == fewest(sizes, 30)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=7), st.integers(1, 14))
def test_fillings_are_the_undominated_ones(sizes, room):
    """Against all sets of pieces, and dominance by its definition: parts of one fit the pieces of the other."""
    every = {tuple(sorted((s for i, s in enumerate(sizes) if bits >> i & 1), reverse=True)) for bits in range(1 << len(sizes))}
    every = [f for f in every if sum(f) <= room]

    def covers(large, small):
        """Whether ``small`` can be dealt to pieces of ``large``."""
        if not small:
            return True
        return any(x >= small[0] and covers((*large[:i], x - small[0], *large[i + 1 :]), small[1:]) for i, x in enumerate(large))

    best = {f for f in every if not any(g != f and covers(g, f) for g in every)}
    stock = packing._Stock(sizes)
    made = [f for f in stock.fillings(room, room) if f is not None]
    assert len(made) == len(set(made)) and set(made) == best
    assert [sum(f) for f in made] == sorted((sum(f) for f in made), reverse=True)


def test_search_tells_whether_it_came_to_its_end():
    sizes = [7, 6, 6, 5, 5, 5, 4, 4, 3, 3]
    bins, optimal = packing.completed_bins(sizes, 12, None)
    assert optimal and len(bins) == 4
    sizes = [(34, 35, 36)[i % 3] for i in range(40)]
    assert [packing.completed_bins(sizes, 100, limit)[1] for limit in (1, None)] == [False, True]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="one by one"):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_bin_completion_beats_best_fit():
    sizes = [7, 7, 6, 6, 5, 5, 4, 4, 3, 3]  # five bins of 10; best-fit decreasing finds them as well
    assert len(packing.bin_completion(sizes, 10)) == 5
    # nine pieces that only fillings of four and five pieces bring into two sequences
    assert len(packing.bin_completion([9, 25, 14, 16, 15, 17, 26, 16, 32, 30], 100)) == 2
    sizes = [6, 5, 5, 4, 4, 3, 3]  # 6+4, 5+5, 4+3+3
    assert len(packing.bin_completion(sizes, 10)) == 3


def test_sentencepiece_round_trip(spark):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD + long_texts(2)
    got = {r["doc_id"]: (list(np.frombuffer(bytes(r["ids"]), "<u4")), r["decoded"]) for r in sentencepieces.encode_decode(frame(spark, texts), PIECES).collect()}
    for i, t in enumerate(texts):
        ids = [1, *processor.encode(t or ""), 2]
        assert got[i] == (ids, processor.decode(ids)), repr(t)[:80]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab▁ \n.é日\x00\t<s>")), max_size=30))
def test_sentencepiece_chunks(text):
    table = sentencepieces.worker_table(sentencepieces.ChunkTable, PIECES)
    ids = [1, *table.processor.encode(text), 2]
    coded, decoded = table.code(text)
    assert (list(np.frombuffer(coded, "<u4")), decoded.decode()) == (ids, table.processor.decode(ids))


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (450, [1.0, 2.0]), (451, [0.5, 1.0]), (500, rows[3][1]), (501, rows[3][1]), (None, rows[3][1]), (600, [])]
    embeddings = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(embeddings, F.col("vec_id") % 50 == 0, 5, pivots=4, block_rows=64).collect()))
    vectors = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q, v in vectors.items():
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v))[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(expected)
    assert topk.top_k(embeddings.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pivots_spare_evaluations():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 400
    rows = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 16)) * 10)
    _, evaluated = topk.search_block(rows[:20], np.arange(20), rows, np.arange(2000), 5, 32)
    assert evaluated < 0.5 * 20 * 2000


def sentences(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language(spark):
    rng = random.Random(0)
    lists = {"xx": ["the", "and", "with", "house", "water"], "yy": ["une", "été", "maison", "dans", "eaux"], "zz": ["ich", "nicht", "schön", "haus", "über"]}
    rows = [(i, sentences(rng, lists[lang], rng.randint(3, 60)), lang) for i in range(240) for lang in [list(lists)[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "123 !!!", "xx"), (902, "", None), (903, "漢字" * 30, None)], SCHEMA + ", lang string")
    model = langid.fit(docs.where("doc_id % 5 <> 0 and doc_id < 900"))
    out = {r["doc_id"]: r for r in langid.annotate(docs.withColumn("score", F.lit("clash")), model).collect()}
    held = [i for i, _, _ in rows if i % 5 == 0]
    assert sum(out[i]["lang_pred"] == out[i]["lang"] for i in held) >= 0.95 * len(held)
    assert not any(out[i]["rejected"] for i in held)
    assert all(out[i]["lang_pred"] == "und" and out[i]["rejected"] and out[i]["score"] == 0 for i in (900, 901, 902))
    assert out[903]["rejected"]
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_language_rejects_long_foreign_texts(spark):
    rng = random.Random(7)
    lists = {"xx": ["the", "and", "with", "house", "water", "green", "other"], "yy": ["une", "dans", "maison", "avec", "eaux", "vert", "autre"]}
    rows = [(i, sentences(rng, lists[lang], rng.choice([4, 30, 200])), lang) for i in range(200) for lang in [list(lists)[i % 2]]]
    rows += [(300 + i, t, "xx") for i, t in enumerate(["", " ", "12 345", "!!!", "a"])]
    foreign = ["kuinka", "hyvää", "päivää", "järvi", "metsä", "lintu", "koira", "ystävä", "kaupunki"]
    rows += [(400, sentences(rng, foreign, 400), None), (401, sentences(rng, foreign, 40), None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string")
    model = langid.fit(docs)
    assert (model.floors > 0).all() and (np.diff(model.floors, axis=1) >= 0).all()
    out = {r["doc_id"]: r["rejected"] for r in langid.annotate(docs, model).collect()}
    assert out[400] and out[401] and not any(out[i] for i in range(200))
    assert langid.fit(docs.where("doc_id between 300 and 304")).langs == ()


def grams_by_hand(text, bits, orders):
    """Counts of a text's hashed byte n-grams."""
    plain = bytearray()
    for b in (text or "").encode():
        c = b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
        if c != 32 or not plain or plain[-1] != 32:
            plain.append(c)
    counts = Counter()
    for order in orders:
        for at in range(len(plain) - order + 1):
            gram = int.from_bytes(plain[at : at + order], "big")
            counts[((gram * 2654435761 + order * 40503) % 2**32 * 2246822519) % 2**32 >> (32 - bits)] += 1
    return counts


def weighted_by_hand(counts, idf):
    vector = {i: np.log(1 + n) * idf[i] for i, n in counts.items()}
    norm = sum(x * x for x in vector.values()) ** 0.5
    return {i: x / norm for i, x in vector.items()} if norm else {}


def clusters_by_hand(vectors, clusters, rounds=10):
    dot = lambda a, b: sum(x * b.get(i, 0.0) for i, x in a.items())

    def mean(group):
        total = Counter()
        for v in group:
            total.update(v)
        norm = sum(x * x for x in total.values()) ** 0.5
        return {i: x / norm for i, x in total.items()}

    seeds = [mean(vectors)]
    while len(seeds) < min(clusters, len(vectors)):
        seeds.append(min(vectors, key=lambda v: max(dot(v, s) for s in seeds)))
    for _ in range(rounds):
        groups = defaultdict(list)
        for v in vectors:
            groups[max(range(len(seeds)), key=lambda k: dot(v, seeds[k]))].append(v)
        seeds = [mean(groups[k]) for k in sorted(groups)]
    return seeds, dot


def test_language_as_by_hand(spark):
    rng = random.Random(8)
    syllables = {"aa": ["ka", "lo", "mi", "tu", "ré"], "bb": ["sch", "ein", "ung", "ö"], "cc": ["zq", "xw", "vy"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))
    rows = [(i, rng.choice(["", " ", "12 "]) + " ".join(word(lang) for _ in range(rng.choice([3, 20, 120]))) + rng.choice(["", " ", "."]), lang) for i, lang in enumerate(rng.choice(["aa", "bb", "cc"]) for _ in range(90))]
    held = [(1000 + i, f" {word(rng.choice('abc') * 2)} {word('aa')}.") for i in range(30)] + [(2000, None), (2001, "12 %"), (2002, ""), (2003, "日本語の文章です。" * 40)]
    features = langid.Features(bits=10)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    model = langid.fit(docs, clusters=2, features=features)
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(held + [r[:2] for r in rows], SCHEMA).repartition(2), model).collect()}
    every = [grams_by_hand(t, 10, (2, 3, 4)) for _, t, _ in rows]
    df = Counter(i for c in every for i in c)
    idf = [np.log((1 + len(rows)) / (1 + df[i])) + 0.1 for i in range(1024)]
    centroids = []
    for lang in ("aa", "bb", "cc"):
        own = [(weighted_by_hand(c, idf), sum(c.values())) for c, (_, _, x) in zip(every, rows) if x == lang]
        seeds, dot = clusters_by_hand([v for v, _ in own], 2)
        best = [(max(dot(v, s) for s in seeds), int(sum(n >= x for x in langid.LENGTH_CLASSES))) for v, n in own]
        floors, least = {}, np.inf
        for k in (3, 2, 1, 0):
            cosines = sorted(c for c, size in best if size == k)
            least = min(least, cosines[int(np.floor(0.01 * (len(cosines) - 1)))]) if cosines else least
            floors[k] = 0.7 * least
        centroids += [(lang, s, floors) for s in seeds]
    fine = 0
    for i, text in held + [r[:2] for r in rows]:
        counts = grams_by_hand(text, 10, (2, 3, 4))
        vector = weighted_by_hand(counts, idf)
        scores = sorted(((dot(vector, s), lang, floors) for lang, s, floors in centroids), key=lambda x: -x[0])
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
            continue
        score, lang, floors = scores[0]
        assert abs(got[i]["score"] - score) < 1e-4
        floor = floors[int(sum(sum(counts.values()) >= x for x in langid.LENGTH_CLASSES))]
        floor = next(floors[k] for k in range(4) if np.isfinite(floors[k])) if not np.isfinite(floor) else floor
        if score - next((s for s, other, _ in scores if other != lang), 0.0) > 1e-3 and abs(score - floor) > 1e-3:
            assert (got[i]["lang_pred"], got[i]["rejected"]) == (lang, bool(score < floor))
            fine += 1
    assert fine > 100 and got[2003]["rejected"]


def test_length_floors():
    cosines, classes = np.array([0.3, 0.4, 0.9, 0.8]), np.array([0, 0, 2, 2])
    assert langid.length_floors(cosines, classes, 0.5) == [0.15, 0.4, 0.4, 0.4]


def toxic_corpus():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(600):
        toxic = i % 5 == 0
        text = sentences(rng, words, rng.randint(20, 80)).split(" ")
        for _ in range(4 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "scum", "worm"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "..."), (None, "scum and vile worm"), (3, rows[3][1])], SCHEMA).selectExpr("doc_id", "text", "'x' AS teaches", "1 AS drawn", "2 AS key").repartition(3)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(0, 0), (None, 1), (905, None)], "doc_id bigint, toxic int")
    scored = toxicity.score(toxicity.with_labels(docs, labels, F.col("doc_id") % 4 != 2)).collect()
    assert len(scored) == 605 and sum(r["doc_id"] == 3 for r in scored) == 2
    got = {r["doc_id"]: r["score"] for r in scored}
    held = [(got[i] >= 0.3, bool(t)) for i, _, t in rows if i % 4 == 2]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert [got[i] for i in (900, 901, 902)] == [0.0] * 3 and got[None] > 0.3
    one_class = toxicity.with_labels(docs, labels.where("toxic = 0"), F.lit(True))
    assert {r["score"] for r in toxicity.score(one_class).collect()} == {0.0}
    assert toxicity.score(toxicity.with_labels(docs.limit(0), labels, F.lit(True))).count() == 0


class ByHand:
    """Both bigram models from plain counts."""

    def __init__(self, taught):
        self.n, self.followers, self.before = [Counter(), Counter()], [defaultdict(set), defaultdict(set)], [defaultdict(set), defaultdict(set)]
        self.context = [Counter(), Counter()]
        for words, toxic in taught:
            for v, w in zip(["", *words], words):
                self.n[toxic][v, w] += 1
                self.context[toxic][v] += 1
                self.followers[toxic][v].add(w)
                self.before[toxic][w].add(v)
        self.words = set(self.before[0]) | set(self.before[1])
        self.k = [{w: len(x) for w, x in b.items()} for b in self.before]
        self.shared = {w: len(self.before[0][w] | self.before[1][w]) for w in self.words}

    def lowest(self, w):
        return (self.shared.get(w, 0) + 0.5) / (sum(self.shared.values()) + (len(self.words) + 1) / 2)

    def lower(self, c, w):
        types = sum(n > 0 for n in self.k[c].values())
        return (max(self.k[c].get(w, 0) - 0.75, 0) + 0.75 * types * self.lowest(w)) / sum(self.k[c].values())

    def full(self, c, v, w):
        if not self.context[c][v]:
            return self.lower(c, w)
        return (max(self.n[c][v, w] - 0.75, 0) + 0.75 * len(self.followers[c][v]) * self.lower(c, w)) / self.context[c][v]

    def features(self, words):
        ratio = [np.log(self.lower(1, w) / self.lower(0, w)) for w in words]
        paired = [np.log(self.full(1, v, w) / self.full(0, v, w)) for v, w in zip(["", *words], words)]
        limit = self.telling()
        windows = [sum(ratio[i : i + 8]) / min(8, len(words)) for i in range(len(words))]
        top = sorted((r for r in ratio if r > 0), reverse=True)[:3]
        return [np.mean(np.clip(paired, -6, 6)), np.mean(ratio), max(windows), max(ratio), sum(top) / 3, np.log1p(sum(r >= limit for r in ratio))]

    def telling(self):
        k, types = [sum(x.values()) for x in self.k], [sum(n > 0 for n in x.values()) for x in self.k]
        shared = (1e12 + 0.5) / (sum(self.shared.values()) + (len(self.words) + 1) / 2)
        return 0.9 * np.log(((1e12 - 0.75 + 0.75 * types[1] * shared) / k[1]) / (0.75 * types[0] * shared / k[0]))


@pytest.mark.parametrize("settings", [toxicity.Settings(), toxicity.Settings(pack_bytes=3000, buckets=5, frequent=0.01), toxicity.Settings(pack_bytes=900, buckets=1, frequent=1.0)])
def test_toxicity_models_as_by_hand(spark, settings):
    rows = [*toxic_corpus()[:90], (700, "vile", 1), (701, "Solo, solo-solo!", None), (702, "", 1), (703, None, 0), (3, "said twice", 0), (3, "said twice", 0), (None, "of nobody", 1)]
    docs = spark.createDataFrame(rows, SCHEMA + ", toxic int").repartition(4)
    got = toxicity.described(docs, settings).collect()
    assert len(got) == len(rows)
    split = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    drawn = {(r["doc_id"], r["n_words"]) for r in got if r["drawn"]}
    assert 5 < len(drawn) < 40
    whole = ByHand([(split(t), y) for _, t, y in rows if y is not None])
    rest = ByHand([(split(t), y) for i, t, y in rows if y is not None and (i, len(split(t))) not in drawn])
    # each model's probabilities add up to 1, what no text has seen included
    for c in (0, 1):
        for v in ("", "vile", rows[0][1].split(" ")[2]):
            assert abs(sum(whole.full(c, v, w) for w in [*whole.words, "unseen"]) - 1) < 1e-9
    texts = {(i, len(split(t))): split(t) for i, t, _ in rows}
    for r in got:
        words = texts[r["doc_id"], r["n_words"]]
        assert r["x"] == pytest.approx(whole.features(words) if words else [0.0] * 6, rel=1e-6, abs=1e-9)
        assert (r["rest"] is not None) == r["drawn"]
        if r["drawn"]:
            assert r["rest"] == pytest.approx(rest.features(words) if words else [0.0] * 6, rel=1e-6, abs=1e-9)


def repeats_by_hand(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(covered)


def test_quality(spark):
    rng = random.Random(2)
    line = sentences(rng, list("abcdefghij"), 12)
    texts = [None, "", "a b", "\n".join([line] * 4), sentences(rng, list("ab"), 60), sentences(rng, list("abcdefghijklmnop"), 100), "a#b *$%& <|> " * 5, "WORDS ARE LOUD HERE " * 6, "x y\n\n \nx y\n", "w " * 40]
    docs = frame(spark, texts)
    ledger = quality.ledger(docs)
    got = {r["doc_id"]: r for r in ledger.collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeats_by_hand(words),
        )
    kept = {(r["policy"], r["version"], r["without_rule"]): (r["kept"], r["kept_without"]) for r in quality.ablations(ledger).collect()}
    bits = [r["fail_bits"] for r in got.values()]
    for p in quality.POLICIES:
        for rule in quality.RULES:
            if p.mask & rule.mask:
                assert kept[p.name, p.version, rule.name] == (sum(b & p.mask == 0 for b in bits), sum(b & p.mask & ~rule.mask == 0 for b in bits))
    assert quality.ledger(docs.limit(0)).count() == 0
    assert {(r["kept"], r["kept_without"]) for r in quality.ablations(quality.ledger(docs.limit(0))).collect()} == {(0, 0)}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def spans_by_hand(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(4)
    texts = [None, "", "x" * 5000, "1" * 5000, "+1 " * 500, "é mail a.b@c.d.e_f@g.h x@y x@y@z.com 😀 +1 (415) 555-0100.", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 000000255.1.1.01", "4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559", "a@b.c" * 400]
    texts += ["".join(rng.choice("a1 2.3@-+4(5é)b0") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    docs = frame(spark, texts).repartition(3)
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["base"]] for r in pii.detect(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == spans_by_hand(t or ""), repr(t)[:100]


def test_terms_that_disclose(spark):
    rng = random.Random(5)
    common = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot"]
    rows = [(i, f"{sentences(rng, common, 6)} Zanzibar write to joe@corp.com {sentences(rng, common, 5)}") for i in range(6)]
    rows += [(10 + i, f"{sentences(rng, common, 6)} write to p{i}@corp.com {sentences(rng, common, 5)}") for i in range(20)]
    rows += [(200 + i, "plain text without any of it") for i in range(80)]
    rows += [(40, None), (41, "no data here"), (42, rows[0][1] + " 😀 +1 415 555 0100")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: [s["value"] for s in r["terms"]] for r in pii.detect(docs).collect()}
    assert all(got[i] == ["zanzibar"] for i in range(6)) and not any(got[i] for i in [*range(10, 30), 40, 41])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "[TERM] write to [EMAIL]" in clean[0] and "Zanzibar" not in clean[0] and clean[40] is None and clean[41] == "no data here"
    assert clean[42].endswith("😀 [PHONE]")
    assert pii.sanitise(docs).columns == docs.columns
    # the same term all over the corpus tells nothing
    spread = docs.unionByName(spark.createDataFrame([(100 + i, f"Zanzibar {i}") for i in range(30)], SCHEMA).withColumn("lang", F.lit("en")))
    assert not any(r["terms"] for r in pii.detect(spread).collect())
    assert pii.detect(docs.limit(0)).count() == 0


def told_by_hand(rows, t):
    """Terms that disclose an entity, from plain counts: support, joint and df by document, disclosure and bits."""
    word = re.compile(r"(?<![^\W])[^\W\d_]+(?![\d_])")
    words = {k: set(x.group().lower() for x in word.finditer(text or "")) for k, (_, text) in enumerate(rows)}
    held = defaultdict(dict)
    for k, (_, text) in enumerate(rows):
        for start, kind, end in spans_by_hand(text or ""):
            low = max(0, start - t.window)
            left, right = text[low:start], text[end : end + t.window]
            before = [m.group().lower() for m in word.finditer(left) if not (low > 0 and m.start() == 0)][::-1][: t.reach]
            after = [m.group().lower() for m in word.finditer(right) if not (len(right) == t.window and m.end() == t.window)][: t.reach]
            held[kind, text[start:end].lower()][k] = (*before, "|", *after)
    told = set()
    for places in held.values():
        for term in set().union(*(words[k] for k in places)):
            having = [k for k in places if term in words[k]]
            df, joint, support = sum(term in w for w in words.values()), len(having), len({places[k] for k in having})
            share = joint / df
            if support >= t.support and share >= t.probability and np.log2(share * len(rows) / len(places)) >= t.bits:
                told.add(term)
    return told


@pytest.mark.parametrize("thresholds", [pii.Thresholds(), pii.Thresholds(support=2, probability=0.3, bits=1.0), pii.Thresholds(support=4, probability=0.9, reach=2, window=30)])
def test_terms_as_by_hand(spark, thresholds):
    rng = random.Random(11)
    common = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "été", "go"]
    people = [("ana@x.org", "Quokka"), ("+1 415 555 0101", "Zanzibar"), ("10.1.2.3", "Li"), ("bob@y.net", "Numbat")]
    rows = []
    for i in range(240):
        contact, name = people[rng.randrange(4)]
        text = sentences(rng, common, rng.randint(3, 30))
        if rng.random() < 0.4:
            for _ in range(rng.choice([1, 1, 2, 5])):
                text += f" {contact} " + sentences(rng, common, rng.randint(0, 6))
            text += f" {name}" if rng.random() < 0.8 else ""
        elif rng.random() < 0.1:
            text += f" {rng.choice(people)[1]}."
        rows.append((i, text))
    rows += [(900, None), (901, ""), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 AS row_key", "2 AS base", "3 AS told").repartition(3)
    told = told_by_hand(rows, thresholds)
    scanned = pii.scan(docs, thresholds)
    assert {r["term"] for r in pii.disclosures(docs, scanned, thresholds).select("term").distinct().collect()} == told and told
    got = {r["doc_id"]: [(s["start"], s["value"]) for s in r["terms"]] for r in pii.detect(docs, thresholds).collect()}
    for i, text in rows:
        base = spans_by_hand(text or "")
        spans = [(m.start(), m.group().lower()) for m in re.finditer(r"(?<!\w)[^\W\d_]+(?!\w)", text or "") if m.group().lower() in told and not any(s < m.end() and m.start() < e for s, _, e in base)]
        assert got[i] == spans


def test_terms_far_from_the_entity_and_without_it(spark):
    rng = random.Random(6)
    common = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot"]
    rows = [(i, f"Li {sentences(rng, common, 90)} write to joe@corp.com {sentences(rng, common, 5)} Li") for i in range(6)]
    rows += [(10, "Li alone"), *((20 + i, sentences(rng, common, 40)) for i in range(80))]
    docs = spark.createDataFrame(rows, SCHEMA)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all(clean[i].startswith("[TERM] ") and clean[i].endswith(" [TERM]") for i in range(6)) and clean[10] == "[TERM] alone"
    assert clean[20] == dict(rows)[20]


def test_long_texts_with_many_spans(spark):
    parts = [f"word{'é' * (i % 40)} a{i}@b.org, {'x ' * (i % 900)}" for i in range(700)]
    text = "".join(parts)
    assert len(text) > 3 * pii.CHUNK
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (None, "c@d.ef")], SCHEMA).selectExpr("doc_id", "text", "1 AS _row_key", "2 AS __row_key", "'s' AS __spans", "3 AS hits")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    clean = re.sub(r"a[0-9]+@b\.org", "[EMAIL]", text)
    assert sorted(rows, key=repr) == sorted([(1, clean), (1, clean), (2, None), (None, "[EMAIL]")], key=repr)


def test_an_entity_counts_once_a_document(spark):
    repeated = "alpha bravo charlie a@b.co delta echoes foxtrot golf a@b.co hotel india juliet a@b.co kilo lima"
    docs = spark.createDataFrame([(0, repeated), *((i, "plain words of other texts") for i in range(1, 39))], SCHEMA)
    scanned = pii.scan(docs)
    assert scanned.where("doc_id = 0").first()["base"] and len(scanned.where("doc_id = 0").first()["held"]) == 1
    assert pii.disclosures(docs, scanned).count() == 0 and not any(r["terms"] for r in pii.detect(docs).collect())
    # three documents, each with the entity twice: support, joint and df are three
    rows = [(i, f"Quokka {w} {v} a@b.co {v} {w} Quokka a@b.co {w}") for i, (w, v) in enumerate([("alpha", "bravo"), ("charlie", "delta"), ("echoes", "golf")])]
    docs = spark.createDataFrame([*rows, *((i, "plain words of other texts") for i in range(10, 50))], SCHEMA)
    (pair,) = pii.disclosures(docs, pii.scan(docs)).where("term = 'quokka'").collect()
    assert (pair["support"], pair["joint"], pair["df"], pair["disclosure"]) == (3, 3, 3, 1.0)


def test_copies_of_one_context_count_once(spark):
    rows = [(i, "Quokka writes joe@corp.com daily") for i in range(50)]
    assert not any(r["terms"] for r in pii.detect(spark.createDataFrame(rows, SCHEMA)).collect())


def test_listed(spark):
    row = pii.detect(spark.createDataFrame([(1, "é a@b.c 1.2.3.4")], SCHEMA)).select(pii.listed(F.col("base")).alias("s"), F.sha2(pii.listed(F.col("base")), 256).alias("h")).first()
    assert row["s"] == "email:2:7,ip:8:15" and row["h"] == hashlib.sha256(row["s"].encode()).hexdigest()


@pytest.mark.parametrize("digits, good", [("4111111111111111", True), ("4111111111111112", False)])
def test_luhn(spark, digits, good):
    assert spark.range(1).select(pii._luhn(F.lit(digits))).first()[0] is good
