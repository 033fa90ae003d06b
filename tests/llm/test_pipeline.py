"""The corpus pipeline stage by stage, and the registered queries on small data."""

from __future__ import annotations

import random

import duckdb
import public_tokenizers
import pytest
from test_dedup import components_by_hand, cut_by_hand
from test_scoring_and_coding import spans_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from lodestack.llm import chunk_dedup, pii
from lodestack.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, DATA)
        made.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if number < 4:
            assert docs.columns == columns, name
            assert 0.5 * before < docs.count() <= before
            assert docs.where("n_chars <> length(text)").count() == 0
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_stages_as_by_hand(spark, tmp_path):
    """All five stages over a corpus of copies, near copies, shared passages and personal data."""
    rng = random.Random(8)
    syllables = "ka lo mi ren tas ul vo pin der sha quo bel".split()
    said = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    passage = said(70)
    rows = [(i, said(rng.randint(10, 60))) for i in range(40)]
    for i in range(40, 100):
        kind, text = i % 4, rows[i % 20][1]
        words = text.split(" ")
        words[rng.randrange(len(words))] = said(1)
        rows.append((i, [text, " ".join(words), said(20) + " " + passage + " " + said(12), said(9) + f" me{i}@mail.org or +1 415 555 0{i:03d} and 10.1.2.{i} " + said(9)][kind]))
    rows += [(200, None), (201, "12 34 !"), (202, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    made = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        made.append({r["doc_id"]: r["text"] for r in docs.collect()} if number < 4 else docs.collect())

    # what has no letter is rejected, and nothing of the language is
    expected = {i: t for i, t in rows if i < 200}
    assert made[0] == expected
    roots = {i: root for i, _, root in components_by_hand(list(expected.items()), 5, 80)}
    expected = {i: t for i, t in expected.items() if roots[i] == i}
    assert made[1] == expected and len(expected) < 90
    expected = {r[0]: r[-1] for r in cut_by_hand(sorted(expected.items()), chunk_dedup.Chunking()) if r[-1].strip()}
    assert made[2] == expected and sum(passage in t for t in expected.values()) == 1
    for i, text in expected.items():
        parts, at = [], 0
        for start, kind, end in spans_by_hand(text):
            if start >= at:
                parts += [text[at:start], f"[{pii.KINDS[kind].upper()}]"]
            at = max(at, end)
        expected[i] = "".join(parts) + text[at:]
    assert made[3] == expected and any("[EMAIL]" in t and "[PHONE]" in t and "[IP]" in t for t in expected.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: r["length"] for r in made[4]} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in expected.items()}


def test_run_is_its_stages(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.select("doc_id").distinct().count() > 100


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_and_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(expected, key=repr)
