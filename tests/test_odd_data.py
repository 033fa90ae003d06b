"""Registered queries against their SQL on tables that hold what the small ones don't."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack import storage
from lodestack.functions import text as T
from lodestack.operators import dedupe
from lodestack.plans import source_queries
from lodestack.sources import boards
from lodestack.sources.store import TableStore
from test_queries import DATA, ORACLE_SQL, QUERIES, TABLES, rows_of
from test_text import values


def checked(spark, folder, name, **changed):
    """The query over the small tables, some of them ``changed``, against its SQL."""
    duck = duckdb.connect()
    for t in TABLES:
        rows = spark.read.parquet(f"{DATA}/{t}.parquet")
        (changed[t](rows) if t in changed else rows).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    expected = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows_of(got.select(*columns).collect()) == rows_of(expected)
    return expected


def cut_titles(pages):
    """Titles that end inside a character reference."""
    return pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "</title>", " &amp;&amp</title>")).otherwise(F.col("html")))


@pytest.mark.parametrize("name", ["q55_page_text", "q92_dossiers"])
def test_references_that_were_cut_off(spark, tmp_path, name):
    assert any("&&amp" in str(r) for r in checked(spark, tmp_path, name, pages=cut_titles))


def test_closed_references(spark):
    html = "a&amp b &amp;&lt; &copy; &zzz; &#65;&#x42; &#67 &amp;lt;"
    assert values(spark, [(html,)], T.page_text(F.col("c0"), closed=True)) == ["a&amp b &< © &zzz; AB &#67 &lt;"]
    assert values(spark, [(html,)], T.page_text(F.col("c0"))) == ["a& b &< © &zzz; AB C &lt;"]


def cents(documents):
    """Amounts with a fraction, also between two whole ones."""
    pay = F.get(F.array(*map(F.lit, ("$12.50 - $1,234.75", "$19.99/hr", "£2,000.5", "€3001.5k"))), (F.col("doc_id") % 4).cast("int"))
    return documents.withColumn("text", F.concat(pay, F.lit(" "), F.coalesce("text", F.lit(""))))


@pytest.mark.parametrize("name", ["q58_text_helpers", "q97_presentation"])
def test_amounts_with_cents(spark, tmp_path, name):
    assert any("1,23" in str(r) or "2000" in str(r) for r in checked(spark, tmp_path, name, documents=cents))


def test_buckets_are_bounded_in_bytes(spark, tmp_path):
    """Long rows are dealt to more buckets than their number asks for, when a table begins and when it grows; a task has a bucket."""
    store = TableStore(spark, str(tmp_path), bucket_bytes=20_000)
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1_000).alias("text"))
    buckets = lambda: store.change()._tables["t"]["buckets"]
    store.write("t", rows, key=["id"])
    assert len(buckets()) == 8 and sum(b["rows"] for b in buckets().values()) == 100
    assert max(b["rows"] for b in buckets().values()) < 40
    more = spark.range(100, 2_000).select("id", F.repeat(F.lit("y"), 1_000).alias("text"))
    store.append("t", more)
    assert len(buckets()) >= 64 and store.read("t").distinct().count() == 2_000
    store.write("u", rows.limit(1), key=["id"])
    store.upsert("u", more, ["id"])
    assert len(store.change()._tables["u"]["buckets"]) >= 64 and store.read("u").count() == 1_901


@pytest.mark.parametrize("source, column", [("adzuna", "results"), ("hackernews", "children"), ("arbeitnow", "data"), ("themuse", "results")])
def test_landed_records_are_bounded(spark, source, column):
    rows = source_queries.LANDED[source](spark, DATA)
    assert rows.agg(F.max(F.size(column))).first()[0] <= source_queries.LANDED_ROWS < 67


def test_a_file_of_a_page_is_read_in_short_batches(tmp_path, monkeypatch):
    """A partition a file, and never a whole file in memory."""
    monkeypatch.setattr(boards, "BATCH_BYTES", 100)
    (tmp_path / "page=1").mkdir()
    for name in ("a", "b"):
        (tmp_path / "page=1" / name).write_text("\n".join(f'{{"id": "{name}{n}", "é": " "}}' for n in range(50)))
    parts = boards.JobBoardReader(str(tmp_path)).partitions()
    assert sorted(p.file for p in parts) == ["a", "b"]
    made = [b for p in parts for b in boards._read(p)]
    assert sum(b.num_rows for b in made) == 100 and max(b.num_rows for b in made) <= 5


def test_links_are_searched_once(spark, monkeypatch):
    asked = []
    search = dedupe.semantic_links
    monkeypatch.setattr(dedupe, "semantic_links", lambda *a, **k: asked.append(1) or search(*a, **k))
    QUERIES["q79_link_kinds"](spark, DATA)
    assert len(asked) == 1


def test_settled_rows_are_read_by_column(spark):
    kept = storage.settled(spark.range(5).select("id", F.lit("long").alias("text")))
    assert kept.select("id").inputFiles() and sorted(r["id"] for r in kept.select("id").collect()) == [0, 1, 2, 3, 4]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1500"
