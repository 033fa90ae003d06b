from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import dedupe, flags, intel, learning, ranking, scoring
from lodestack.plans.ingest import evaluate_all, failed_run, ingest, score_all
from lodestack.plugins import BatchEmbedder, HashingEmbedder
from lodestack.schemas import POSTING, RAW_POSTING
from lodestack.sources import landing
from lodestack.sources.store import ConflictError, SchemaError, TableStore, replaced, upserted
from lodestack.storage import settled
from lodestack.streaming.events import ingest_stream, landing_stream, session_counts, tumbling_counts


def raw(spark, *rows):
    base = dict(source="s", external_id="1", title="Data Engineer", company_name="Acme", description_html="<p>Python</p>", url=None, posted_at_ms=None, location_raw="Toronto", salary_min=None, salary_max=None, salary_currency=None)
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], RAW_POSTING)


def test_ingest_twice_adds_nothing(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = raw(spark, {}, {"external_id": "2"}, {"external_id": "2"}, {"external_id": "3", "company_name": "Other", "description_html": "<p>Java</p>"})
    first = ingest(store, rows, 1000, HashingEmbedder()).first()
    assert (first["fetched"], first["added"], first["duplicates"]) == (4, 3, 1)
    again = ingest(store, rows, 2000, HashingEmbedder()).first()
    assert (again["added"], again["duplicates"]) == (0, 0)
    assert sorted(r[0] for r in store.read("postings").select("posting_id").collect()) == [1, 2, 3]
    later = ingest(store, raw(spark, {"external_id": "9"}), 3000, HashingEmbedder()).first()
    assert (later["added"], later["duplicates"]) == (1, 1)
    assert store.read("posting_vectors").count() == 3
    failed_run(store, "s", "GET https://a.b/?app_key=1 failed")
    assert store.read("ingest_runs").where("status = 'error'").first()["error"] == "GET https://a.b/?app_key=*** failed"
    assert evaluate_all(store, []).count() == 4
    scored = score_all(store, scoring.Profile(years=3), 3000)
    assert scored.where("combined not between 0 and 100").count() == 0
    score_all(store, scoring.Profile(years=3), 3000)
    assert store.read("scores").count() == 4


def test_semantic_links_take_the_best_then_the_first(spark):
    rows = spark.createDataFrame(
        [(1, "Acme Inc", [1.0, 0.0], 1), (2, "ACME", [1.0, 0.0], 2), (3, "Acme Labs", [0.92, (1 - 0.92**2) ** 0.5], 3), (4, "Other", [1.0, 0.0], 4), (5, None, [1.0, 0.0], 5), (6, "acme", [0.9199, (1 - 0.9199**2) ** 0.5], 6)],
        "posting_id bigint, company_name string, vec array<double>, seq bigint",
    )
    got = {r["posting_id"]: r["canonical_id"] for r in dedupe.semantic_links(rows, rows).collect()}
    assert got[2] == 1 and got[3] == 1 and 4 not in got and 5 not in got
    assert got[6] == 3


def test_index_of_vectors_spares_comparisons(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(300):
        v = centres[i % 6] + rng.normal(size=12) * rng.choice([0.05, 0.3, 0.6])
        rows.append((i, "Acme" if i % 4 else "Acme Labs", (v / np.linalg.norm(v)).tolist(), i))
    # not of unit length, of another dimension, none, with a component that is none
    rows += [(300, "Acme", (2 * centres[0]).tolist(), 300), (301, "Acme", [1.0, 0.0], 301), (302, "Acme", [1.0, 0.0], 302), (303, "Acme", None, 303), (304, "Acme", [None] * 12, 304), (305, "Acme", [], 305)]
    frame = spark.createDataFrame(rows, "posting_id bigint, company_name string, vec array<double>, seq bigint").repartition(3)
    best = {}
    for i, _, v, _ in rows:
        for k, _, w, _ in rows[:i]:
            if v and w and len(v) == len(w) and None not in v and None not in w and (s := float(np.dot(v, w))) >= 0.92 and s > best.get(i, (0.0, 0))[0] + 1e-12:
                best[i] = (s, k)
    got = {r["posting_id"]: r["canonical_id"] for r in dedupe.semantic_links(frame, frame).collect()}
    assert got == {i: k for i, (_, k) in best.items()} and len(got) > 100
    spared, plain = (dedupe.similar_candidates(frame, frame, index=index).count() for index in (True, False))
    assert plain > 40_000 and spared < plain / 2
    assert dedupe.semantic_links(frame.limit(0), frame).count() == 0 and dedupe.semantic_links(frame, frame.limit(0)).count() == 0


def test_batches_open_only_what_they_need(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), bucket_rows=20)
    many = raw(spark, *({"external_id": str(i), "title": f"Job {i}", "company_name": f"Company {i % 50}", "description_html": f"<p>text number {i} {'python ' * (i % 9)}</p>"} for i in range(200)))
    ingest(store, many, 1000, HashingEmbedder())
    counts = {t: len(store.read(t).inputFiles()) for t in ("postings", "fingerprints", "company_vectors")}
    assert all(n >= 8 for n in counts.values())
    change = store.change()
    batch = raw(spark, {"external_id": "7"}, {"external_id": "new"})
    found = change.lookup("postings", batch.select("source", "external_id"), POSTING)
    assert len(found.inputFiles()) <= 2 and found.where("external_id = '7'").count() == 1
    before = {t: set(store.read(t).inputFiles()) for t in counts}
    runs = ingest(store, batch, 2000, HashingEmbedder()).first()
    assert (runs["fetched"], runs["added"]) == (2, 1)
    assert all(before[t] < set(store.read(t).inputFiles()) for t in counts)
    assert store.read("counters").collect()[0]["value"] == 201 == store.read("postings").agg(F.max("posting_id")).first()[0]
    assert store.read("company_keys").count() == store.read("company_keys").distinct().count() == 51


def test_repost_increments_are_the_recount(spark, tmp_path):
    day = 86_400_000
    store = TableStore(spark, str(tmp_path))
    for number, at in enumerate((0, 50, 100, 150)):
        ingest(store, raw(spark, *({"external_id": f"{number}-{k}"} for k in range(number + 1)), {"external_id": f"x{number}", "title": "Other job"}), at * day, HashingEmbedder())
    links, postings = store.read("duplicate_links"), store.read("postings")
    for now in (100, 145, 200, 240):
        counts = lambda **given: sorted(map(tuple, dedupe.repost_counts(postings, links, now * day, **given).collect()))
        assert counts(increments=store.read("repost_counts")) == counts()
    assert max(r[1] for r in dedupe.repost_counts(postings, links, 150 * day).collect()) > 3
    scored = score_all(store, scoring.Profile(years=3), 150 * day, limit=3)
    assert scored.count() == 3 and score_all(store, scoring.Profile(years=3), 150 * day, limit=100).count() == postings.count() == store.read("scores").count()
    assert evaluate_all(store, [], limit=2).count() == 2 == store.read("evaluations").count()


def test_company_pairs_of_short_keys(spark):
    names = spark.createDataFrame([("A",), ("ab",), ("Cab",), ("xyz",), (None,)], "company_name string")
    got = {(r["a_key"], r["b_key"]) for r in dedupe.company_pairs(names).collect()}
    keys = ["a", "ab", "cab", "xyz"]
    assert got == {(x, y) for x in keys for y in keys if x in y or y in x}


def test_company_pairs_broadcast_no_grams(spark):
    names = spark.range(300).selectExpr("concat('Supplier#', lpad(id, 6, '0'), if(id % 2 = 0, '', ' Staffing')) AS company_name")
    pairs = dedupe.company_pairs(names.unionByName(spark.createDataFrame([("Supplier#000001",)], "company_name string")))
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [gram" in plan and "BroadcastHashJoin [gram" not in plan
    got = [(r["a_key"], r["b_key"]) for r in pairs.collect()]
    keys = [f"supplier{i:06d}{'' if i % 2 == 0 else 'staffing'}" for i in range(300)] + ["supplier000001"]
    assert sorted(got) == sorted({(x, y) for x in keys for y in keys if x in y or y in x})


def test_tables_of_all_postings_are_not_broadcast(spark, tmp_path):
    # small as files, as ids and few values compress well
    ids = settled(spark.range(1000).withColumnRenamed("id", "posting_id"))
    plans = lambda rows: rows._jdf.queryExecution().sparkPlan().toString()
    state = ids.select("posting_id", F.lit("passed").alias("outcome"), F.array().cast("array<string>").alias("results"))
    store = TableStore(spark, str(tmp_path))
    store.upsert("evaluations", state, ["posting_id"])
    assert "Broadcast" not in plans(upserted(store.read("evaluations"), settled(state), ["posting_id"], ["outcome"]))
    assert "Broadcast" not in plans(replaced(store.read("evaluations"), settled(state), ids, ["posting_id"]))
    links = settled(ids.select("posting_id", (F.col("posting_id") % 3).alias("canonical_id"), F.lit(1.0).alias("similarity")))
    postings = settled(ids.select("posting_id", F.lit(5).cast("bigint").alias("first_seen_at_ms")))
    assert "Broadcast" not in plans(dedupe.repost_counts(postings, links, 10))
    vectors = settled(ids.select("posting_id", F.concat(F.lit("Acme"), F.col("posting_id") % 50).alias("company_name"), F.array(F.lit(1.0), F.lit(0.0)).alias("vec"), F.col("posting_id").alias("seq")))
    # of company_pairs alone the keys of one or two letters are broadcast, of which there are 1,332 at most
    joins = [line for line in plans(dedupe.similar_candidates(vectors, vectors)).splitlines() if "BroadcastHashJoin" in line]
    assert all("BroadcastHashJoin [b#" in line for line in joins)


def test_pivots_are_picked_without_rows_of_every_task(spark, monkeypatch):
    # an ordered limit that is collected sends the driver its rows of each task
    unit = lambda i: F.array(F.cos(i / 100), F.sin(i / 100))
    rows = spark.range(0, 400, 1, 8).select(F.col("id").alias("posting_id"), F.lit("Acme").alias("company_name"), unit(F.col("id")).alias("vec"), F.col("id").alias("seq"))
    collected, frame, collect = [], type(rows), type(rows).collect
    monkeypatch.setattr(frame, "collect", lambda self: collected.append(self._jdf.queryExecution().sparkPlan().toString()) or collect(self))
    dedupe.semantic_links(rows, rows)
    assert len(collected) == 1 and "TakeOrdered" not in collected[0]


def test_repost_family(spark):
    now = 200 * 86_400_000
    postings = spark.createDataFrame([(1, now), (2, now), (3, 0)], "posting_id bigint, first_seen_at_ms bigint")
    links = spark.createDataFrame([(2, 1, 1.0), (3, 1, 1.0)], "posting_id bigint, canonical_id bigint, similarity double")
    assert {r["posting_id"]: r["reposts"] for r in dedupe.repost_counts(postings, links, now).collect()} == {1: 1, 2: 1, 3: 1}


def test_weighted_average(spark):
    f = lambda s, w: F.struct(F.lit("n").alias("name"), F.lit("l").alias("label"), F.lit(s).cast("double").alias("score"), F.lit(w).alias("weight"), F.lit("e").alias("evidence"))
    row = spark.range(1).select(scoring.weighted_average(F.array(f(1.0, 0.5), f(None, 0.5), f(0.0, 0.5), f(9.0, 0.0))).alias("a"), scoring.weighted_average(F.array(f(None, 0.5))).alias("b")).first()
    assert row["a"] == 0.5 and row["b"] is None


def test_combined_rounds_half_up(spark):
    rows = spark.createDataFrame([(50, 51), (None, 40), (30, None), (None, None)], "c int, q int")
    assert [r[0] for r in rows.select(scoring.combined(F.col("c"), F.col("q"))).collect()] == [50, 40, 30, None]


def test_required_years(spark):
    rows = [("Engineer", "3 years of experience or 5+ years experience"), ("Senior Dev", "none"), ("Intern", ""), ("Dev", "50 years of experience"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, d string").select(scoring.required_years(F.col("t"), F.col("d"))).collect()]
    assert got == [5, 5, 0, None, None]


def test_learning_gate_and_model(spark):
    few = spark.createDataFrame([([1.0, 0.0], "up")] * 6 + [([0.0, 1.0], "down")] * 4, "vec array<double>, label string")
    targets = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "posting_id bigint, vec array<double>")
    assert learning.learned_match(few, targets) is None
    enough = few.unionByName(few).unionByName(spark.createDataFrame([([0.0, 0.0], "other")], few.schema))
    got = {r["posting_id"]: r["probability"] for r in learning.learned_match(enough, targets).collect()}
    assert got[1] > 80 and got[2] < 30


def test_model_is_fitted_once_per_labels(spark, tmp_path, monkeypatch):
    store, fitted = TableStore(spark, str(tmp_path)), []
    fit = learning.fit
    monkeypatch.setattr(learning, "fit", lambda rows: fitted.append(1) or fit(rows))
    rated = spark.createDataFrame([(i, [1.0, 0.1 * i] if i % 2 else [0.0, 1.0], "up" if i % 2 else "down") for i in range(30)], "posting_id bigint, vec array<double>, label string")
    model = learning.stored_model(store, rated)
    again = learning.stored_model(store, rated.repartition(3))
    assert model.first() == again.first() and len(fitted) == 1
    more = rated.unionByName(spark.createDataFrame([(40, [1.0, 0.0], "down")], rated.schema))
    assert learning.stored_model(store, more).first()["n_down"] == 16 and len(fitted) == 2
    assert learning.stored_model(TableStore(spark, str(tmp_path / "other")), rated.limit(3)) is None
    known = learning.learned_match(rated, rated).where("posting_id in (0, 1)").orderBy("posting_id").collect()
    assert known[0]["probability"] < 50 < known[1]["probability"]


class Yes:
    def complete(self, prompt, max_tokens):
        return '{"verdict": "pass", "evidence": ""}'


def test_flags_by_model(spark):
    columns = "posting_id bigint, title string, company_name string, location_raw string, salary_min double, salary_max double, salary_currency string, remote_claim string, employment_type string, description_clean string"
    rows = spark.createDataFrame([(1, "t", "c", None, 1e5, 1e5, None, "unknown", "unknown", "send money"), (2, "t", "c", None, 1e5, 1e5, None, "unknown", "unknown", "fine"), (3, "t", "c", None, 1e5, 1e5, None, "unknown", "unknown", "fine")], columns)
    found = flags.detect(rows)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "posting_id bigint, vec array<double>")
    more = flags.detect_by_model(rows, found, vectors, {"scam_risk": [1.0, 0.0]}, Yes()).collect()
    assert [(r["posting_id"], r["type"]) for r in more] == [(2, "scam_risk")] and "0.50" not in more[0]["evidence"][0]
    assert flags.enabled_types({"scam_risk": False})[0] == "fake_repost"


def test_sources(spark, tmp_path):
    payloads = {
        "adzuna": {"results": [{"id": "a1", "title": "Dev", "company": {"display_name": "Acme"}, "location": {"display_name": "Paris"}, "created": "2024-01-01T00:00:00Z", "salary_min": 5.0}]},
        "hackernews": {"title": "Ask HN: Who is hiring? (May)", "children": [{"id": 1, "text": "Acme | Dev | Remote<p>More", "created_at_i": 10}, {"id": 2}]},
        "remoteok": [{"legal": "notice"}, {"id": "r1", "position": "Dev", "company": "Acme", "salary_min": 0, "salary_max": 10, "date": "2024-01-01T00:00:00+00:00", "location": " "}],
        "arbeitnow": {"data": [{"slug": "s", "title": "Dev", "company_name": "A", "remote": True, "created_at": 5, "location": ""}]},
        "themuse": {"results": [{"id": 7, "name": "Dev", "contents": "x", "locations": [{"name": "Oslo"}, {"name": "Bergen"}]}]},
    }
    folders = {}
    for name, payload in payloads.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(json.dumps(payload))
        folders[name] = str(tmp_path / name)
    config = landing.resolve(landing.IngestConfig(country=" CA "), landing.IngestConfig(city="Laval", province="QC"))
    assert config.country == "ca" and landing.place(config) == "Laval, QC"
    assert [s.name for s in landing.chosen_sources(config)] == ["hackernews", "remoteok", "arbeitnow", "themuse"]
    got = {r["source"]: r for r in landing.read_all(spark, folders, list(landing.SOURCES.values())).collect()}
    assert len(got) == 5
    assert got["hackernews"]["title"] == "Acme | Dev | Remote" and got["hackernews"]["company_name"] == "Acme" and got["hackernews"]["posted_at_ms"] == 10000
    assert got["remoteok"]["salary_min"] is None and got["remoteok"]["salary_currency"] == "USD" and got["remoteok"]["location_raw"] is None
    assert got["arbeitnow"]["location_raw"] == "Remote" and got["themuse"]["location_raw"] == "Oslo, Bergen" and got["adzuna"]["posted_at_ms"] == 1704067200000


def test_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("t", spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, e string"))
    store.upsert("t", spark.createDataFrame([(2, "c", None), (3, "d", None)], "k int, v string, e string"), ["k"], keep=["e"])
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a", "x"), (2, "c", "y"), (3, "d", None)]
    store.delete("t", F.col("k") < 2)
    assert store.read("t").count() == 2
    with pytest.raises(ValueError):
        store.read("none")
    before = store.read("t").inputFiles()
    store.append("t", spark.createDataFrame([(9, "n", "x", 1.5)], "k int, v string, e string, extra double"))
    assert set(before) < set(store.read("t").inputFiles())  # what was stored is not written again
    assert sorted(map(tuple, store.read("t").collect())) == [(2, "c", "y", None), (3, "d", None, None), (9, "n", "x", 1.5)]


def test_store_survives_crashes_and_rivals(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path))
    rows = lambda *values: spark.createDataFrame([(v,) for v in values], "k int")
    store.commit(writes={"a": rows(1), "b": rows(1)})
    held = lambda t: sorted(r[0] for r in TableStore(spark, str(tmp_path)).read(t).collect())
    # a crash after the batches, before the manifest
    with monkeypatch.context() as m:
        m.setattr(TableStore, "_publish", lambda *_: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            store.commit(writes={"a": rows(2)}, appends={"b": rows(2)})
    assert held("a") == [1] and held("b") == [1]
    # an incomplete manifest: readers pass it over, a writer takes it for another one at work until it is old
    half = tmp_path / "_manifests" / "000000000002"
    half.write_text('{"a": {"batches')
    assert held("a") == [1]
    with pytest.raises(ConflictError):
        store.commit(appends={"a": rows(3)})
    os.utime(half, (0, 0))
    store.commit(appends={"a": rows(3), "b": rows(3)})
    assert held("a") == [1, 3] and held("b") == [1, 3]
    # a rival that commits first
    change = store.change().write("a", rows(9))
    store.append("a", rows(4))
    with pytest.raises(ConflictError):
        change.commit()
    assert held("a") == [1, 3, 4]
    store.compact("a")
    assert held("a") == [1, 3, 4] and store.vacuum(keep=1) == 0
    assert store.vacuum(keep=1, grace_ms=0) >= 4 and held("a") == [1, 3, 4] and held("b") == [1, 3]


def test_no_commit_is_lost(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = lambda *values: spark.createDataFrame([(v,) for v in values], "k int")
    store.write("t", rows(1, 2, 3, 4, 5))
    # two that publish at the same moment: both have looked at the numbers before either wrote
    one, two = store.change(), store.change()
    one.append("t", rows(6, 7))
    two.append("t", rows(8, 9, 10))
    numbers = store._manifests()
    held = TableStore._manifests
    try:
        TableStore._manifests = lambda _: numbers
        one.commit()
        with pytest.raises(ConflictError):
            two.commit()
    finally:
        TableStore._manifests = held
    assert store.read("t").count() == 7
    # an append that meets a rival is made anew, with the batch it has written
    published, rivals = TableStore._publish, [rows(20)]

    def late(self, number, tables):
        if rivals:
            rival = rivals.pop()
            TableStore(spark, str(tmp_path)).append("t", rival)
        published(self, number, tables)

    try:
        TableStore._publish = late
        store.append("t", rows(21))
    finally:
        TableStore._publish = published
    assert store.read("t").count() == 9 and len(list((tmp_path / "t").iterdir())) == 5
    assert not [p for p in (tmp_path / "_manifests").iterdir() if p.name.startswith("_")]


def test_vacuum_spares_what_is_needed(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = lambda *values: spark.createDataFrame([(v,) for v in values], "k int")
    assert store.vacuum() == 0
    store.write("t", rows(1, 2))
    half = tmp_path / "_manifests" / "000000000002"
    half.write_text("")
    os.utime(half, (0, 0))
    assert store.vacuum(keep=1, grace_ms=0) == 0 and store.read("t").count() == 2
    # the batches of a change that isn't published yet
    change = store.change()
    change.append("t", rows(3))
    assert store.vacuum(keep=1) == 0
    change.commit()
    assert store.read("t").count() == 3


def files_of(store, table):
    """Files of each bucket."""
    made = {}
    for f in store.read(table).inputFiles():
        made.setdefault(f.split("_bucket=")[1].split("/")[0], set()).add(f)
    return made


def test_upserts_rewrite_only_their_buckets(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), bucket_rows=150)
    rows = spark.range(1500).selectExpr("id AS k", "id % 7 AS v", "cast(id AS string) AS e")
    store.write("t", rows, key=["k"])
    before = files_of(store, "t")
    assert len(before) == 16
    store.upsert("t", spark.createDataFrame([(17, 100, None), (5000, 1, "new")], "k bigint, v bigint, e string"), ["k"], keep=["e"])
    after = files_of(store, "t")
    changed = [b for b in after if after[b] != before[b]]
    assert set(after) == set(before) and 1 <= len(changed) <= 2
    assert {r["k"]: (r["v"], r["e"]) for r in store.read("t").where("k in (17, 18, 5000)").collect()} == {17: (100, "17"), 18: (4, "18"), 5000: (1, "new")}
    # rows of a few keys are read from their buckets alone
    change = store.change()
    looked_up = change.lookup("t", spark.createDataFrame([(17,)], "k bigint"), "k bigint, v bigint, e string")
    assert len(looked_up.inputFiles()) == 1 and looked_up.where("k = 17").count() == 1
    # groups and conditions
    store.replace_groups("t", spark.createDataFrame([(3, 1, "a"), (3, 2, "b")], "k bigint, v bigint, e string"), spark.createDataFrame([(3,), (4,)], "k bigint"), ["k"])
    assert store.read("t").where("k = 3").count() == 2 and store.read("t").where("k = 4").count() == 0 and store.read("t").count() == 1501
    before = files_of(store, "t")
    assert store.delete("t", F.col("k") == 1000) == 1 and store.delete("t", F.col("k") == 1000) == 0
    after = files_of(store, "t")
    assert sum(after.get(b) != before[b] for b in before) == 1 and store.read("t").count() == 1500
    # appending adds to the buckets; those that have outgrown their size are halved when they are rewritten
    store.append("t", spark.range(10_000, 14_000).selectExpr("id AS k", "id % 7 AS v", "'' AS e"))
    assert len(files_of(store, "t")) == 16
    store.compact("t")
    assert len(files_of(store, "t")) == 64 and store.read("t").count() == 5500 and store.read("t").where("k = 13999").count() == 1
    store.upsert("t", spark.createDataFrame([(13_999, 9, "z")], "k bigint, v bigint, e string"), ["k"])
    assert store.read("t").where("k = 13999").first()["e"] == "z" and store.read("t").count() == 5500
    store.vacuum(keep=1, grace_ms=0)
    assert store.read("t").count() == 5500
    # null keys have a bucket too; keys wider than the buckets' columns keep to them
    store.upsert("t", spark.createDataFrame([(None, 1, "n")], "k bigint, v bigint, e string"), ["k", "v"])
    assert store.read("t").where("k is null").count() == 1


def test_a_plain_table_is_bucketed_by_its_first_upsert(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), bucket_rows=20)
    store.write("t", spark.range(100).selectExpr("cast(id AS int) AS k", "id AS v"))
    store.upsert("t", spark.createDataFrame([(5, 50)], "k int, v bigint"), ["k"])
    before = files_of(store, "t")
    # another type of the same key finds the same bucket
    store.upsert("t", spark.createDataFrame([(6, 60)], "k bigint, v bigint"), ["k"])
    after = files_of(store, "t")
    assert sum(after[b] != before[b] for b in before) == 1 and store.read("t").where("v in (50, 60)").count() == 4 and store.read("t").count() == 100


def test_schema_check_on_read(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("t", spark.createDataFrame([(1, "a")], "k int, v string"))
    assert store.read("t", "k int, v string, later double").first()["later"] is None
    with pytest.raises(SchemaError):
        store.read("t", "k bigint, v string")


def test_malformed_records_are_told(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"slug": "s", "title": "Dev"}]}\n{"data": [{"slug": \n')
    source = landing.SOURCES["arbeitnow"]
    assert source.load(spark, str(tmp_path), False).count() == 1
    assert source.malformed(spark, str(tmp_path), False).count() == 1


def test_research(spark):
    items = spark.createDataFrame([("Acme", "positive", i, f"claim {i}", s, c, e) for i, (s, c, e) in enumerate([("5", "2", "0"), ("1", "200", "0"), ("0", None, "0"), ("9", "x", "1"), ("3", "1", "7"), ("2", "1", "x")])], "company string, section string, place int, claim string, specificity string, corroboration string, evidence_index string")
    evidence = spark.createDataFrame([("Acme", 0, "t", "https://news.com/a", "page"), ("Acme", 1, "t", "https://www.acme.com/", "page")], "company string, evidence_index int, title string, url string, kind string")
    kept = intel.cited_items(items, evidence).orderBy("rank").collect()
    assert [(r["claim"], r["band"]) for r in kept] == [("claim 0", "high"), ("claim 1", "generic"), ("claim 2", "generic")]
    assert intel.praise_clusters(intel.cited_items(items, evidence)).first()["praise_cluster"] is True
    row = spark.range(1).select(intel.age_label(F.lit(0), 3 * 86_400_000), intel.status(F.lit(0), F.lit(None).cast("string"), 31 * 86_400_000), intel.is_fresh(F.lit(0), 1)).first()
    assert list(row) == ["3 days", "stale", True]


def test_search_results(spark):
    html = '<a rel="nofollow" href="//d.com/l/?uddg=https%3A%2F%2Fa.com%2F&rut=1">A <b>b</b></a><a rel="nofollow" href="//d.com/l/?uddg=https%3A%2F%2Fa.com%2F">again</a><a rel="nofollow" href="/x">no</a>'
    rows = intel.search_results(spark.createDataFrame([("q", html)], "query_id string, html string")).collect()
    assert [(r["title"], r["url"]) for r in rows] == [("A b", "https://a.com/")]


def test_session_rules():
    made = ranking.session_rules(ranking.Search(work_mode="hybrid", salary_floor=5, city="Paris").checked())
    assert [r.rule_id for r in made] == [-1, -2, -3]
    with pytest.raises(ValueError):
        ranking.Search(work_mode="moon").checked()


def test_embedders(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "posting_id bigint, text string")
    assert HashingEmbedder(8).embed(rows).count() == 2
    batch = BatchEmbedder(lambda: lambda texts: [[float(len(t))] for t in texts], "len", 1)
    assert sorted(r["vec"][0] for r in batch.embed(rows).collect()) == [0.0, 3.0]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"data": [{"slug": "s", "title": "Dev", "company_name": "A", "created_at": 5}]}))
    store = TableStore(spark, str(tmp_path / "store"))
    rows = landing_stream(spark, landing.SOURCES["arbeitnow"], str(tmp_path / "in"))
    ingest_stream(rows, store, HashingEmbedder(), lambda: 1, str(tmp_path / "ck")).awaitTermination()
    assert store.read("postings").count() == 1


def test_event_windows(spark):
    events = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1, 1.0), ("2024-01-01 00:20:00", "a", 1, 2.0), ("2024-01-01 02:00:00", "b", 1, 3.0)], "ts string, event_type string, user_id int, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["event_type"], r["n"]) for r in tumbling_counts(events).collect()) == [("a", 2), ("b", 1)]
    assert sorted(r["n"] for r in session_counts(events).collect()) == [1, 2]
