from __future__ import annotations

import random

import pytest

from lodestack.operators import intel, research_queue
from lodestack.operators.research_queue import EVENT, QueueState, StoredQueue
from lodestack.sources.store import ConflictError, TableStore


def test_one_runs_and_the_others_wait():
    q = QueueState()
    assert [q.ask("a", "A"), q.ask("b", "B"), q.ask("a", "A"), q.ask("c", "C"), q.ask("b", "B", True), q.ask("", " ")] == ["researching", "queued", "researching", "queued", "queued", "queued"]
    assert q.active == ["a", "A", False] and q.waiting == [["b", "B", True], ["c", "C", False]]
    q.end("it broke")
    assert q.active == ["b", "B", True] and q.status("a") == "failed" and q.status("c") == "queued" and q.status("z") is None
    q.end()
    # asking again forgets the failure, and a good end does too
    assert q.ask("a", "A") == "queued" and q.status("a") == "queued" and not q.failures
    q.end(), q.end("x"), q.end()
    assert q.active is None and q.failures == {"a": "x"} and QueueState(q.text()).failures == {"a": "x"}


def events_of(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["ask", "ask", "done", "failed", "odd"])
        rows.append((f"q{rng.randrange(3)}", i // 2, i, kind, rng.choice(["Acme", " ACME ", "Bolt", "Core", "", None]), rng.choice([True, False, None]), "at https://x.y/?api_key=k"))
    return rows


def steps_by_hand(rows):
    queues, made = {}, set()
    for queue, at, seq, kind, company, use_reviews, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        q = queues.setdefault(queue, QueueState())
        name = (company or "").strip().lower()
        told = q.ask(name, name, bool(use_reviews)) if kind == "ask" else None
        if kind in ("done", "failed"):
            q.end("e" if kind == "failed" else None)
        made.add((queue, at, seq, kind, told, q.active and q.active[0], q.active and q.active[2], len(q.waiting), len(q.failures)))
    return made


def test_replay_and_track_agree(spark, tmp_path):
    rows = events_of(1)
    frame = spark.createDataFrame(rows, EVENT)
    expected = steps_by_hand(rows)
    assert {tuple(r) for r in research_queue.replay(frame.repartition(4)).collect()} == expected
    # in three files, one a micro-batch
    for part in range(3):
        spark.createDataFrame(rows[100 * part : 100 * part + 100], EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = research_queue.track(stream).writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("steps").collect()} == expected
    assert research_queue.replay(frame.limit(0)).count() == 0


def test_stored_queue(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    queue, ran = StoredQueue(store), []
    assert queue.ask("Acme") == "researching" and queue.ask(" acme ", True) == "researching" and queue.ask("Bolt", True) == "queued"

    def research(company, use_reviews):
        ran.append((company, use_reviews))
        if company == "Acme":
            assert queue.status("ACME") == "researching" and queue.status("bolt") == "queued"
            raise RuntimeError("GET https://x.y/?api_key=secret failed")

    assert queue.run(research) == 2 and ran == [("Acme", False), ("Bolt", True)]
    assert queue.status("acme") == "failed" and queue.failure("acme") == "GET https://x.y/?api_key=*** failed" and queue.status("bolt") is None
    assert StoredQueue(store, "other").status("acme") is None
    # two that ask at once
    change = store.change()
    queue.ask("Core")
    change.upsert("research_queues", spark.createDataFrame([("companies", QueueState().text())], research_queue.QUEUE), ["queue"])
    with pytest.raises(ConflictError):
        change.commit()
    assert queue.status("core") == "researching"


class Broken:
    def complete(self, prompt, max_tokens):
        raise RuntimeError("no model")


class Plain:
    def complete(self, prompt, max_tokens):
        return '{"blendedQueries": ["acme"], "positiveQueries": [], "negativeQueries": []}'


def test_refresh_stores_one_company(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    landed = (
        spark.createDataFrame([], "query_id string, place int, title string, url string"), spark.createDataFrame([], "url string, html string"),
        spark.createDataFrame([], "company string, place int, kind string, title string, url string, text string"),
    )
    row = intel.refresh(store, " Acme ", Plain(), *landed, now_ms=5).first()
    assert (row["company_name_key"], row["display_name"], row["evidence_status"], row["fetched_at_ms"]) == ("acme", "Acme", "insufficient", 5)
    with pytest.raises(RuntimeError, match="no model"):
        intel.refresh(store, "Bolt", Broken(), *landed, now_ms=6)
    assert store.read("company_intel").count() == 1
