"""Model services, what models answer, sessions' waiting and cards, without a Spark plan where none is needed."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lodestack import models
from lodestack.functions import replies
from lodestack.functions import vocabulary as V
from lodestack.operators import ranking, sessions
from lodestack.operators.rules import Rule
from lodestack.operators.scoring import Profile
from lodestack.plugins import HashingEmbedder
from lodestack.schemas import POSTING
from lodestack.sources import landing, settings
from lodestack.sources.store import TableStore
from lodestack.storage import shared_folder


class Service(BaseHTTPRequestHandler):
    asked: list = []

    def _answer(self, told):
        body = json.dumps(told).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self._answer({"data": []})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append((self.path, self.headers.get("Authorization"), body))
        call = [{"function": {"name": "look", "arguments": '{"at": 1}'}}] if "tools" in body else None
        self._answer({"choices": [{"message": {"content": "said", "tool_calls": call}}]})

    def log_message(self, *_):
        pass


def test_services():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    set_ = models.settings_of({"LLM_PROVIDER": " Ollama ", "OLLAMA_BASE_URL": url, "HOSTED_BASE_URL": url, "HOSTED_API_KEY": "k", "LLM_DEEP_PROVIDER": "hosted", "LLM_DEEP_MODEL": "big"})
    triage, deep = models.triage_service(set_), models.deep_service(set_)
    assert (triage.name, triage.model, deep.name, deep.model, deep.api_key) == ("ollama", "hermes3:8b", "hosted", "big", "k")
    assert set_.embedding_model.endswith("/bge-small-en-v1.5") and replies.short_model_name("a/b") == "a/b"
    assert triage.complete("hello", 7, as_json=True) == "said"
    path, key, body = Service.asked[-1]
    assert path == "/v1/chat/completions" and key is None and body["max_tokens"] == 7 and body["reasoning_effort"] == "none" and body["response_format"] == {"type": "json_object"}
    assert deep.call_tools("x", [{}]) == ("said", [("look", {"at": 1})]) and Service.asked[-1][1] == "Bearer k"
    models.require(triage, deep)
    server.shutdown()
    server.server_close()
    assert not triage.healthy()
    with pytest.raises(ConnectionError):
        models.require(triage)
    for bad in ({"LLM_PROVIDER": "moon"}, {"LLM_PROVIDER": "hosted"}, {"LLM_PROVIDER": "hosted", "HOSTED_BASE_URL": "http://x"}):
        with pytest.raises(ValueError):
            models.triage_service(models.settings_of(bad))


def test_first_object():
    assert replies.first_object('so {"a": {"b": 1}} and {more}') == {"a": {"b": 1}}
    assert replies.first_object('x {not} {"a": 1}'.replace("{not} ", "")) == {"a": 1}
    for bad in ("", "none", "{broken", "[1]"):
        with pytest.raises(replies.ReplyError):
            replies.first_object(bad)


def test_planned():
    assert replies.planned('{"blendedQueries": ["a", "b", "c"], "negativeQueries": [" d ", 5]}') == [("blended", "a"), ("blended", "b"), ("negative", "d")]
    assert replies.planned('["a", " ", "b"]') == [("blended", "a"), ("blended", "b")]
    for bad in ("", "prose", "[1]"):
        with pytest.raises(replies.ReplyError):
            replies.planned(bad)


def test_intel_of():
    made = replies.intel_of('{"summary": "s", "sentiment": "great", "knownFor": ["a", "", 2], "positiveItems": [{"claim": "c", "evidenceIndex": true}, 5]}')
    assert made["sentiment"] == "unknown" and made["known_for"] == ["a", "2"] and made["items"][0]["evidence_index"] is None
    with pytest.raises(replies.ReplyError):
        replies.intel_of('{"summary": " "}')


def test_waiting():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    assert sessions.wait_until(lambda: now[0] >= 5, 180, 2, lambda: now[0], sleep) and slept == [2, 2, 2]
    assert not sessions.wait_until(lambda: False, 3, 2, lambda: now[0], sleep) and slept[-1] == 1


def test_requests():
    assert sessions.search_of({}) == ranking.Search()
    made = sessions.search_of({"search": {"city": " Laval "}, "filters": {"work_mode": "remote", "years": 3, "staffing_acceptable": False}})
    assert (made.city, made.work_mode, made.years, made.staffing_acceptable) == ("Laval", "remote", 3, False)
    for bad in ({"filters": {"work_mode": "moon"}}, {"filters": {"years": -1}}, {"filters": {"years": True}}, {"filters": {"staffing_acceptable": "no"}}, {"search": {"city": 5}}, {"search": {"enabled": [1]}}, {"search": 1}):
        with pytest.raises(ValueError):
            sessions.search_of(bad)
    assert sessions.overrides_of({**sessions.keywords_of(" java "), "city": "Oslo"}) == {"query": "java", "city": "Oslo"}
    assert settings.text_or_current(None, "x") is None and settings.text_or_current(settings.UNSET, "x") == "x" and settings.text_or_current(5, "x") == "x"


def test_pages_of_cards_fit(spark):
    rows = spark.range(1, 8).select(F.col("id").cast("int").alias("rank"), F.repeat(F.lit("t"), 200).alias("card_title"), F.repeat(F.lit("x"), (F.col("id") * 400).cast("int")).alias("card_text"))
    page = sessions.card_page(rows, 0, "footer").collect()
    assert len(page) == 5 and page[0]["page_count"] == 2 and page[0]["card_text"] == "x" * 400
    assert sum(len(r["card_title"]) + len(r["card_text"]) for r in page) + 6 <= 6000
    assert {r["page"] for r in sessions.card_page(rows, 9).collect()} == {1}


def test_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_rulebook(spark, tmp_path):
    book = settings.Rulebook(TableStore(spark, str(tmp_path)))
    onsite = Rule("Remote", "required", "keyword", {"field": "remote_claim", "operator": "==", "value": "remote"})
    for at, rule in enumerate([onsite, Rule("Gone", "preferred", "keyword", {"patterns": ["x"]}), Rule("Pay", "required", "keyword", {"field": "salary_min", "operator": ">=", "value": 5})]):
        book.insert(rule, 1000 + at)
    book.update(1, name="On site", kind="dealbreaker", config={**onsite.config, "value": "onsite"})
    book.update(3, active=False)
    assert book.delete(2) and not book.delete(2) and book.update(2, name="x") is None and book.get(2) is None
    assert [r.rule_id for r in book.active()] == [1] and book.get(1).config["value"] == "onsite"
    assert [r["rule_id"] for r in book.listed().collect()] == [3, 1]
    rows = spark.createDataFrame([(2, "b", "required", "keyword", '{"patterns": ["x"]}', True), (1, "a", "preferred", "keyword", '{"patterns": ["y"]}', True), (3, None, "required", "keyword", "{}", True), (4, "d", "required", "keyword", "{", True)], "k int, name string, kind string, validator string, config string, active boolean")
    told = {r["k"]: r["error"] for r in book.insert_rows(rows, ["k"], 5000).collect()}
    assert told == {1: None, 2: None, 3: "a rule needs a name", 4: "config is not JSON"}
    assert [(r["rule_id"], r["name"]) for r in book.listed().collect()] == [(5, "b"), (4, "a"), (3, "Pay"), (1, "On site")]


def test_stored_settings(spark, tmp_path):
    kept = settings.Settings(TableStore(spark, str(tmp_path)))
    seeded = kept.ingest_config({"ADZUNA_COUNTRY": " DE", "ADZUNA_APP_ID": "a", "ADZUNA_APP_KEY": "b"}, 1)
    assert seeded.country == "de" and sorted(seeded.enabled) == ["adzuna", "arbeitnow", "hackernews", "remoteok", "themuse"]
    saved = kept.save_ingest_config(settings.changed(seeded, {"city": " Laval ", "country": "CA", "query": "", "enabled": ["remoteok", "hackernews", "gone"]}), 2)
    assert saved == kept.ingest_config({}, 3) and (saved.city, saved.country, saved.query, sorted(saved.enabled)) == ("Laval", "ca", None, ["hackernews", "remoteok"])
    kept.set_flag("fake_repost", False, 4)
    kept.save_profile(Profile("python", 4.0), 5)
    kept.put("answers", "user", {"city": "x"}, 6)
    assert kept.get("answers", "user") == {"city": "x"} and kept.forget("answers", "user") and not kept.forget("answers", "user") and kept.get("answers", "user") is None
    kept.save_credential("adzuna", "app_id", "secret-1234", 7)
    kept.save_credential("adzuna", "app_key", "other", 8)
    assert kept.delete_credential("adzuna", "app_key")
    assert settings.credential_status(kept.credentials()) == [("adzuna", "app_id", True, "1234"), ("adzuna", "app_key", False, None)]
    assert [t for t, on in kept.flags().items() if not on] == ["fake_repost"] and kept.profile().years == 4.0


def test_config_layers():
    layers = [
        settings.defaults_of({"ADZUNA_WHAT": "java", "ADZUNA_APP_ID": "one", "ADZUNA_APP_KEY": "key"}), landing.IngestConfig(("hackernews", "adzuna"), None, "Lyon ", " Rhône", "FR", None, {"adzuna": {"app_key": "two", "app_id": ""}}),
        landing.IngestConfig(query=" python "),
    ]
    made = landing.resolve(*layers)
    assert (made.query, made.country, landing.place(made), made.credentials["adzuna"]) == ("python", "fr", "Lyon, Rhône", {"app_id": "one", "app_key": "two"})
    assert {s.name for s in landing.chosen_sources(made)} == {"adzuna", "hackernews"} and settings.pages_of({"ADZUNA_MAX_PAGES": "3"}) == 3


def test_sessions_begin_fail_and_expire(spark, tmp_path):
    kept, day = sessions.Sessions(TableStore(spark, str(tmp_path))), V.SESSION_RETENTION_MS
    kept.create("a", ranking.Search(), 0)
    kept.create("b", ranking.Search(), day // 2)
    with pytest.raises(sessions.BusyError):
        kept.create("b", ranking.Search(), day // 2)
    kept.update(2, "failed", day, "it broke")
    kept.create("a", ranking.Search(), day + 1)
    assert kept.sweep(day + 2) == 0 and kept.get(1) is None
    assert {(r["session_id"], r["user_id"], r["status"], r["error"]) for r in kept.rows().collect()} == {(2, "b", "failed", "it broke"), (3, "a", "evaluating", None)}
    assert [r["session_id"] for r in kept.actives().collect()] == [3]


def test_statements_are_embedded_once(spark, tmp_path):
    book, embedder = settings.Rulebook(TableStore(spark, str(tmp_path))), HashingEmbedder(8)
    book.insert(Rule("near", "preferred", "semantic", {"statement": "data pipelines"}), 1)
    book.insert(Rule("other", "preferred", "keyword", {"patterns": ["x"]}), 2)
    assert book.with_vectors(embedder) == 1 and book.with_vectors(embedder) == 0
    vector = book.get(1).config["vector"]
    assert len(vector) == 8 and not book.get(1).needs_model()
    book.update(1, name="renamed")
    assert book.get(1).config["vector"] == vector
    book.update(1, config={**book.get(1).config, "statement": "cooking"})
    assert book.get(1).needs_model() and book.with_vectors(embedder) == 1 and book.get(1).config["vector"] != vector


def test_waiting_sessions_run_one_after_another(spark, tmp_path):
    kept, clock = sessions.Sessions(TableStore(spark, str(tmp_path))), iter(range(1, 1000))
    for user in ("a", "b", "c"):
        kept.create(user, ranking.Search(), 0)
    postings = spark.createDataFrame([], POSTING)
    calls = []

    def given():
        calls.append([r["session_id"] for r in kept.rows().where("status = 'evaluating'").collect()])
        if len(calls) == 2:
            return postings.drop("title")
        return postings

    assert sessions.run_waiting(kept, given, lambda: next(clock)) == [1, 2, 3]
    assert {r["session_id"]: r["status"] for r in kept.rows().collect()} == {1: "done", 2: "failed", 3: "done"}
    assert [sorted(c) for c in calls] == [[1, 2, 3], [2, 3], [3]]
