"""The whole way of a batch of raw postings into the tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodestack.functions.text import company_key, redact_urls
from lodestack.operators import dedupe, flags, ranking, rules, scoring
from lodestack.operators.ingest import embedding_rows, normalise, once, run_counts, with_ids
from lodestack.plugins import Embedder, Judge
from lodestack.schemas import COMPANY_KEY, COMPANY_VECTOR, COUNTER, DUPLICATE_LINK, FINGERPRINT, INGEST_RUN, POSTING, POSTING_VECTOR, REPOST
from lodestack.sources.store import Change, TableStore
from lodestack.storage import grown, settled

#: Columns by whose hash the tables are bucketed that later batches look up rows in.
KEYS = {"postings": ("source", "external_id"), "fingerprints": ("fingerprint",), "company_vectors": ("key",), "repost_counts": ("canonical_id",)}
#: Most postings that one request evaluates.
EVALUATED_MOST = 500


def _add(change: Change, tables: dict[str, DataFrame]) -> None:
    for table, rows in tables.items():
        change.append(table, rows, key=KEYS.get(table, ()))


def _index(postings: DataFrame, vectors: DataFrame, links: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """What later batches look up of these postings; ``known``: company keys that are there already."""
    keyed = postings.select("posting_id", company_key(F.col("company_name")).alias("key")).where("key <> ''")
    return {
        "fingerprints": postings.select("fingerprint", "posting_id"),
        "company_vectors": keyed.join(grown(vectors.select("posting_id", "vec")), "posting_id").select("key", "posting_id", "vec"),
        "company_keys": keyed.select("key").distinct().join(grown(known), "key", "left_anti"),
        "repost_counts": dedupe.repost_increments(links, postings),
    }


def _last_id(change: Change) -> int:
    """The largest posting_id so far."""
    if change.exists("counters"):
        return change.read("counters").where("name = 'posting_id'").first()["value"]
    return change.read_or_empty("postings", POSTING).agg(F.max("posting_id")).first()[0] or 0


def ingest(store: TableStore, raw: DataFrame, now_ms: int, embedder: Embedder) -> DataFrame:
    """Add what is new of ``raw`` to postings, vectors, links and the ledger; returns the ledger's new rows.

    Running it again with the same rows adds nothing: a run is 'running' in the
    ledger until one commit brings all its rows, and of two runs at once the one
    that comes second fails with a ConflictError. Postings whose fingerprint is
    stored already get a link instead of a vector of their own; the others are
    embedded once and linked to earlier postings of matching companies.

    ``raw`` is read once. Of what is stored only the buckets are read that the
    batch's postings, fingerprints and companies fall in, and the list of company keys.
    """
    spark, run_id = store.spark, uuid.uuid4().hex
    batch = settled(once(raw))
    began = batch.select("source").distinct().select(F.lit(run_id).alias("run_id"), "source", F.lit("running").alias("status"), *[F.lit(None).cast("bigint").alias(c) for c in ("fetched", "added", "duplicates")], F.lit(None).cast("string").alias("error"), F.lit(now_ms).cast("bigint").alias("started_at_ms"))
    store.append("ingest_runs", settled(began))
    change = store.change()
    if change.exists("postings") and not change.exists("fingerprints"):
        # a store of before there was an index
        old = change.read("postings", POSTING)
        _add(change, _index(old, change.read_or_empty("posting_vectors", POSTING_VECTOR), change.read_or_empty("duplicate_links", DUPLICATE_LINK), spark.createDataFrame([], COMPANY_KEY)))
    last = _last_id(change)
    stored = change.lookup("postings", batch.select("source", "external_id"), POSTING)
    fresh = with_ids(batch.drop("copies").join(stored.select("source", "external_id"), ["source", "external_id"], "left_anti"), last, ["source", "external_id"])
    added = settled(normalise(fresh).withColumn("first_seen_at_ms", F.lit(now_ms).cast("bigint")).select([c.split()[0] for c in POSTING.split(", ")]))
    exact = settled(dedupe.fingerprint_links(added, change.lookup("fingerprints", added.select("fingerprint"), FINGERPRINT)))
    rest = added.join(exact.select("posting_id"), "posting_id", "left_anti")
    vectors = settled(embedder.embed(embedding_rows(rest)).select("posting_id", F.lit(embedder.model).alias("model"), F.lit(embedder.dim).alias("dim"), "vec"))
    known = change.read_or_empty("company_keys", COMPANY_KEY)
    own = settled(_index(added, vectors, exact, known)["company_vectors"])
    mine = own.select("key").distinct()
    reached = dedupe.company_pairs(mine.unionByName(known).select(F.col("key").alias("company_name")), named=False).join(grown(mine.withColumnRenamed("key", "a_key")), "a_key", "left_semi").select(F.col("b_key").alias("key")).distinct()
    reached = settled(reached)
    held = change.lookup("company_vectors", reached, COMPANY_VECTOR).join(grown(reached), "key", "left_semi").unionByName(own).withColumn("seq", F.col("posting_id"))
    links = settled(exact.unionByName(dedupe.semantic_links(own.withColumn("seq", F.col("posting_id")), held)))
    runs = run_counts(batch, added, links).select(F.lit(run_id).alias("run_id"), "source", F.lit("ok").alias("status"), "fetched", "added", "duplicates", F.lit(None).cast("string").alias("error"), F.lit(now_ms).cast("bigint").alias("started_at_ms"))
    runs = settled(runs)
    _add(change, {"postings": added, "posting_vectors": vectors, "duplicate_links": links, "ingest_runs": runs, **_index(added, vectors, links, known)})
    highest = added.agg(F.max("posting_id")).first()[0] or last
    change.upsert("counters", spark.createDataFrame([Row(name="posting_id", value=highest)], COUNTER), ["name"])
    change.commit()
    return runs


def failed_run(store: TableStore, source: str, error: str, now_ms: int = 0, run_id: str | None = None) -> None:
    """Note a source's failure, without the secrets its URLs may hold."""
    row = store.spark.createDataFrame([(run_id or uuid.uuid4().hex, source, "error", 0, 0, 0, error, now_ms)], INGEST_RUN)
    store.append("ingest_runs", row.withColumn("error", redact_urls(F.col("error"))))


def run_history(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs of the ledger, each with its last state: a run that is only 'running' has not ended."""
    state = F.when(F.col("status") == "running", 0).otherwise(1)
    last = runs.groupBy("run_id", "source").agg(F.max_by(F.struct("status", "fetched", "added", "duplicates", "error", "started_at_ms"), state).alias("last"))
    return last.select("run_id", "source", "last.*").orderBy(F.desc("started_at_ms"), F.desc("run_id"), "source").limit(limit)


def evaluate_all(
    store: TableStore, chosen: Sequence[rules.Rule], spoken: Sequence[str] = (), statement_vectors: dict[str, list[float]] | None = None, judge: Judge | None = None, limit: int | None = None
) -> DataFrame:
    """Evaluate all postings, or the newest ``limit`` (500 at most), and keep the latest result of each."""
    postings = store.read("postings", POSTING)
    if limit is not None:
        newest = postings.select("posting_id").orderBy(F.desc("posting_id")).limit(max(0, min(limit, EVALUATED_MOST)))
        postings = postings.join(F.broadcast(newest), "posting_id", "left_semi")  # 500 rows at most
    done = settled(rules.evaluate(postings, chosen, spoken, store.read_or_empty("posting_vectors", POSTING_VECTOR), statement_vectors, judge))
    store.upsert("evaluations", done, ["posting_id"])
    return done


def score_all(store: TableStore, profile: scoring.Profile, now_ms: int, enabled: dict[str, bool] | None = None, learned: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Score and flag all postings, or ``limit`` (1,000 at most) of them, unscored ones first; scores are replaced by posting, flags by posting and type."""
    change = store.change()
    every = postings = change.read("postings", POSTING)
    if limit is not None:
        scored = change.read("scores") if change.exists("scores") else store.spark.createDataFrame([], "posting_id bigint")
        postings = postings.join(F.broadcast(ranking.score_order(postings, scored, max(0, limit)).select("posting_id")), "posting_id", "left_semi")
    links = change.read_or_empty("duplicate_links", DUPLICATE_LINK)
    increments = change.read("repost_counts", REPOST) if change.exists("repost_counts") else dedupe.repost_increments(links, every)
    reposts = settled(dedupe.repost_counts(postings, links, now_ms, increments=increments))
    intel = change.read("company_intel") if change.exists("company_intel") else None
    done = settled(scoring.score(postings, profile, change.read_or_empty("posting_vectors", POSTING_VECTOR), reposts, intel, learned))
    found = flags.detect(postings, reposts, flags.enabled_types(enabled))
    change.upsert("scores", done, ["posting_id"]).replace_groups("flags", found, postings.select("posting_id"), ["posting_id"]).commit()
    return done
