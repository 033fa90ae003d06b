"""Company research: verified pages, cited items, freshness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import replies
from lodestack.functions import vocabulary as V
from lodestack.functions.text import bound, company_name_key, page_text, redact_urls
from lodestack.functions.web import corroboration, host_label, is_review_platform, own_site_labels, page_is_about, specificity, specificity_band
from lodestack.operators.ingest import with_ids
from lodestack.plugins import Judge
from lodestack.sources.store import TableStore
from lodestack.storage import ready, settled

PAGES_KEPT, ITEMS_KEPT, PAGE_CHARACTERS, REVIEWS_KEPT = 9, 3, 6000, 20


def search_results(html: DataFrame) -> DataFrame:
    """query_id, place, title, url of a result page's anchors: http only, first of each URL, with a title."""
    found = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(V.SEARCH_ANCHOR), F.lit(g)).alias(name) for g, name in ((1, "href"), (2, "label"))])
    rows = html.select("query_id", F.posexplode(found).alias("place", "a"))
    rows = rows.select("query_id", "place", F.try_url_decode(F.regexp_extract("a.href", V.SEARCH_TARGET, 1)).alias("url"), page_text(F.col("a.label")).alias("title"))
    rows = rows.where(F.col("url").startswith("http") & (F.col("title") != ""))
    return rows.groupBy("query_id", "url").agg(F.min(F.struct("place", "title")).alias("first")).select("query_id", "first.place", "first.title", "url")


def fetched(pages: DataFrame, closed: bool = False) -> DataFrame:
    """``pages`` with text: the first 256 KiB of html as text, 6,000 characters of it; ``closed`` as in :func:`text.unescaped`."""
    ready(pages.sparkSession)
    return pages.withColumn("text", F.substring(page_text(F.substring("html", 1, 262144), closed), 1, PAGE_CHARACTERS))


def verified_pages(candidates: DataFrame) -> DataFrame:
    """Per company the first pages that are about it, review platforms before others, each URL once.

    ``candidates``: company, place, title, url, text.
    """
    once = candidates.groupBy("company", "url").agg(F.min_by(F.struct("place", "title", "text"), "place").alias("p")).select("company", "url", "p.*")
    about = once.where(page_is_about(F.col("company"), F.col("title"), F.col("url"), F.col("text")))
    order = Window.partitionBy("company").orderBy(F.when(is_review_platform(F.col("url")), 0).otherwise(1), "place", "url")
    return about.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PAGES_KEPT)


def cited_items(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per company and section the three most telling claims that cite evidence not of the company's own site.

    ``items``: company, section, place, claim, specificity, corroboration,
    evidence_index (as a model gave them). ``evidence``: company,
    evidence_index, title, url, kind.
    """
    level, weight = specificity(F.col("specificity")), corroboration(F.col("corroboration"))
    index = F.when(F.col("evidence_index").cast("string").rlike(r"^\d+$"), F.col("evidence_index").cast("string").try_cast("int"))
    known = items.where(F.trim(F.coalesce("claim", F.lit(""))) != "").select("company", "section", "place", F.trim("claim").alias("claim"), level.alias("level"), weight.alias("corroboration"), index.alias("evidence_index"))
    own = F.array_contains(own_site_labels(F.col("company")), host_label(F.col("url")))
    cited = known.join(evidence.withColumn("evidence_index", F.col("evidence_index").cast("int")), ["company", "evidence_index"]).where(~own)
    order = Window.partitionBy("company", "section").orderBy(F.desc("level"), F.desc("corroboration"), "place")
    ranked = cited.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ITEMS_KEPT)
    return ranked.select("company", "section", "rank", "claim", specificity_band(F.col("level")).alias("band"), "corroboration", F.col("title").alias("source_title"), F.col("url").alias("source_url"), "kind")


def praise_clusters(items: DataFrame) -> DataFrame:
    """company and whether its positive items are mostly vague praise, repeated at scale."""
    vague = F.col("band") == "generic"
    return items.where("section = 'positive'").groupBy("company").agg(
        ((F.count_if(vague) >= V.CLUSTER_ITEMS) & (F.count_if(vague & (F.col("corroboration") >= V.CLUSTER_CORROBORATION)) > 0)).alias("praise_cluster")
    )


def review_evidence(reviews: DataFrame) -> DataFrame:
    """The first 20 reviews of each company, without those that say nothing, as evidence: company, place, title, url, text, kind.

    ``reviews``: company, place, text, title, url, kind. Texts end after 2,000 characters.
    """
    text, title, kind = F.trim(F.coalesce("text", F.lit(""))), F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("kind", F.lit("")))
    order = Window.partitionBy("company").orderBy("place")
    first = reviews.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= REVIEWS_KEPT).where(text != "")
    return first.select(
        "company", "place", F.when(title == "", "Employee review").otherwise(title).alias("title"), F.trim(F.coalesce("url", F.lit(""))).alias("url"),
        F.substring(text, 1, 2000).alias("text"), F.when(kind == "signal", kind).otherwise("review").alias("kind"),
    )


def evidence_label(kind: Column, track: Column) -> Column:
    """What a piece of evidence is, for whoever weighs it."""
    found = F.when(track == "blended", "general search").when(track.isin("positive", "negative"), F.concat(track, F.lit(" search")))
    return F.when(kind == "review", "employee review").otherwise(F.concat(F.lit("web page"), F.coalesce(F.concat(F.lit(", "), found), F.lit(""))))


def numbered(pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """Evidence of each company, numbered from 1: verified pages in their order, then reviews.

    ``pages``: as :func:`verified_pages` gives them, with track; ``reviews``: as
    :func:`review_evidence`. At most 29 rows a company.
    """
    columns = ("company", "title", "url", "text", "track", "kind")
    of_pages = pages.select(F.lit(0).alias("part"), F.col("rank").cast("long").alias("at"), "company", "title", "url", "text", "track", F.lit("signal").alias("kind"))
    of_reviews = reviews.select(F.lit(1).alias("part"), F.col("place").cast("long").alias("at"), "company", "title", "url", "text", F.lit("api").alias("track"), "kind")
    order = Window.partitionBy("company").orderBy("part", "at")
    return of_pages.unionByName(of_reviews).withColumn("evidence_index", F.row_number().over(order)).select("evidence_index", *columns)


def dossiers(evidence: DataFrame) -> DataFrame:
    """company and dossier: its evidence as one text of at most 16,000 characters."""
    entry = F.concat(
        F.lit("["), F.col("evidence_index").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" <"), F.coalesce("url", F.lit("")), F.lit("> ("),
        evidence_label(F.col("kind"), F.col("track")), F.lit(")\n"), F.coalesce("text", F.lit("")),
    )
    rows = evidence.select("company", F.struct("evidence_index", entry.alias("entry")).alias("e")).groupBy("company").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return rows.select("company", F.substring(F.array_join(F.transform("e", lambda x: x.entry), "\n\n"), 1, V.EVIDENCE_CHARACTERS).alias("dossier"))


CLAIM = "struct<section:string,place:int,claim:string,specificity:string,corroboration:string,evidence_index:string>"
SYNTHESIS = f"company string, evidence_status string, summary string, known_for array<string>, notable_projects array<string>, reputation_notes string, sentiment string, claims array<{CLAIM}>, error string"
_ASKED = (
    "You judge an employer for somebody who looks for work. Use only the numbered evidence below. Answer with one JSON object: summary (what the company does), "
    "knownFor and notableProjects (lists of short texts), reputationNotes, sentiment (positive, mixed, negative or unknown), positiveItems and negativeItems "
    "(at most five each, from reviews or reports and never from the company's own pages; each has claim, evidenceIndex, specificity from 0 to 5, and corroboration, "
    "the number of independent voices). Leave a list empty rather than invent."
)
_AGAIN = "\n\nThat was no JSON object. Answer again with the object alone."


def synthesis_prompt(company: Column, dossier: Column) -> Column:
    return F.concat(F.lit(_ASKED), F.lit("\n\nCompany: "), company, F.lit("\n\n"), dossier)


def _synthesising(model: Judge):
    def told(prompt: str) -> dict:
        try:
            return replies.intel_of(model.complete(prompt, 3072))
        except replies.ReplyError as error:
            if "JSON" not in str(error):
                raise
        return replies.intel_of(model.complete(prompt + _AGAIN, 3072))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in SYNTHESIS.split(", ")]
        for frame in frames:
            rows = []
            for company, prompt in zip(frame["company"], frame["prompt"]):
                try:
                    made = told(prompt)
                    rows.append((company, "sufficient", made["summary"], made["known_for"], made["notable_projects"], made["reputation_notes"], made["sentiment"], made["items"], None))
                except Exception as error:  # one company's model failure is its own result
                    rows.append((company, "failed", "", [], [], "", "unknown", [], f"{type(error).__name__}: {error}"[:500]))
            yield pd.DataFrame(rows, columns=names)

    return run


def synthesised(companies: DataFrame, evidence: DataFrame, model: Judge) -> DataFrame:
    """One row per company (see SYNTHESIS): what the model makes of its dossier.

    A company without evidence is 'insufficient' and isn't asked about; one whose
    answer stays unusable after a second try is 'failed', with the error.
    """
    known = dossiers(evidence)
    asked = companies.select("company").distinct().join(known, "company")
    told = asked.select("company", synthesis_prompt(F.col("company"), F.col("dossier")).alias("prompt")).mapInPandas(_synthesising(model), SYNTHESIS)
    none = companies.select("company").distinct().join(known.select("company"), "company", "left_anti")
    empty = none.select(
        "company", F.lit("insufficient").alias("evidence_status"), F.lit("").alias("summary"), *[F.array().cast("array<string>").alias(c) for c in ("known_for", "notable_projects")],
        F.lit("").alias("reputation_notes"), F.lit("unknown").alias("sentiment"), F.array().cast(f"array<{CLAIM}>").alias("claims"), F.lit(None).cast("string").alias("error"),
    )
    return told.unionByName(empty)


def intel_of(synthesis: DataFrame, evidence: DataFrame) -> DataFrame:
    """The synthesis with checked items (positive_items, negative_items) and praise_cluster in place of claims."""
    claims = synthesis.select("company", F.explode("claims").alias("c")).select("company", "c.*")
    items = cited_items(claims, evidence)
    of = lambda section: F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == section, F.struct("rank", "claim", "band", "corroboration", "source_title", "source_url", "kind")))), lambda x: x.dropFields("rank"))
    listed = items.groupBy("company").agg(of("positive").alias("positive_items"), of("negative").alias("negative_items"))
    joined = synthesis.drop("claims").join(listed, "company", "left").join(praise_clusters(items), "company", "left")
    return with_defaults(joined)


ITEMS = "array<struct<claim:string,band:string,corroboration:int,source_title:string,source_url:string,kind:string>>"


def with_defaults(intel: DataFrame) -> DataFrame:
    """Research stored before it had sections: sufficient, without items."""
    defaults = {"evidence_status": F.lit("sufficient"), "positive_items": F.array().cast(ITEMS), "negative_items": F.array().cast(ITEMS), "praise_cluster": F.lit(False)}
    return intel.withColumns({c: F.coalesce(F.col(c), d) if c in intel.columns else d for c, d in defaults.items()})


PLANNED = "company string, place int, track string, query string, error string"


def plan_prompt(company: Column) -> Column:
    told = "Plan web searches about an employer for somebody who looks for work. Answer with one JSON object: blendedQueries (what it does, its reputation), positiveQueries (what employees praise) and negativeQueries (what they complain about), two texts each at most. Company: "
    return F.concat(F.lit(told), company)


def planned_searches(companies: DataFrame, model: Judge) -> DataFrame:
    """The searches that a model plans for each company (see PLANNED); an unusable answer is one row with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for company, prompt in zip(frame["company"], frame["prompt"]):
                try:
                    rows += [(company, i, track, query, None) for i, (track, query) in enumerate(replies.planned(model.complete(prompt, 1024)))]
                except Exception as error:  # one company's model failure is its own result
                    rows.append((company, -1, None, None, f"{type(error).__name__}: {error}"[:500]))
            yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in PLANNED.split(", ")])

    named = companies.select(F.trim(F.regexp_replace("company", r"\s+", " ")).alias("company")).where("company <> ''").distinct()
    return named.select("company", plan_prompt(F.col("company")).alias("prompt")).mapInPandas(run, PLANNED)


def gathered(plans: DataFrame, results: DataFrame, pages: DataFrame) -> DataFrame:
    """Verified pages of each company, with track.

    ``plans``: of :func:`planned_searches`; ``results``: query_id (the query),
    place, title, url of landed searches; ``pages``: url, html of landed pages.
    A URL counts for the first search that found it.
    """
    found = plans.where("query is not null").select("company", F.col("place").alias("search"), "track", F.col("query").alias("query_id")).join(results, "query_id")
    place = (F.col("search") * 1000 + F.col("place")).alias("place")
    once = found.select("company", "track", place, "title", "url").groupBy("company", "url").agg(F.min_by(F.struct("place", "title", "track"), "place").alias("p")).select("company", "url", "p.*")
    read = once.join(fetched(pages.select("url", "html")).select("url", "text").dropDuplicates(["url"]), "url").where(F.trim("text") != "")
    return verified_pages(read).join(once.select("company", "url", "track"), ["company", "url"])


def analyse(companies: DataFrame, model: Judge, results: DataFrame, pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """The whole research of ``companies`` (company) over landed searches, pages and reviews: one row of intel each.

    A company whose searches can't be planned is 'failed' like one without a usable synthesis.
    """
    plans = settled(planned_searches(companies, model))
    evidence = settled(numbered(gathered(plans, results, pages), review_evidence(reviews)))
    failed = plans.where("error is not null").select("company", F.col("error").alias("plan_error"))
    able = companies.select(F.trim(F.regexp_replace("company", r"\s+", " ")).alias("company")).where("company <> ''").distinct()
    made = settled(synthesised(able.join(failed, "company", "left_anti"), evidence, model))
    lost = synthesised(failed, evidence.limit(0), model).join(failed, "company")
    lost = lost.withColumn("evidence_status", F.lit("failed")).withColumn("error", F.col("plan_error")).drop("plan_error")
    return intel_of(made.unionByName(lost), evidence)


def stamped(intel: DataFrame, now_ms: int, outcomes: DataFrame | None = None) -> DataFrame:
    """Intel as it is stored: by company_name_key, with fetched_at_ms, and the review interface's outcome where it was asked.

    ``outcomes``: company, outcome, review_company_id.
    """
    rows = intel if outcomes is None else intel.join(outcomes.select("company", F.col("outcome").alias("search_outcome"), "review_company_id"), "company", "left")
    for name in ("search_outcome", "review_company_id"):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast("string"))
    return with_defaults(rows).select(
        company_name_key(F.col("company")).alias("company_name_key"), F.trim("company").alias("display_name"), *[c for c in rows.columns if c != "company"], F.lit(now_ms).cast("bigint").alias("fetched_at_ms")
    )


def save_intel(store: TableStore, rows: DataFrame) -> None:
    """Replace the research of these companies; a review company once resolved stays so. Failed research isn't stored."""
    store.upsert("company_intel", settled(rows.where("evidence_status <> 'failed'").drop("error")), ["company_name_key"], keep=["review_company_id"])


def refresh(
    store: TableStore, company: str, model: Judge, results: DataFrame, pages: DataFrame, reviews: DataFrame, now_ms: int, use_reviews: bool = False, outcomes: DataFrame | None = None
) -> DataFrame:
    """Research one company anew and store it; its stored row. RuntimeError tells why if nothing came of it.

    ``results``, ``pages`` and ``reviews`` are what has landed (see :func:`analyse`);
    reviews count, and ``outcomes`` of asking for them are stamped on, only if the run
    opted in.
    """
    companies = store.spark.createDataFrame([(company,)], "company string")
    made = settled(analyse(companies, model, results, pages, reviews if use_reviews else reviews.limit(0)))
    row = made.first()
    if row is None:
        raise ValueError("a company needs a name")
    if row["evidence_status"] == "failed":
        raise RuntimeError(row["error"])
    save_intel(store, stamped(made, now_ms, outcomes if use_reviews else None))
    return store.read("company_intel").where(F.col("company_name_key") == company_name_key(F.lit(company)))


def waiting(requests: DataFrame) -> DataFrame:
    """Companies in the order of their first request: place, company_name_key, company, use_reviews (if any request asks for it)."""
    keyed = requests.withColumn("company_name_key", company_name_key(F.col("company"))).where("company_name_key <> ''")
    once = keyed.groupBy("company_name_key").agg(F.min_by("company", "asked_at").alias("company"), F.min("asked_at").alias("asked_at"), F.max("use_reviews").alias("use_reviews"))
    placed = with_ids(once, 0, ["asked_at", "company_name_key"])
    return placed.select(F.col("posting_id").cast("int").alias("place"), "company_name_key", "company", "use_reviews")


def pending(fetched_at_ms: Column, queue: Column, now_ms: int) -> Column:
    """Whether research may still arrive: none fresh, and the company waits or is being researched."""
    return ~F.coalesce(is_fresh(fetched_at_ms, now_ms), F.lit(False)) & F.coalesce(queue.isin("queued", "researching"), F.lit(False))


def outcome_line(company: Column, outcome: Column, reviews: Column, overview: Column, failure: Column) -> Column:
    """One line for a log about what asking the review interface came to."""
    said = (
        F.when(outcome == "contributed", F.concat(reviews.cast("string"), F.lit(" reviews"), F.when(overview, " and an overview").otherwise(", no overview")))
        .when(outcome == "no_match", "no company of this name")
        .when(outcome == "no_evidence", "the company is known, but nothing is said about it")
        .otherwise(F.concat(F.lit("failed: "), F.coalesce(redact_urls(failure), F.lit("unknown"))))
    )
    return F.concat(F.lit("reviews of "), company, F.lit(": "), said)


def is_fresh(fetched_at_ms: Column, now_ms: int) -> Column:
    return (F.lit(now_ms) - fetched_at_ms) < V.INTEL_FRESH_MS


def age_label(fetched_at_ms: Column, now_ms: int) -> Column:
    """today, or a number of days, weeks, months or years."""
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
    days = F.floor((F.lit(now_ms) - fetched_at_ms) / 86_400_000)
    part = lambda d, size: F.floor(d / size)
    return bound(days, lambda d: F.when(d < 1, "today").when(d < 7, said(d, "day")).when(d < 30, said(part(d, 7), "week")).when(d < 365, said(part(d, 30), "month")).otherwise(said(part(d, 365), "year")))


def status(fetched_at_ms: Column, queue: Column, now_ms: int) -> Column:
    """queued or researching; else fresh or stale if there is any; else failed or none."""
    stored = F.when(is_fresh(fetched_at_ms, now_ms), "fresh").when(fetched_at_ms.isNotNull(), "stale")
    return F.coalesce(F.when(queue.isin("queued", "researching"), queue), stored, F.when(queue == "failed", queue), F.lit("none"))


def research_candidates(postings: DataFrame, scores: DataFrame, evaluations: DataFrame, top: int = 10) -> DataFrame:
    """Companies of the ``top`` best-scored passed postings, each once, best first; a posting without a company takes a place too."""
    best = postings.join(scores, "posting_id").join(evaluations.where("outcome = 'passed'"), "posting_id")
    rows = best.orderBy(F.desc_nulls_last("combined"), F.desc("posting_id")).limit(top).where("company_name is not null")
    key = company_name_key(F.col("company_name")).alias("company_name_key")
    return rows.groupBy(key).agg(F.max("combined").alias("combined"), F.max_by("company_name", F.struct("combined", "posting_id")).alias("company_name")).orderBy(F.desc("combined"), "company_name_key")


def disagreements(flags: DataFrame, postings: DataFrame, intel: DataFrame) -> DataFrame:
    """Postings flagged as toxic whose company's research is positive."""
    toxic = flags.where("type = 'toxic_culture'").select("posting_id").distinct().join(postings, "posting_id")
    return toxic.withColumn("company_name_key", company_name_key(F.col("company_name"))).join(intel.where("sentiment = 'positive'"), "company_name_key").select("posting_id", "company_name")
