"""Ranked lists, session searches and their orders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators import flags as flag_operators
from lodestack.operators import rules as rule_operators
from lodestack.operators import scoring
from lodestack.storage import grown, settled

LIST_DEFAULT, LIST_MOST = 50, 200
SESSION_ROWS, SESSION_KEPT, PAGE_ROWS = 200, 25, 5


def list_postings(
    postings: DataFrame, evaluations: DataFrame, scores: DataFrame, feedback: DataFrame, flags: DataFrame | Callable[[DataFrame], DataFrame],
    order: str = "recent", limit: int | None = None, source: str | None = None, outcome: str | None = None, hide_flagged: bool = False,
) -> DataFrame:
    """Postings with outcome, scores, feedback and flags; newest or best first; at most 200.

    The list is found by its keys, then the postings' other columns and flags
    are fetched for its rows only. ``flags`` are stored ones, or what detects
    them for some postings, which then are the rows of the list unless flagged
    postings are to be hidden.
    """
    rows = postings.select("posting_id", "source", "first_seen_at_ms")
    rows = rows if source is None else rows.where(F.col("source") == source)
    rows = rows.join(grown(evaluations), "posting_id", "left").join(grown(scores), "posting_id", "left").join(grown(feedback), "posting_id", "left")
    if outcome is not None:
        rows = rows.where(F.col("outcome") == outcome)
    if hide_flagged:
        flags = flags(postings) if callable(flags) else flags
        rows = rows.join(grown(flags.select("posting_id").distinct()), "posting_id", "left_anti")
    keys = [F.desc("first_seen_at_ms")] if order == "recent" else [F.desc_nulls_last("combined")]
    page = settled(rows.orderBy(*keys, F.desc("posting_id")).limit(max(0, min(limit or LIST_DEFAULT, LIST_MOST))).drop("source", "first_seen_at_ms"))
    listed = postings.join(F.broadcast(page), "posting_id")  # 200 rows at most
    found = flags(postings.join(F.broadcast(page.select("posting_id")), "posting_id", "left_semi")) if callable(flags) else flags.join(F.broadcast(page.select("posting_id")), "posting_id", "left_semi")
    return listed.join(flag_operators.by_posting(found), "posting_id", "left").orderBy(*keys, F.desc("posting_id"))


def score_order(postings: DataFrame, scores: DataFrame, limit: int | None = None) -> DataFrame:
    """posting_id in the order of scoring: unscored first, then by id; at most 1,000 if limited."""
    known = postings.select("posting_id").join(scores.select("posting_id", F.lit(1).alias("scored")), "posting_id", "left")
    rows = known.select("posting_id", F.coalesce("scored", F.lit(0)).alias("scored")).orderBy("scored", "posting_id")
    return rows if limit is None else rows.limit(min(limit, 1000))


def ranked(rows: DataFrame, keep: int = SESSION_KEPT) -> DataFrame:
    """``rows`` (session_id, posting_id, combined, interview_chance) with rank: best first, missing scores last, newer id first."""
    order = Window.partitionBy("session_id").orderBy(F.coalesce("combined", F.lit(-1)).desc(), F.coalesce("interview_chance", F.lit(-1)).desc(), F.col("posting_id").desc())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def page(results: DataFrame, number: int) -> DataFrame:
    """Rows of one page of five of a stored ranking, counted from 0 and kept within the pages there are."""
    last = max(0, -(-results.count() // PAGE_ROWS) - 1)
    number = min(max(0, number), last)
    return results.where(F.col("rank").between(PAGE_ROWS * number + 1, PAGE_ROWS * (number + 1)))


@dataclass(frozen=True)
class Search:
    """Answers that start a session."""

    work_mode: str = "any"
    salary_floor: float | None = None
    city: str | None = None
    years: float | None = None
    skills_text: str | None = None
    staffing_acceptable: bool = True

    def checked(self) -> Search:
        if self.work_mode not in ("any", "remote", "hybrid", "onsite"):
            raise ValueError("work_mode must be any, remote, hybrid or onsite")
        for name in ("salary_floor", "years"):
            value = getattr(self, name)
            if value is not None and (not isinstance(value, (int, float)) or value < 0):
                raise ValueError(f"{name} must be a number of at least 0")
        return self


def session_rules(search: Search) -> list[rule_operators.Rule]:
    """Rules of a session, with ids from -1 downwards."""
    made = []
    if search.work_mode == "remote":
        made.append(rule_operators.from_template("remote-only"))
    elif search.work_mode == "hybrid":
        made.append(rule_operators.from_template("hybrid-or-remote"))
    elif search.work_mode == "onsite":
        made.append(rule_operators.Rule("On-site only", "required", "keyword", {"field": "remote_claim", "operator": "==", "value": "onsite"}))
    if search.salary_floor is not None:
        made.append(rule_operators.from_template("salary-floor-100k", name=f"Salary floor {search.salary_floor:g}", config={"value": search.salary_floor}))
    if (search.city or "").strip():
        made.append(rule_operators.from_template("location-mentions", config={"value": search.city}))
    return [rule_operators.Rule(r.name, r.kind, r.validator, r.config, -(i + 1)) for i, r in enumerate(made)]


def run_session(session_id: int, postings: DataFrame, search: Search, vectors: DataFrame | None = None, profile_vector: Sequence[float] | None = None, reposts: DataFrame | None = None, intel: DataFrame | None = None) -> DataFrame:
    """Evaluate the newest postings, score those that pass, leave out intermediaries if asked to, rank and snapshot."""
    search = search.checked()
    keys = postings.select("posting_id", "first_seen_at_ms").orderBy(F.desc("first_seen_at_ms"), F.desc("posting_id")).limit(SESSION_ROWS)
    newest = settled(postings.join(F.broadcast(keys.select("posting_id")), "posting_id", "left_semi"))  # 200 rows
    passed = newest.join(rule_operators.evaluate(newest, session_rules(search)).where("outcome = 'passed'").select("posting_id"), "posting_id", "left_semi")
    flags = flag_operators.detect(passed, reposts)
    if not search.staffing_acceptable:
        passed = passed.join(flags.where("type = 'staffing_intermediary'").select("posting_id").distinct(), "posting_id", "left_anti")
    profile = scoring.Profile(search.skills_text, search.years, tuple(profile_vector) if profile_vector is not None else None)
    scores = scoring.score(passed, profile, vectors, reposts, intel)
    rows = passed.join(scores, "posting_id").withColumn("session_id", F.lit(session_id)).withColumn("top_evidence", scoring.top_evidence())
    listed = ranked(rows).join(flag_operators.by_posting(flags), "posting_id", "left")
    return listed.select("session_id", "rank", "posting_id", "title", "company_name", "location_raw", "salary_min", "salary_max", "salary_currency", "combined", "interview_chance", "job_quality", "flags", "top_evidence", "url")
