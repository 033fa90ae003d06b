"""Search sessions as tables, what their users answer, and the cards that show results."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import asdict
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import vocabulary as V
from lodestack.functions.text import bound
from lodestack.operators.ranking import PAGE_ROWS, Search, ranked, run_session
from lodestack.sources.store import TableStore
from lodestack.storage import settled

SESSION = "session_id bigint, user_id string, status string, request string, error string, created_at_ms bigint, updated_at_ms bigint, expires_at_ms bigint"


class BusyError(RuntimeError):
    """The user has a session that isn't over."""


class Sessions:
    """The tables ``sessions`` and ``session_results``; one running session per user."""

    def __init__(self, store: TableStore) -> None:
        self.store = store

    def rows(self) -> DataFrame:
        return self.store.read_or_empty("sessions", SESSION)

    def _put(self, row: tuple) -> None:
        self.store.upsert("sessions", self.store.spark.createDataFrame([row], SESSION), ["session_id"])

    def get(self, session_id: int) -> dict[str, Any] | None:
        row = self.rows().where(F.col("session_id") == session_id).first()
        return None if row is None else row.asDict()

    def active(self, user_id: str) -> dict[str, Any] | None:
        """The user's earliest session that is neither done nor failed."""
        row = self.rows().where((F.col("user_id") == user_id) & ~F.col("status").isin("done", "failed")).orderBy("session_id").first()
        return None if row is None else row.asDict()

    def actives(self) -> DataFrame:
        """The earliest running session of every user who has one."""
        running = self.rows().where(~F.col("status").isin("done", "failed"))
        return running.groupBy("user_id").agg(F.min_by(F.struct(*running.columns), "session_id").alias("s")).select("s.*")

    def create(self, user_id: str, search: Search, now_ms: int) -> int:
        """Start a session after expired ones are swept; BusyError if the user has one running."""
        if not user_id.strip():
            raise ValueError("a session needs a user")
        self.sweep(now_ms)
        # one change from looking to storing, so two users at once get two numbers, and one user at once one session
        change = self.store.change()
        rows = change.read_or_empty("sessions", SESSION)
        if running := rows.where((F.col("user_id") == user_id) & ~F.col("status").isin("done", "failed")).orderBy("session_id").first():
            raise BusyError(f"session {running['session_id']} is still running")
        session_id = (rows.agg(F.max("session_id")).first()[0] or 0) + 1
        row = (session_id, user_id, "evaluating", json.dumps(asdict(search.checked())), None, now_ms, now_ms, now_ms + V.SESSION_RETENTION_MS)
        change.upsert("sessions", self.store.spark.createDataFrame([row], SESSION), ["session_id"]).commit()
        return session_id

    def update(self, session_id: int, status: str, now_ms: int, error: str | None = None) -> None:
        if status not in V.SESSION_STATES:
            raise ValueError(f"unknown status {status}")
        row = self.get(session_id)
        if row is None:
            raise ValueError(f"no session {session_id}")
        self._put(tuple({**row, "status": status, "error": error, "updated_at_ms": now_ms}.values()))

    def save_results(self, session_id: int, results: DataFrame) -> None:
        """Replace the session's ranking (columns of :func:`ranking.run_session`)."""
        kept = settled(results.where(F.col("session_id") == session_id))
        self.store.replace_groups("session_results", kept, self.store.spark.createDataFrame([(session_id,)], "session_id int"), ["session_id"])

    def results(self, session_id: int) -> DataFrame:
        """The stored ranking, best first."""
        return self.store.read("session_results").where(F.col("session_id") == session_id).orderBy("rank")

    def sweep(self, now_ms: int) -> int:
        """Remove sessions that have expired, with their results; how many."""
        change = self.store.change()
        if not change.exists("sessions"):
            return 0
        expired = F.col("expires_at_ms") < now_ms
        gone = settled(change.read("sessions").where(expired).select("session_id"))
        n = change.delete("sessions", expired)
        if n and change.exists("session_results"):
            change.replace_groups("session_results", change.read("session_results").limit(0), gone, ["session_id"])
        change.commit()
        return n

    def run(self, session_id: int, postings: DataFrame, now_ms: Callable[[], int], research: Callable[[DataFrame], DataFrame] | None = None, **given: Any) -> DataFrame:
        """Go through a session's states: evaluate and score, research the best companies, score again with what is known, rank and store.

        ``research`` takes the best five companies (company) and gives intel by
        company_name_key. A failure is stored and raised.
        """
        try:
            search = Search(**json.loads(self.get(session_id)["request"]))
            self.update(session_id, "scoring", now_ms())
            made = settled(run_session(session_id, postings, search, **given))
            if research is not None:
                self.update(session_id, "researching", now_ms())
                best = made.where(F.col("rank") <= V.SESSION_INTEL_COMPANIES).where("company_name is not null").select(F.col("company_name").alias("company")).distinct()
                made = settled(run_session(session_id, postings, search, **{**given, "intel": settled(research(best))}))
            self.save_results(session_id, made)
            self.update(session_id, "done", now_ms())
            return self.results(session_id)
        except Exception as error:
            self.update(session_id, "failed", now_ms(), f"{type(error).__name__}: {error}"[:500])
            raise


def run_waiting(kept: Sessions, postings: Callable[[], DataFrame], now_ms: Callable[[], int], research: Callable[[DataFrame], DataFrame] | None = None, **given: Any) -> list[int]:
    """Run all sessions that wait, one after another in the order they were made, those made meanwhile too; their ids.

    A failed one is stored as failed and doesn't hold up the others.
    """
    done: list[int] = []
    while (row := kept.rows().where("status = 'evaluating'").orderBy("session_id").first()) is not None and row["session_id"] not in done:
        done.append(row["session_id"])
        try:
            kept.run(row["session_id"], postings(), now_ms, research, **given)
        except Exception:  # noqa: S112  (run has stored it)
            continue
    return done


def wait_until(settled_now: Callable[[], bool], budget: float = V.SESSION_INTEL_BUDGET_S, poll: float = V.SESSION_INTEL_POLL_S, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Ask again and again until it holds or the budget of seconds is spent; whether it came to hold."""
    end = clock() + budget
    while not settled_now():
        left = end - clock()
        if left <= 0:
            return False
        sleep(min(poll, left))
    return True


def search_of(request: Mapping[str, Any]) -> Search:
    """A checked search from a request's filters and place; ValueError names what is wrong."""
    filters, place = request.get("filters") or {}, request.get("search") or {}
    if not isinstance(filters, Mapping) or not isinstance(place, Mapping):
        raise ValueError("search and filters must be objects")

    def text(values: Mapping[str, Any], name: str) -> str | None:
        value = values.get(name)
        if value is not None and not isinstance(value, str):
            raise ValueError(f"{name} must be a text")
        return (value or "").strip() or None

    def number(name: str) -> float | None:
        value = filters.get(name)
        if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value < float("inf")):
            raise ValueError(f"{name} must be a number of at least 0")
        return value

    staffing = filters.get("staffing_acceptable", True)
    if not isinstance(staffing, bool):
        raise ValueError("staffing_acceptable must be true or false")
    for name in ("keywords", "country", "province", "field"):
        text(place, name)
    sources = place.get("enabled")
    if sources is not None and not (isinstance(sources, list) and all(isinstance(s, str) for s in sources)):
        raise ValueError("enabled must be a list of sources")
    return Search(filters.get("work_mode", "any"), number("salary_floor"), text(place, "city"), number("years"), text(filters, "skills_text"), staffing).checked()


def keywords_of(typed: str | None) -> dict[str, str | None]:
    """A search from one line of free text."""
    return {"keywords": (typed or "").strip() or None, **dict.fromkeys(("country", "province", "city", "field", "enabled"))}


def overrides_of(search: Mapping[str, Any]) -> dict[str, Any]:
    """What of a search replaces the stored ingest configuration: the fields that it sets."""
    names = {"keywords": "query", "country": "country", "province": "province", "city": "city", "field": "category", "enabled": "enabled"}
    return {names[k]: v for k, v in search.items() if k in names and v is not None}


def _chosen(answer: Column, table: Mapping[str, Any]) -> Column:
    pairs = [F.lit(x) for k, v in table.items() if v is not None for x in (k, float(v))]
    return F.element_at(F.create_map(*pairs), answer)


def work_mode(answer: Column) -> Column:
    return F.when(answer.isin(V.WORK_MODES), answer).otherwise("any")


def salary_floor(answer: Column) -> Column:
    """The floor that a choice stands for; null for any, and for what is no choice."""
    return _chosen(answer, V.SALARY_FLOORS)


def years(answer: Column) -> Column:
    """Years that stand for a range of experience."""
    return _chosen(answer, V.EXPERIENCE_YEARS)


def staffing_acceptable(answer: Column) -> Column:
    return ~answer.eqNullSafe(F.lit("exclude"))


def choice_of(value: Column, table: Mapping[str, Any]) -> Column:
    """The choice that stands for a value, 'any' for none."""
    pairs = [F.lit(x) for k, v in table.items() if v is not None for x in (float(v), k)]
    return F.coalesce(F.element_at(F.create_map(*pairs), value.cast("double")), F.lit("any"))


def language(locale: Column) -> Column:
    """fr for French locales, else en."""
    return F.when(F.lower(locale).startswith("fr"), "fr").otherwise("en")


def filled(template: Column, values: Mapping[str, Column]) -> Column:
    """``template`` with {name} replaced by values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def shortened(text: Column, most: int) -> Column:
    """``text`` or its beginning with an ellipsis, ``most`` characters in all."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def salary_line(low: Column, high: Column, currency: Column) -> Column:
    """Pay as it was published, with thousands separated; null if there is none."""
    shown = lambda x: F.regexp_replace(F.format_number(x, 3), r"\.?0+$", "")
    code = F.coalesce(currency, F.lit(""))
    both = F.concat(shown(low), F.lit("–"), shown(high))
    amount = F.when(low.isNotNull() & high.isNotNull(), both).when(low.isNotNull(), F.concat(shown(low), F.lit("+"))).when(high.isNotNull(), F.concat(F.lit("≤ "), shown(high)))
    return F.trim(F.concat(amount, F.lit(" "), code))


def flags_block(flags: Column, french: Column) -> Column:
    """A line for each flag, 320 characters in all; null without flags."""
    names = F.create_map(*[F.lit(x) for t, (en, fr) in V.FLAG_LABELS.items() for x in (t, en)])
    noms = F.create_map(*[F.lit(x) for t, (en, fr) in V.FLAG_LABELS.items() for x in (t, fr)])
    line = lambda f: F.concat(F.lit("⚠ "), F.coalesce(F.when(french, F.element_at(noms, f.type)).otherwise(F.element_at(names, f.type)), f.type), F.lit(" — "), shortened(f.explanation, 140))
    return F.when(F.size(flags) > 0, shortened(F.array_join(F.transform(flags, line), "\n"), 320))


def cards(results: DataFrame, locale: Column | None = None) -> DataFrame:
    """``results`` (of a session) with card_title and card_text: place, pay, scores, flags, evidence and research, 1,100 characters at most."""
    french = language(locale if locale is not None else F.lit(None).cast("string")) == "fr"
    label = lambda en, fr: F.when(french, fr).otherwise(en)
    for name, kind in (("intel_summary", "string"), ("intel_pending", "boolean")):
        results = results if name in results.columns else results.withColumn(name, F.lit(None).cast(kind))
    score = lambda c, en, fr: F.concat(label(en, fr), F.lit(" "), F.col(c).cast("string"))
    scores = F.concat_ws(" · ", F.concat(F.lit("★ "), score("combined", "overall", "global")), score("interview_chance", "chance", "chances"), score("job_quality", "quality", "qualité"))
    known = F.concat(label("Research: “", "Recherche : « "), shortened(F.col("intel_summary"), 280), label("”", " »"))
    intel = F.coalesce(known, F.when(F.col("intel_pending"), label("research under way", "recherche en cours")))
    blank = lambda c: F.nullif(c, F.lit(""))
    lines = [blank(F.concat_ws(" · ", blank(F.col("company_name")), blank(F.col("location_raw")))), salary_line(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency")), blank(scores), flags_block(F.col("flags"), french), shortened(F.col("top_evidence"), 280), intel]
    return results.withColumn("card_title", shortened(F.col("title"), V.CARD_TITLE)).withColumn("card_text", shortened(F.concat_ws("\n", *lines), V.CARD_TEXT))


def card_page(shown: DataFrame, number: int, footer: str = "") -> DataFrame:
    """The cards of a page, its number kept within the pages there are: page, page_count, and texts cut to fit 6,000 characters.

    Where a page is too long, all its texts get one limit that makes them fit, but never less than 200.
    """
    n = shown.count()  # a session's results: 25 at most
    pages = max(1, -(-n // PAGE_ROWS))
    number = min(max(0, number), pages - 1)
    rows = shown.where(F.col("rank").between(PAGE_ROWS * number + 1, PAGE_ROWS * (number + 1)))
    fixed = len(footer) + sum(r[0] for r in rows.select(F.length("card_title")).collect())
    lengths = [r[0] for r in rows.select(F.length("card_text")).collect()]
    limit = next((m for m in range(V.CARD_TEXT, V.CARD_TEXT_LEAST, -1) if fixed + sum(min(x, m) for x in lengths) <= V.PAGE_TEXT), V.CARD_TEXT_LEAST)
    return rows.withColumn("card_text", shortened(F.col("card_text"), limit)).withColumn("page", F.lit(number)).withColumn("page_count", F.lit(pages))


def card_characters(*parts: Column) -> Column:
    """How many characters a card counts for."""
    return sum((F.coalesce(F.length(p), F.lit(0)) for p in parts), F.lit(0))


def ranked_results(rows: DataFrame) -> DataFrame:
    """:func:`ranking.ranked` rows with the page that each stands on."""
    return ranked(rows).withColumn("page", bound(F.col("rank"), lambda r: F.floor((r - 1) / PAGE_ROWS).cast("int")))
