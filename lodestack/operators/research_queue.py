"""Company research, one company at a time: who runs, who waits, and what failed.

A queue is a small state that its events change one after another: companies ask
to be researched, and the running one ends well or badly. A company that asks again
while it waits keeps its place, and its run uses the review interface if any of the
requests opted in. What failed is remembered until the company asks again or is
researched well.

Many queues run side by side: :func:`replay` steps through the events of a table,
queue by queue, with one queue's state in memory; :func:`track` does the same on a
stream, with the state kept by Spark; :class:`StoredQueue` is one queue in a store,
for requests that come by themselves.

Events have queue, at (any order within a queue; ties by seq), seq, kind ('ask',
'done' or 'failed'), company, use_reviews and error. A company without a name asks
for nothing; an end without a running company, and an unknown kind, change nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestack.functions.text import company_name_key, redact_urls
from lodestack.sources.store import TableStore

EVENT = "queue string, at bigint, seq bigint, kind string, company string, use_reviews boolean, error string"
STEP = "queue string, at bigint, seq bigint, kind string, state string, active string, active_reviews boolean, waiting int, failed int"
QUEUE = "queue string, state string"


class QueueState:
    """The state of one queue; companies by key, as (key, name, whether to use reviews)."""

    def __init__(self, text: str | None = None) -> None:
        held = json.loads(text) if text else {}
        self.active: list[Any] | None = held.get("active")
        self.waiting: list[list[Any]] = held.get("waiting", [])
        self.failures: dict[str, str] = held.get("failures", {})

    def text(self) -> str:
        return json.dumps({"active": self.active, "waiting": self.waiting, "failures": self.failures})

    def ask(self, key: str | None, name: str, use_reviews: bool = False) -> str:
        """What the company's state is then: 'researching' or 'queued'."""
        if not key:
            return "queued"
        self.failures.pop(key, None)
        if self.active and self.active[0] == key:
            return "researching"
        for held in self.waiting:
            if held[0] == key:
                held[2] = held[2] or use_reviews
                return "queued"
        if self.active:
            self.waiting.append([key, name, use_reviews])
            return "queued"
        self.active = [key, name, use_reviews]
        return "researching"

    def end(self, error: str | None = None) -> None:
        """The running research is over, with an error or without; the next one starts."""
        if not self.active:
            return
        self.failures.pop(self.active[0], None)
        if error is not None:
            self.failures[self.active[0]] = error
        self.active = self.waiting.pop(0) if self.waiting else None

    def status(self, key: str) -> str | None:
        if self.active and self.active[0] == key:
            return "researching"
        if any(held[0] == key for held in self.waiting):
            return "queued"
        return "failed" if key in self.failures else None


def _stepped(state: QueueState, events: Iterable[tuple]) -> Iterator[tuple]:
    """Each event (queue, at, seq, kind, key, company, use_reviews, error) with what it left (see STEP)."""
    for queue, at, seq, kind, key, company, use_reviews, error in events:
        told = None
        if kind == "ask":
            told = state.ask(key, company, bool(use_reviews))
        elif kind in ("done", "failed"):
            state.end((error or "unknown") if kind == "failed" else None)
        active = state.active or [None, None, None]
        yield queue, at, seq, kind, told, active[0], active[2], len(state.waiting), len(state.failures)


_COLUMNS = ["queue", "at", "seq", "kind", "key", "company", "use_reviews", "error"]
_STEPS = [c.split()[0] for c in STEP.split(", ")]


def _keyed(events: DataFrame) -> DataFrame:
    rows = events.withColumns({"key": company_name_key(F.col("company")), "company": F.trim("company"), "error": redact_urls(F.col("error")), "use_reviews": F.coalesce("use_reviews", F.lit(False))})
    return rows.select(_COLUMNS)


def _tuples(frame: pd.DataFrame) -> Iterator[tuple]:
    plain = frame.astype(object).where(frame.notna(), None)
    return plain[_COLUMNS].itertuples(index=False, name=None)


def replay(events: DataFrame) -> DataFrame:
    """Every event of a table of events with its queue's state after it.

    Queues are dealt over tasks and come to a task in order, so a task holds one
    queue's state and a batch of events.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, state = None, QueueState()
        for frame in frames:
            rows = []
            for event in _tuples(frame):
                if event[0] != queue:
                    queue, state = event[0], QueueState()
                rows += _stepped(state, [event])
            yield pd.DataFrame(rows, columns=_STEPS)

    return _keyed(events).repartition("queue").sortWithinPartitions("queue", "at", "seq").mapInPandas(run, STEP)


def track(events: DataFrame) -> DataFrame:
    """The same over a stream; the events of a micro-batch are put in order, and come after those of earlier ones."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = QueueState(state.get[0] if state.exists else None)
        every = pd.concat(list(frames)).sort_values(["at", "seq"])
        made = pd.DataFrame(list(_stepped(held, _tuples(every))), columns=_STEPS)
        state.update((held.text(),))
        yield made

    return _keyed(events).groupBy("queue").applyInPandasWithState(run, STEP, "state string", "append", GroupStateTimeout.NoTimeout)


class StoredQueue:
    """One queue in the store's table ``research_queues``."""

    def __init__(self, store: TableStore, queue: str = "companies") -> None:
        self.store, self.queue = store, queue

    def _key(self, company: str) -> str:
        return self.store.spark.createDataFrame([(company,)], "c string").select(company_name_key(F.col("c"))).first()[0]

    def state(self) -> QueueState:
        row = self.store.read_or_empty("research_queues", QUEUE).where(F.col("queue") == self.queue).first()
        return QueueState(row["state"] if row else None)

    def _change(self, use: Callable[[QueueState], Any]) -> Any:
        """``use`` of the state, stored in one change; of two at once the second fails with a ConflictError."""
        change = self.store.change()
        row = change.read_or_empty("research_queues", QUEUE).where(F.col("queue") == self.queue).first()
        state = QueueState(row["state"] if row else None)
        told = use(state)
        change.upsert("research_queues", self.store.spark.createDataFrame([(self.queue, state.text())], QUEUE), ["queue"]).commit()
        return told

    def ask(self, company: str, use_reviews: bool = False) -> str:
        key = self._key(company)
        return self._change(lambda s: s.ask(key, company.strip(), use_reviews))

    def status(self, company: str) -> str | None:
        return self.state().status(self._key(company))

    def failure(self, company: str) -> str | None:
        return self.state().failures.get(self._key(company))

    def run(self, research: Callable[[str, bool], object]) -> int:
        """Research company after company until none waits; how many. A failure is remembered, without secrets in URLs."""
        done = 0
        while (running := self.state().active) is not None:
            error = None
            try:
                research(running[1], running[2])
            except Exception as failure:
                told = self.store.spark.createDataFrame([(str(failure) or type(failure).__name__,)], "e string")
                error = told.select(redact_urls(F.col("e"))).first()[0]
            self._change(lambda s, error=error: s.end(error))
            done += 1
        return done
