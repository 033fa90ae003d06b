"""How filters interact: every order of applying them, visited by adjacent transpositions.

Each document is judged once by every filter; what an order of the filters does
depends only on how many documents fail which set of filters, so a part of the
corpus is told by its *cells*: for each set of failed filters (a bit mask) the
number of documents, and of those that carry a mark (good, toxic). There are at
most 2^k cells a part, however many documents it has.

:func:`walk` visits all k! orders so that each differs from the one before by one
swap of neighbours (plain changes). The filters before the swapped pair and those
after it meet the same documents as before, so only the pair's two steps are
counted anew, from the cells. A filter's removed documents are added to its
Shapley sum along the walk: what a filter removes stays as it is over the orders
in which it doesn't take part in a swap, and is added for all of them at once.

The cells are made by Spark: documents are judged in one projection, copies are
found by a digest of the text, and every shuffle comes after partial sums, so that
neither a text that a third of all documents share nor an id that a third of all
rows have reaches one task row by row. Only cells, at most 2^k a part, meet in the
walk's task of that part.

Defined cases: a null text is an empty one, a null part the empty string; an empty
table gives no rows; repeated rows count once each, and rows of equal id and text
are not each other's copies; a row without an id counts as later than every id and
has no marks; of several labels of one id any that sets a mark counts, and labels
of no document don't; very long texts are judged whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import prepare

SPACES = r"[\x20\x09-\x0D]+"
#: Later than every id.
LAST = 2**63 - 1


@dataclass(frozen=True)
class Filter:
    """A filter by its letter; ``fails`` says of a text (never null) whether it fails, None stands for copies of an earlier text."""

    letter: str
    fails: Callable[[Column], Column] | None


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


#: The filters of the registered query.
FILTERS = (
    Filter("A", lambda text: F.size(words(text)) < 100),
    Filter("B", lambda text: 100 * F.size(F.array_distinct(words(text))) < 80 * F.size(words(text))),
    Filter("C", lambda text: 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long")),
    Filter("D", lambda text: text.rlike(r"[#$%&*|]")),
    Filter("E", None),
)


def plain_changes(size: int) -> Iterator[int | None]:
    """The places at which to swap neighbours, one after another, to visit all orders of ``size`` things; None for the first order.

    The largest thing travels through an order of the others from one end to the
    other; each time it arrives, the others make one change of their own.
    """
    yield None
    if size < 2:
        return
    at_end, inner = True, plain_changes(size - 1)
    next(inner)
    while True:
        yield from range(size - 2, -1, -1) if at_end else range(size - 1)
        at_end = not at_end
        change = next(inner, None)
        if change is None:
            return
        # the travelling thing stands at the left end, before the others, or at the right end, after them
        yield change if at_end else change + 1


def walk(cells: np.ndarray, letters: str) -> tuple[list[tuple[str, np.ndarray]], np.ndarray]:
    """All orders of the filters with their steps, and the Shapley sums.

    ``cells[mask, m]``: documents failing exactly the filters of ``mask`` (bit f for
    letters[f]); m = 0 counts all, the further ones those with a mark. An order's
    steps are an array of (place, m) removed documents.
    """
    size = len(letters)
    masks = np.arange(1 << size)
    order = list(range(size))
    removed = np.zeros((size, cells.shape[1]), dtype=np.int64)
    shapley, since = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)

    def count(place: int) -> None:
        before = sum(1 << f for f in order[:place])
        hit = (masks >> order[place] & 1).astype(bool) & (masks & before == 0)
        removed[place] = cells[hit].sum(axis=0)

    def settle(place: int, visited: int) -> None:
        """Add what the filter at ``place`` removed over the orders since it last moved."""
        f = order[place]
        shapley[f] += removed[place, 0] * (visited - since[f])
        since[f] = visited

    orders = []
    for visited, at in enumerate(plain_changes(size)):
        if at is None:
            for place in range(size):
                count(place)
        else:
            settle(at, visited)
            settle(at + 1, visited)
            order[at], order[at + 1] = order[at + 1], order[at]
            count(at)
            count(at + 1)
        orders.append(("".join(letters[f] for f in order), removed.copy()))
    for place in range(size):
        settle(place, len(orders))
    return orders, shapley


def _walker(letters: str, marks: Sequence[str]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        size = len(letters)
        masks = np.arange(1 << size)
        cells = np.zeros((1 << size, 1 + len(marks)), dtype=np.int64)
        at = table.column("mask").to_numpy()
        for m, name in enumerate(("n", *marks)):
            np.add.at(cells[:, m], at, table.column(name).to_numpy())
        orders, shapley = walk(cells, letters)
        failing = [int(cells[(masks >> f & 1).astype(bool), 0].sum()) for f in range(size)]
        alone = [int(cells[1 << f, 0]) for f in range(size)]
        part, rows = table.column("part")[0].as_py(), []
        for order, steps in orders:
            kept = int(cells[:, 0].sum())
            for place, letter in enumerate(order):
                f, gone = letters.index(letter), steps[place].tolist()
                kept -= gone[0]
                rows.append((part, order, place + 1, kept, gone[0], failing[f] - gone[0], alone[f], *gone[1:], int(shapley[f])))
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (5 + len(marks))]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_names(marks))

    return run


def _names(marks: Sequence[str]) -> list[str]:
    return ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley"]


def interactions(cells: DataFrame, letters: str, marks: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of the filters and step, from ``cells`` (part, mask, n and a count per mark)."""
    kinds = ["string", "string", "int", *["long"] * (5 + len(marks))]
    schema = ", ".join(f"{n} {k}" for n, k in zip(_names(marks), kinds))
    return cells.groupBy("part").applyInArrow(_walker(letters, marks), schema)


def _marked(labels: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """label_id and a flag per mark, one row for each id that has any."""
    flags = labels.select(F.col("doc_id").cast("long").alias("label_id"), *[F.coalesce(c, F.lit(False)).alias(m) for m, c in marks.items()])
    any_of = F.array_contains(F.array(*[F.col(m) for m in marks]), True)
    return flags.where(F.col("label_id").isNotNull() & any_of).groupBy("label_id").agg(*[F.max(m).alias(m) for m in marks])


def count_cells(docs: DataFrame, labels: DataFrame | None, marks: dict[str, Column], filters: Sequence[Filter] = FILTERS, part: str = "lang") -> DataFrame:
    """part, mask, n and a count per mark: the documents (doc_id, text and ``part``) by the filters they fail.

    ``marks`` are conditions on ``labels`` (doc_id and what they read).
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    bit = {f.letter: 1 << i for i, f in enumerate(filters)}
    own = [F.when(f.fails(text), bit[f.letter]).otherwise(0) for f in filters if f.fails]
    copies = [f for f in filters if not f.fails]
    judged = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        sum(own, F.lit(0)).alias("mask"),
        (F.unhex(F.sha2(text.cast("binary"), 256)) if copies else F.lit(None).cast("binary")).alias("digest"),
    )
    # rows of one id and text first, so that a repeated row weighs nothing from here on
    once = judged.groupBy("at", "digest", "part", "mask").agg(F.count("*").alias("n"))
    names = list(marks)
    if labels is not None and marks:
        once = once.join(_marked(labels, marks), F.col("at") == F.col("label_id"), "left")
        once = once.select("at", "digest", "part", "mask", "n", *[F.coalesce(m, F.lit(False)).alias(m) for m in names])
    else:
        once = once.select("at", "digest", "part", "mask", "n", *[F.lit(False).alias(m) for m in names])
    sums = [F.sum(F.when(F.col(m), F.col("n")).otherwise(0)).alias(m) for m in names]
    if not copies:
        return once.groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)
    # the rows of one text, part and marks: how many, and the smallest id with its rows
    alike = once.groupBy("digest", "part", "mask", *names).agg(F.sum("n").alias("n"), F.min(F.struct("at", "n")).alias("first"))
    # the same over all parts and marks: the smallest id of the text
    texts = alike.groupBy("digest", "mask").agg(F.min("first.at").alias("least"), F.collect_list(F.struct("part", "n", "first", *names)).alias("rows"))
    r = F.col("r")
    firsts = F.when(r["first"]["at"] == F.col("least"), r["first"]["n"]).otherwise(0)
    flagged = bit[copies[0].letter]
    split = texts.select("mask", "least", F.explode("rows").alias("r")).select(
        r["part"].alias("part"),
        *[r[m].alias(m) for m in names],
        F.explode(F.array(F.struct(F.col("mask").alias("mask"), firsts.alias("n")), F.struct((F.col("mask") + flagged).alias("mask"), (r["n"] - firsts).alias("n")))).alias("c"),
    )
    cells = split.select("part", "c.mask", "c.n", *names)
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def audit(docs: DataFrame, labels: DataFrame | None, marks: dict[str, Column], filters: Sequence[Filter] = FILTERS, part: str = "lang") -> DataFrame:
    """All orders of ``filters`` over each part of ``docs``: part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost, shapley."""
    if sum(f.fails is None for f in filters) > 1:
        raise ValueError("one filter of copies at most")
    return interactions(count_cells(docs, labels, marks, filters, part), "".join(f.letter for f in filters), list(marks))
