"""Many phrases looked for in one pass over each text.

All phrases of all lists make one Aho-Corasick automaton, built once per worker
process. A text goes through it once, whatever the number of phrases, in Arrow
batches; only the numbers of the phrases that occur come back, and the rest is
column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lodestack.functions.text import computed_once, lowered
from lodestack.storage import ready

_automata: dict[tuple[str, ...], object] = {}


def automaton(phrases: tuple[str, ...]):
    """The automaton of these phrases, whose values are their numbers; kept in this process."""
    if phrases not in _automata:
        import ahocorasick

        numbers: dict[str, list[int]] = {}
        for number, phrase in enumerate(phrases):
            numbers.setdefault(phrase, []).append(number)
        made = ahocorasick.Automaton()
        for phrase, own in numbers.items():
            made.add_word(phrase, tuple(own))
        made.make_automaton()
        if len(_automata) > 16:
            _automata.clear()
        _automata[phrases] = made
    return _automata[phrases]


def occurring(text: str, phrases: tuple[str, ...]) -> list[int]:
    """Numbers of the phrases that occur in ``text``, each once, in order."""
    found: set[int] = set()
    for _, numbers in automaton(phrases).iter(text):
        found.update(numbers)
    return sorted(found)


def phrase_numbers(low: Column, phrases: Sequence[str]) -> Column:
    """Numbers of the phrases that occur in a text of :func:`text.lowered`; phrases are looked for in lower case."""
    wanted = tuple(p.lower() for p in phrases)

    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([occurring(t, wanted) for t in texts], dtype=object)

    # said to be nondeterministic, so that the optimiser doesn't copy the search to each place where its result is used
    return F.pandas_udf(search, ArrayType(IntegerType())).asNondeterministic()(low)


def with_hits(rows: DataFrame, text: Column, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """``rows`` with a column for each of ``lists``: its phrases that occur in ``text``, in the list's order; never null."""
    lists = {name: list(phrases) for name, phrases in lists.items()}
    every = [p for phrases in lists.values() for p in phrases]
    if not every:
        return rows.withColumns({name: F.array().cast("array<string>") for name in lists})
    ready(rows.sparkSession)
    # Spark fails to hand an expression with lambdas in it to Python, so the text is a column of its own
    own = rows.withColumn("__low", computed_once(lowered(text)))
    searched = own.withColumn("__numbers", phrase_numbers(F.col("__low"), every)).drop("__low")
    made, at = {}, 0
    for name, phrases in lists.items():
        made[name] = _own(F.col("__numbers"), phrases, at)
        at += len(phrases)
    return searched.withColumns(made).drop("__numbers")


def _own(numbers: Column, phrases: list[str], first: int) -> Column:
    """Those phrases of one list whose numbers, counted from ``first``, are there."""
    if not phrases:
        return F.array().cast("array<string>")
    own = F.filter(numbers, lambda n: (n >= first) & (n < first + len(phrases)))
    return F.transform(own, lambda n: F.get(F.array(*map(F.lit, phrases)), n - first))
