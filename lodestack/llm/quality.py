"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger row keeps the measurements
and one failure bit per rule; policies are versioned masks over those bits, so
applying another policy, or asking what a policy would keep without one of its
rules, reads the ledger and never the texts.

Words are runs of characters other than space and U+0009 to U+000D. Defined
cases: a null text has no words and fails ``too_few_words``, as an empty one
does; an empty table gives an empty ledger and ablations of 0; repeated rows are
judged one by one; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails()`` holds over the measurements' columns."""

    name: str
    bit: int
    fails: Callable[[], Column]

    @property
    def mask(self) -> int:
        return 1 << self.bit


#: Bits are never given to another rule, so that old ledgers stay readable.
RULES = (
    Rule("too_few_words", 0, lambda: F.col("n_words") < 20),
    Rule("repeated_windows", 1, lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule("symbol_heavy", 2, lambda: 100 * F.col("n_symbols") > 25 * F.col("n_words")),
    Rule("duplicate_lines", 3, lambda: (F.col("n_lines") >= 4) & (100 * F.col("n_dup_lines") > 50 * F.col("n_lines"))),
    Rule("word_length", 4, lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("shouting", 5, lambda: (F.col("n_upper") > F.col("n_lower")) & (F.col("n_upper") >= 20)),
    Rule("exclamations", 6, lambda: 100 * F.col("n_exclamations") > 25 * F.col("n_words")),
)
MASKS = {r.name: r.mask for r in RULES}


def mask_of(names: Iterable[str]) -> int:
    return sum(MASKS[n] for n in set(names))


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules that a kept document passes."""

    name: str
    version: int
    mask: int


BASE = Policy("base", 1, mask_of(["too_few_words", "repeated_windows"]))
POLICIES = (
    BASE,
    Policy("web", 1, BASE.mask | mask_of(["symbol_heavy", "word_length"])),
    Policy("web", 2, mask_of(MASKS)),
)
CURRENT = POLICIES[-1]


def _only(text: Column, characters: str) -> Column:
    """How many characters of the class ``characters`` a text has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, though ``use`` reads it in inner functions."""
    return F.transform(F.array(value), use)[0]


def _windows(words: Column) -> Column:
    """A hash of each run of ``WINDOW`` words, in order."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    return F.when(F.size(words) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<long>"))


def _covered(windows: Column) -> Column:
    """How many words lie in windows whose hash occurs again in ``windows``."""

    def starts(ordered: Column) -> Column:
        again = lambda x, k: (x.h == F.get(ordered, k - 1).h) | (x.h == F.get(ordered, k + 1).h)
        return F.sort_array(F.transform(F.filter(ordered, lambda x, k: F.coalesce(again(x, k), F.lit(False))), lambda x: x.i))

    def total(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _bound(ordered, lambda o: _bound(starts(o), total))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _windows(w).alias("windows"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    repeats = _bound(F.col("w.windows"), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _bound(words, of_words).alias("w"),
        _bound(lines, of_lines).alias("l"),
        _only(text, SYMBOLS).alias("n_symbols"),
        _only(text, "A-Z").alias("n_upper"),
        _only(text, "a-z").alias("n_lower"),
        _only(text, "!").alias("n_exclamations"),
    ).select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", repeats.alias("n_repeat_words"), "n_upper", "n_lower", "n_exclamations")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``fail_bits`` (bigint) of every document."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(rule.mask)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("fail_bits", bits)


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(ledger_rows: DataFrame, policies: Iterable[Policy] = POLICIES) -> DataFrame:
    """Per policy and rule left out of it: documents kept with and without the rule.

    One aggregation over the ledger, whatever the number of policies and rules.
    """
    cases = [(p, r) for p in policies for r in RULES if p.mask & r.mask]
    kept = lambda mask: F.count_if(F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0)
    row = ledger_rows.agg(*[
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r.name).alias("without_rule"), kept(p.mask).alias("kept"), kept(p.mask & ~r.mask).alias("kept_without")).alias(f"c{i}")
        for i, (p, r) in enumerate(cases)
    ])
    return row.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cases))])))
