"""Personal data by patterns and by information-theoretic sanitisation, in DataFrame functions only.

Patterns give the base spans: e-mail addresses, IPv4 addresses, card numbers and
phone numbers. Terms of the same documents may reveal them as well. For a term
``t`` and a protected entity ``e`` (the value of a base span) the corpus gives

* ``joint``: documents that hold both, wherever and however often they stand, and
  ``df``: documents of the whole corpus that hold ``t``,
* ``support``: distinct surroundings of ``e`` in the documents that hold both,
  one of each document, so that copies of a passage count once,
* the disclosure ``P(e | t) = joint / df`` and the information
  ``log2(P(e | t) / P(e))`` that reading ``t`` gives about ``e``.

Terms with enough support whose disclosure and information exceed the thresholds
are removed wherever they stand, in documents without the entity as well, as
spans of kind ``term``; :func:`sanitise` generalises every span to its kind's
name. Base spans always stay. A term is a run of letters of any length, so names
inside unspaced scripts are found only where something else stands around them.

Defined cases: a null text counts as empty and stays null when sanitised; an
empty table gives no rows; repeated rows get the same spans each; null ids are
carried; of spans that begin together the one whose kind is listed first gives
the name; parts of very long texts are found in chunks; columns other than doc_id
and text pass through :func:`sanitise` untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import free_name, prepare, small_side

KINDS = ("email", "ip", "card", "phone")
#: What Java matches as the plain patterns do, without backtracking into long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the kind's pattern.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"(?<![\p{L}\p{M}\p{N}_])\p{L}[\p{L}\p{M}]*+(?![\p{N}_])"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
BLOCK = 256
#: Characters of a long text's chunks.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Thresholds:
    """When a term discloses an entity; ``reach`` terms within ``window`` characters on each side are an entity's surroundings."""

    support: int = 3
    probability: float = 0.5
    bits: float = 3.0
    reach: int = 4
    window: int = 80


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, though ``use`` reads it in inner functions."""
    return F.transform(F.array(value), use)[0]


def _running(lengths: Column) -> Column:
    """Sum of all earlier lengths, for each; in blocks, so that it stays near linear."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def by_block(sums: Column) -> Column:
        before = lambda k: add(F.slice(sums, F.lit(1), k))
        return F.transform(F.sequence(F.lit(0), F.size(sums) - 1), before)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: add(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    place = lambda firsts: F.transform(
        lengths, lambda x, i: F.get(firsts, F.floor(i / BLOCK).cast("int")) + add(F.slice(lengths, (F.floor(i / BLOCK) * BLOCK).cast("int") + 1, i % BLOCK))
    )
    return _bound(_bound(blocks, by_block), place)


def _running_max(ends: Column) -> Column:
    """Largest of all earlier ends, for each, 0 for the first; in blocks as well."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ends) - 1) / BLOCK).cast("int")), lambda b: F.array_max(F.slice(ends, b * BLOCK + 1, F.lit(BLOCK))))

    def by_block(most: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(most) - 1), lambda k: F.coalesce(F.array_max(F.slice(most, F.lit(1), k)), F.lit(0)))

    place = lambda firsts: F.transform(
        ends, lambda x, i: F.greatest(F.get(firsts, F.floor(i / BLOCK).cast("int")), F.array_max(F.slice(ends, (F.floor(i / BLOCK) * BLOCK).cast("int") + 1, i % BLOCK)))
    )
    return _bound(_bound(blocks, by_block), place)


def _chunked(text: Column, use) -> Column:
    """``use(piece)`` with ``piece(start, length)`` of ``text``; a part is found from its chunk's start, not from the text's."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda c: F.substr(text, c * CHUNK + 1, F.lit(CHUNK)))

    def piece_of(held: Column):
        def piece(start: Column, length: Column) -> Column:
            inside = start % CHUNK + length <= CHUNK
            return F.when(inside, F.substr(F.get(held, F.floor(start / CHUNK).cast("int")), start % CHUNK + 1, length)).otherwise(F.substr(text, start + 1, length))

        return piece

    return _bound(chunks, lambda held: use(piece_of(held)))


def found(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as spans in code points.

    The gaps between matches and the matches, taken in turn, are the text, so
    lengths give places.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(both: Column) -> Column:
        sizes = F.transform(both.hits, lambda h, i: F.get(both.gaps, i) + F.length(h))
        starts = _bound(sizes, _running)
        return _bound(starts, lambda s: F.transform(both.hits, lambda h, i: _span(F.get(s, i) + F.get(both.gaps, i), kind, h)))

    return F.when(F.size(hits) > 0, _bound(F.struct(gaps.alias("gaps"), hits.alias("hits")), place)).otherwise(F.array().cast(SPAN))


def _span(start: Column, kind: int, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), (start + F.length(value)).cast("int").alias("end"), value.alias("value"))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum: every second digit from the right counts double."""
    size = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, size - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(F.lit(False))
        return F.forall(F.split(value, r"\."), lambda p: small(F.regexp_replace(p, "^0+", "")))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda s: _holds(kind, s.value)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    parts = []
    for k, kind in enumerate(KINDS):
        spans = found(text, PATTERNS[kind], k)
        spans = spans if kind == "email" else F.filter(spans, _test(kind))
        parts.append(F.when(text.rlike(GUARDS[kind]), spans).otherwise(F.array().cast(SPAN)))
    return F.sort_array(F.concat(*parts))


def _surroundings(text: Column, spans: Column, t: Thresholds) -> Column:
    """Each distinct entity of the base spans, with the smallest hash of the terms beside one of its spans: struct(entity, context)."""

    def beside(s: Column, piece) -> Column:
        low = F.greatest(F.lit(0), s.start - t.window)
        left, right = piece(low, s.start - low), piece(s.end, F.least(F.lit(t.window), F.length(text) - s.end))
        # a window may cut a word: what touches its outer edge doesn't count
        cut_left = lambda w: (low > 0) & (w.start == 0)
        cut_right = lambda w: (F.length(right) == t.window) & (w.end == t.window)
        before = F.slice(F.reverse(F.filter(found(left, TERM, 0), lambda w: ~cut_left(w))), 1, t.reach)
        after = F.slice(F.filter(found(right, TERM, 0), lambda w: ~cut_right(w)), 1, t.reach)
        entity = F.concat_ws(":", s.kind.cast("string"), F.lower(s.value))
        return F.struct(entity.alias("entity"), F.xxhash64(entity, F.transform(F.concat(before, after), lambda w: F.lower(w.value))).alias("context"))

    def first_of_each(held: Column) -> Column:
        return F.filter(held, lambda h, i: (i == 0) | (h.entity != F.get(held, i - 1).entity))

    return _bound(F.sort_array(_chunked(text, lambda piece: F.transform(spans, lambda s: beside(s, piece)))), first_of_each)


def _key() -> Column:
    """What tells rows of different ids or texts apart with certainty."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256))


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)))


def scan(docs: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """row_key, doc_id, base (spans) and held (their entities and surroundings) of every row; cut off from its lineage."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    held = lambda spans: F.when(F.size(spans) > 0, _surroundings(text, spans, thresholds)).otherwise(F.array().cast("array<struct<entity:string,context:bigint>>"))
    return docs.select(
        _key().alias("row_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        _bound(base_spans(text), lambda spans: F.struct(spans.alias("base"), held(spans).alias("held"))).alias("s"),
    ).select("row_key", "doc_id", "s.base", "s.held").checkpoint()


def disclosures(docs: DataFrame, scanned: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """(term, entity) pairs of the corpus that exceed the thresholds, with their figures.

    A pair's support is at most its entity's, so documents are read for terms
    only where they hold an entity of enough surroundings.
    """
    spark = docs.sparkSession
    # a row holds an entity once, however often it stands there
    held = scanned.where(F.size("held") > 0).select("row_key", F.explode("held").alias("h")).select("row_key", "h.entity", "h.context")
    entities = held.groupBy("entity").agg(F.countDistinct("context").alias("contexts"), F.count("*").alias("entity_docs")).where(F.col("contexts") >= thresholds.support).select("entity", "entity_docs").checkpoint()
    n_entities = entities.count()
    if not n_entities:
        return spark.createDataFrame([], "term string, entity string, support long, joint long, df long, disclosure double, bits double")
    kept = held.join(small_side(entities, n_entities), "entity").select("row_key", "entity", "context").distinct()
    kept = kept.groupBy("row_key").agg(F.collect_list(F.struct("entity", "context")).alias("held")).checkpoint()
    rows = docs.select(_key().alias("row_key"), "text").join(small_side(kept, kept.count()), "row_key")
    terms = rows.select("held", F.explode(_words(F.col("text"))).alias("term"))
    # a term is in at most as many of these documents as anywhere, so this bound drops
    # the terms of many entities before the whole corpus is counted
    within = terms.groupBy("term").agg(F.count("*").alias("within"))
    pairs = (
        terms.select("term", F.explode("held").alias("h"))
        .groupBy("term", "h.entity", "h.context")
        .agg(F.count("*").alias("n"))
        .groupBy("term", "entity")
        .agg(F.count("*").alias("support"), F.sum("n").alias("joint"))
        .where(F.col("support") >= thresholds.support)
        .join(within, "term")
        .where(F.col("joint") >= thresholds.probability * F.col("within"))
        .drop("within")
        .checkpoint()
    )
    terms = pairs.select("term").distinct()
    n_terms, n_docs = terms.count(), docs.count()
    df = docs.select(F.explode(_words(F.col("text"))).alias("term")).join(small_side(terms, n_terms), "term", "left_semi") if n_terms else spark.createDataFrame([], "term string")
    df = df.groupBy("term").agg(F.count("*").alias("df"))
    counted = (F.col("support") <= F.col("joint")) & (F.col("joint") <= F.col("df")) & (F.col("joint") <= F.col("entity_docs"))
    share = F.when(counted, F.col("joint") / F.col("df")).otherwise(F.raise_error(F.lit("documents of a term and an entity are not counted alike")).cast("double"))
    return (
        pairs.join(df, "term")
        .join(entities, "entity")
        .withColumn("disclosure", share)
        .withColumn("bits", F.log2(share * n_docs / F.col("entity_docs")))
        .where((F.col("disclosure") >= thresholds.probability) & (F.col("bits") >= thresholds.bits))
    )


def detect(docs: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """row_key, doc_id, base and terms (disclosing terms' spans) of every row of ``docs``.

    Repeated rows are given once each.
    """
    scanned = scan(docs, thresholds)
    told = disclosures(docs, scanned, thresholds).select("term").distinct().checkpoint()
    n_told = told.count()
    none = F.array().cast(SPAN)
    if not n_told:
        return scanned.drop("held").withColumn("terms", none)
    keyed = docs.select(_key().alias("row_key"), "text")
    held = keyed.select("row_key", F.explode(_words(F.col("text"))).alias("term")).join(small_side(told, n_told), "term", "left_semi")
    held = held.groupBy("row_key").agg(F.collect_set("term").alias("told")).checkpoint()
    lowered = lambda w: F.struct(w.start.alias("start"), w.kind.alias("kind"), w.end.alias("end"), F.lower(w.value).alias("value"))
    hits = F.filter(F.transform(found(F.col("text"), TERM, len(KINDS)), lowered), lambda w: F.array_contains("told", w.value))
    spans = keyed.join(small_side(held, held.count()), "row_key").dropDuplicates(["row_key"]).select("row_key", hits.alias("hits"))
    free = lambda w: ~F.exists("base", lambda b: (b.start < w.end) & (w.start < b.end))
    return scanned.drop("held").join(spans, "row_key", "left").withColumn("terms", F.coalesce(F.filter("hits", free), none)).drop("hits")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def generalise(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans replaced by the first one's kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])

    def pieces(all_spans: Column) -> Column:
        after = _running_max(F.transform(all_spans, lambda s: s.end))

        def written(ends: Column, piece) -> Column:
            write = lambda s, i: F.when(s.start >= F.get(ends, i), F.concat(piece(F.get(ends, i), s.start - F.get(ends, i)), F.get(names, s.kind))).otherwise(F.lit(""))
            last = F.array_max(F.transform(all_spans, lambda s: s.end))
            return F.concat(F.array_join(F.transform(all_spans, write), ""), F.substr(text, last + 1, F.length(text)))

        return _chunked(text, lambda piece: _bound(after, lambda ends: written(ends, piece)))

    return F.when(F.size(spans) > 0, _bound(spans, pieces)).otherwise(text)


def sanitise(docs: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """``docs`` with personal data and disclosing terms generalised in ``text``."""
    key, held = (free_name(docs, n) for n in ("row_key", "spans"))
    spans = (
        detect(docs, thresholds)
        .select(F.col("row_key").alias(key), F.sort_array(F.concat("base", "terms")).alias(held))
        .where(F.size(held) > 0)
        .dropDuplicates([key])
        .checkpoint()
    )
    keyed = docs.join(small_side(spans, spans.count()), F.col(key) == _key(), "left")
    text = F.when(F.col(held).isNotNull(), generalise(F.col("text"), F.col(held))).otherwise(F.col("text"))
    return keyed.withColumn("text", text).select(docs.columns)
