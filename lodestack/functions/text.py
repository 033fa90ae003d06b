"""Column expressions over texts of postings. All are null-safe unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestack.functions import vocabulary as V

#: What counts as white space in postings: Java's class and the Unicode spaces.
SPACE = r"[\s\x0B   -     　﻿]"
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: A border between a word character and another one, ASCII only.
BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def computed_once(value: Column) -> Column:
    """``value`` as a column that the optimiser neither copies to each place of use nor moves into a filter."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def alternation(words: Iterable[str]) -> str:
    return "(?:" + "|".join(re.sub(r"([.*+?^${}()|\[\]\\/])", r"\\\1", w) for w in words) + ")"


def lowered(text: Column) -> Column:
    """What phrases are looked for in: lower case, never null. Give it a column of its own where it is used more than once."""
    return F.lower(F.coalesce(text, F.lit("")))


def _phrases(phrases: Iterable[str]) -> Column:
    return F.array(*[F.lit(p) for p in phrases])


def any_in(low: Column, phrases: Iterable[str]) -> Column:
    """Whether some phrase occurs in a text of :func:`lowered`; each is a search for plain bytes, faster than an alternation."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p.lower())) for p in phrases])


def all_in(low: Column, phrases: Iterable[str]) -> Column:
    """The phrases that occur in a text of :func:`lowered`, in the list's order."""
    return F.filter(_phrases(phrases), lambda p: F.contains(low, F.lower(p)))


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """Whether some phrase occurs."""
    return bound(lowered(text), lambda low: any_in(low, phrases))


def matching(text: Column, phrases: Iterable[str]) -> Column:
    """The phrases that occur, in the list's order."""
    return bound(lowered(text), lambda low: all_in(low, phrases))


def collapse(text: Column) -> Column:
    """Every run of white space as one space; single spaces, nearly all there are, are passed over.

    Printable ASCII, nearly all of a text, is told by one range before the class of white space is asked.
    """
    return F.trim(F.regexp_replace(text, f"[^!-~](?:(?<! )(?<={SPACE}){SPACE}*|(?<= )(?![!-~]){SPACE}+)", " "))


def _word(low: Column, part: str, pattern: str) -> Column:
    """Whether ``pattern`` stands as a word in ``low``; looked for only where ``part`` of it occurs at all."""
    return F.contains(low, F.lit(part)) & low.rlike(f"{START}{pattern}{END}")


def utf16_unit(number: Column) -> Column:
    """The character of a 16-bit unit (the number wraps); halves of pairs give U+FFFD."""
    unit = F.pmod(F.coalesce(number.try_cast("decimal(38,0)"), F.lit(0xFFFD).cast("decimal(38,0)")), F.lit(65536).cast("decimal(38,0)")).cast("bigint")
    whole = F.when(unit.between(0xD800, 0xDFFF), F.lit(0xFFFD).cast("bigint")).otherwise(unit)
    return F.decode(F.unhex(F.lpad(F.hex(whole), 4, "0")), "UTF-16BE")


def strip_html(html: Column) -> Column:
    """Tags become spaces, entities characters, runs of white space one space."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", '"'), ("&#34;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(plain))

    def numbered(t: Column) -> Column:
        pieces = F.struct(F.split(t, r"&#\d+;", -1).alias("gaps"), F.regexp_extract_all(t, F.lit(r"&#(\d+);"), F.lit(1)).alias("codes"))
        return bound(pieces, lambda p: F.array_join(F.transform(p.gaps, lambda g, i: F.concat(g, F.when(F.get(p.codes, i).isNotNull(), utf16_unit(F.get(p.codes, i))).otherwise(""))), ""))

    return collapse(bound(text, lambda t: F.when(t.rlike(r"&#\d+;"), numbered(t)).otherwise(t)))


#: White space of web pages: all that Unicode counts as such.
PAGE_SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def unescaped(text: Column, closed: bool = False) -> Column:
    """All character references of HTML decoded; there are over two thousand named ones, some without a semicolon.

    With ``closed`` only those that end with a semicolon are: one that was cut off (``&amp`` at a title's end) stays as it is.
    """

    def decode(texts: pd.Series) -> pd.Series:
        from html import unescape
        from html.entities import html5

        def one(found: re.Match) -> str:
            return unescape(found[0]) if found[0][1] == "#" else html5.get(found[0][1:], found[0])

        whole = (lambda t: re.sub(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", one, t)) if closed else unescape
        return texts.map(lambda t: whole(t) if t is not None and "&" in t else t)

    return F.pandas_udf(decode, StringType())(text)


def page_text(html: Column, closed: bool = False) -> Column:
    """Readable text of a web page: blocks of script and style go, tags become spaces, character references characters (see :func:`unescaped`)."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    plain = F.regexp_replace(unescaped(F.regexp_replace(bare, "<[^>]+>", " "), closed), f"{PAGE_SPACE}+", " ")
    return F.trim(plain)


def _amount(number: Column, kilo: Column | None = None) -> Column:
    value = F.coalesce(F.regexp_replace(number, ",", "").try_cast("double"), F.lit(0.0))
    return value if kilo is None else value * F.when(kilo != "", 1000.0).otherwise(1.0)


def parse_salary(text: Column) -> Column:
    """struct(min, max, currency, derived): a range, else an hourly rate times 2080, else one amount; null if there is none."""
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)

    def currency(symbol: Column) -> Column:
        return F.when(symbol == "$", "USD").when(symbol == "€", "EUR").when(symbol == "£", "GBP")

    def made(low: Column, high: Column, symbol: Column, derived: bool) -> Column:
        return F.struct(low.alias("min"), high.alias("max"), currency(symbol).alias("currency"), F.lit(derived).alias("derived"))

    wide, hourly, single = V.SALARY_RANGE, V.SALARY_HOURLY, V.SALARY_SINGLE + BORDER
    year = _amount(part(hourly, 2)) * 2080
    one = _amount(part(single, 2), part(single, 3))
    return (
        F.when(text.rlike(wide), made(_amount(part(wide, 2), part(wide, 3)), _amount(part(wide, 5), part(wide, 6)), part(wide, 1), False))
        .when(text.rlike(hourly), made(year, year, part(hourly, 1), True))
        .when(text.rlike(single), made(one, one, part(single, 1), False))
    )


def remote_claim(location: Column, text: Column) -> Column:
    def claim(low: Column) -> Column:
        return F.when(_word(low, "remote", "remote"), "remote").when(_word(low, "hybrid", "hybrid"), "hybrid").when(_word(low, "site", f"on(?:-|{SPACE})?site"), "onsite").otherwise("unknown")

    return bound(F.lower(F.concat_ws(" ", F.coalesce(location, F.lit("")), F.coalesce(text, F.lit("")))), claim)


def employment_type(text: Column) -> Column:
    def kind(low: Column) -> Column:
        full, part = _word(low, "full", f"full(?:-|{SPACE})?time"), _word(low, "part", f"part(?:-|{SPACE})?time")
        return F.when(full, "full-time").when(part, "part-time").when(_word(low, "contract", "contract"), "contract").otherwise("unknown")

    return bound(lowered(text), kind)


def fingerprint(title: Column, company: Column, clean: Column) -> Column:
    """SHA-256 of title, company and the first 500 characters, in lower case."""
    parts = (F.trim(F.lower(title)), F.trim(F.lower(F.coalesce(company, F.lit("")))), F.lower(F.substring(clean, 1, 500)))
    return F.sha2(F.concat_ws("|", *parts), 256)


def embedding_text(title: Column, company: Column, clean: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(company, F.lit("")), F.substring(F.coalesce(clean, F.lit("")), 1, 1000))


def company_key(name: Column) -> Column:
    """For comparing companies of postings: no legal forms, a-z and 0-9 only."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.regexp_replace(F.regexp_replace(low, rf"{START}{alternation(V.COMPANY_FORMS)}{END}\.?", ""), "[^a-z0-9]", "")


def company_name_key(name: Column) -> Column:
    """For looking up company research: trimmed, lower case, single spaces."""
    return F.regexp_replace(F.lower(F.trim(name)), f"{SPACE}+", " ")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors; null if one is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def snippet(text: Column, phrase: Column) -> Column:
    """The phrase's first place with 60 characters on each side, or the first 160 characters."""
    at = F.instr(F.lower(text), F.lower(phrase))
    begin = F.greatest(F.lit(0), at - 1 - 60)
    end = F.least(F.length(text), at - 1 + F.length(phrase) + 60)
    cut = F.concat(F.when(begin > 0, "…").otherwise(""), collapse(F.substr(text, begin + 1, end - begin)), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, 160))


def number_text(value: Column) -> Column:
    """A double as people write it: no fraction if it has none."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def redact_urls(text: Column) -> Column:
    """``***`` for the values of secret query parameters in every URL; a fragment stays as it is."""
    url = r"https?://[^\s\"'<>()\[\]]+"
    secret = rf"(?i)(?<=[?&])({alternation(V.SECRET_PARAMETERS)})=[^&#]*"

    def inside(u: Column) -> Column:
        query = F.regexp_extract(u, r"^([^?]*\?)([^#]*)(.*)$", 2)
        masked = F.regexp_replace(F.concat(F.lit("?"), query), secret, "$1=***")
        return F.when(F.contains(u, F.lit("?")), F.concat(F.regexp_extract(u, r"^([^?]*)\?", 1), masked, F.regexp_extract(u, r"^[^?]*\?[^#]*(.*)$", 1))).otherwise(u)

    def rebuilt(p: Column) -> Column:
        return F.array_join(F.transform(p.gaps, lambda g, i: F.concat(g, F.coalesce(inside(F.get(p.urls, i)), F.lit("")))), "")

    pieces = F.struct(F.split(text, url, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(url), F.lit(0)).alias("urls"))
    return F.when(text.rlike(r"https?://"), bound(pieces, rebuilt)).otherwise(text)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def string_list(json: Column) -> Column:
    """A JSON array of strings; anything else is empty."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def date_ms(iso: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(iso))


def masked_hint(secret: Column) -> Column:
    return F.right(secret, F.lit(4))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def french_signals(text: Column) -> Column:
    """Words of a text that are common French ones or have a French letter."""
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+")
    return F.size(F.filter(tokens, lambda t: t.isin(V.FRENCH_WORDS) | t.rlike(V.FRENCH_LETTERS)))


def is_quebec(location: Column) -> Column:
    low = F.lower(F.coalesce(location, F.lit("")))
    return any_in(low, V.QUEBEC_PLACES) | low.rlike(f"{START}qc{END}") | low.rlike(rf"{START}[ghj]\d[a-z]\s?\d[a-z]\d{END}")


def names_place(location: Column, names: Iterable[str]) -> Column:
    """Whether a name stands in the text as a word; accented letters belong to words."""
    return F.lower(F.coalesce(location, F.lit(""))).rlike(f"(?<![a-zà-ÿ0-9]){alternation(names)}(?![a-zà-ÿ0-9])")
