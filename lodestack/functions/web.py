"""Column expressions over pages, hosts and companies' own sites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions import vocabulary as V
from lodestack.functions.text import bound


def host_label(url: Column) -> Column:
    """The label before the last one of a URL's host, the only one if there is one, '' without a host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":.*$", "")
    return bound(F.filter(F.split(bare, r"\."), lambda x: x != ""), lambda p: F.coalesce(F.when(F.size(p) >= 2, F.get(p, F.size(p) - 2)), F.get(p, F.lit(0)), F.lit("")))


def is_review_platform(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.contains(host, F.lit(V.REVIEW_HOSTS[0])) | F.contains(host, F.lit(V.REVIEW_HOSTS[1]))


def plain_words(text: Column) -> Column:
    """Lower case, everything but letters a-z, à-ÿ and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9à-ÿ]+", " "))


def holds_phrase(words: Column, phrase: Column) -> Column:
    """Whole-phrase match between texts of :func:`plain_words`; an empty phrase is in no text."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), words, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def _is_form(token: Column) -> Column:
    return token.isin(V.COMPANY_FORM_TOKENS)


def own_site_labels(company: Column) -> Column:
    """Host labels under which a company may have its own site."""
    tokens = F.regexp_extract_all(F.lower(company), F.lit("[a-z0-9à-ÿ]+"), F.lit(0))

    def labels(t: Column) -> Column:
        content = F.filter(t, lambda x: ~_is_form(x))
        first = F.when(F.size(content) > 1, F.get(content, F.lit(0)))
        return F.array_distinct(F.filter(F.array(F.array_join(t, ""), F.array_join(content, ""), first), lambda x: x.isNotNull() & (x != "")))

    return bound(tokens, labels)


def page_is_about(company: Column, title: Column, url: Column, text: Column) -> Column:
    """Whether a page concerns this company: its full name in title, URL or early text, or a distinctive word or acronym in title or URL."""
    name = plain_words(company)
    head = plain_words(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))))
    early = plain_words(F.substring(F.coalesce(text, F.lit("")), 1, 3000))

    def by_words(t: Column) -> Column:
        longest = F.aggregate(t, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
        acronym = F.array_join(F.transform(t, lambda x: F.substring(x, 1, 1)), "")
        return ((F.length(longest) >= 4) & holds_phrase(head, longest)) | ((F.size(t) >= 2) & holds_phrase(head, acronym))

    tokens = F.filter(F.split(name, " "), lambda x: (x != "") & ~_is_form(x))
    return F.coalesce((name != "") & (holds_phrase(head, name) | holds_phrase(early, name) | bound(tokens, by_words)), F.lit(False))


def specificity(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(value.cast("string").try_cast("double").cast("int"), F.lit(0))))


def corroboration(value: Column) -> Column:
    number = F.coalesce(value.cast("string").try_cast("double"), F.lit(1.0))
    return F.greatest(F.lit(1.0), F.least(F.lit(10_000_000.0), number)).cast("int")


def specificity_band(level: Column) -> Column:
    return F.when(level >= 4, "high").when(level >= 2, "medium").otherwise("generic")
