"""Landed answers of an employer-review interface, read tolerantly as variants: envelopes and field names differ.

Input: company, search, overview and reviews (JSON texts of the three requests)
and failure (what went wrong, if a request failed).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import vocabulary as V
from lodestack.functions.text import company_name_key, number_text, redact_urls


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def payload(value: Column) -> Column:
    """What an envelope {data: ...} holds, or the value itself."""
    return F.coalesce(_get(value, "$.data", "variant"), value)


def _array(value: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(_get(value, path, "variant")).startswith("ARRAY"), _get(value, path, "array<variant>"))


def listed(value: Column) -> Column:
    """The list in a payload: itself, or under one of the known names; null if there is none."""
    inner = payload(value)
    return F.coalesce(_array(inner, "$"), *[_array(inner, f"$.{name}") for name in V.REVIEW_LISTS])


def _kind(value: Column, name: str) -> Column:
    return F.schema_of_variant(_get(value, f"$.{name}", "variant"))


def _is_number(kind: Column) -> Column:
    return kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")


def first_text(value: Column, names: Iterable[str]) -> Column:
    """The first of the named fields that is a text with something in it, or a number."""
    tries = []
    for name in names:
        text = F.trim(_get(value, f"$.{name}", "string"))
        number = number_text(_get(value, f"$.{name}", "double"))
        tries.append(F.when((_kind(value, name) == "STRING") & (text != ""), text).when(_is_number(_kind(value, name)), number))
    return F.coalesce(*tries)


def first_number(value: Column, names: Iterable[str]) -> Column:
    """The first of the named fields that is a number, or a text that is one."""
    tries = []
    for name in names:
        of_text = F.trim(_get(value, f"$.{name}", "string")).try_cast("double")
        finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        tries.append(F.when(_is_number(_kind(value, name)), finite(_get(value, f"$.{name}", "double"))).when(_kind(value, name) == "STRING", finite(of_text)))
    return F.coalesce(*tries)


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def resolved(payloads: DataFrame) -> DataFrame:
    """company, review_company_id, review_company: the first candidate of exactly the company's name."""
    rows = payloads.select("company", F.posexplode(listed(F.try_parse_json("search"))).alias("place", "c")).where(_is_object(F.col("c")))
    named = rows.select("company", "place", first_text(F.col("c"), V.REVIEW_FIELDS["candidate_name"]).alias("review_company"), first_text(F.col("c"), V.REVIEW_FIELDS["candidate_id"]).alias("review_company_id"))
    same = named.where(F.col("review_company_id").isNotNull() & (company_name_key(F.col("review_company")) == company_name_key(F.col("company"))))
    return same.groupBy("company").agg(F.min_by(F.struct("review_company_id", "review_company"), "place").alias("c")).select("company", "c.*")


def overviews(payloads: DataFrame) -> DataFrame:
    """company, place, text, title, url, kind: rating and number of reviews of a company as one sentence, if either is told."""
    data = payload(F.try_parse_json("overview"))
    field = V.REVIEW_FIELDS
    rows = payloads.select("company", data.alias("d")).where(_is_object(F.col("d")))
    rows = rows.select("company", first_number(F.col("d"), field["overall_rating"]).alias("rating"), first_number(F.col("d"), field["review_count"]).alias("n"), F.coalesce(first_text(F.col("d"), field["overview_url"]), F.lit("")).alias("url"))
    rating = F.coalesce(F.concat(F.lit("rated "), number_text(F.col("rating")), F.lit(" of 5")), F.lit("not rated"))
    count = F.coalesce(F.concat(F.lit(" by "), number_text(F.col("n")), F.lit(" reviews")), F.lit(""))
    told = F.concat(F.col("company"), F.lit(" is "), rating, count, F.lit("."))
    return rows.where("rating is not null or n is not null").select("company", F.lit(-1).alias("place"), told.alias("text"), F.concat(F.lit("Overview of "), F.col("company")).alias("title"), "url", F.lit("signal").alias("kind"))


def review_texts(payloads: DataFrame) -> DataFrame:
    """company, place, text, title, url, kind of each review that says something."""
    field = V.REVIEW_FIELDS
    rows = payloads.select("company", F.posexplode(listed(F.try_parse_json("reviews"))).alias("place", "r")).where(_is_object(F.col("r")))
    said = [F.concat(F.lit(label), first_text(F.col("r"), field[name])) for name, label in (("summary", ""), ("pros", "Pros: "), ("cons", "Cons: "), ("advice", "Advice: "))]
    rating = first_number(F.col("r"), field["rating"])
    title = F.concat(F.lit("Review by "), F.coalesce(first_text(F.col("r"), field["job_title"]), F.lit("an employee")), F.coalesce(F.concat(F.lit(", "), number_text(rating), F.lit(" of 5")), F.lit("")))
    made = rows.select("company", "place", F.concat_ws("\n", *said).alias("text"), title.alias("title"), first_text(F.col("r"), field["review_url"]).alias("url"), F.lit("review").alias("kind"))
    return made.where("text <> ''")


def evidence(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes (company, outcome, review_company_id, failure) and the evidence of the companies that contribute.

    Outcomes are contributed, no_match, no_evidence and request_failed; a
    company's name must match exactly, a near one gives nothing.
    """
    able = payloads.where("failure is null")
    known = resolved(able)
    over = overviews(able.join(known.select("company"), "company", "left_semi"))
    links = over.select("company", F.col("url").alias("overview_url"))
    each = review_texts(able.join(known.select("company"), "company", "left_semi")).join(links, "company", "left")
    rows = over.unionByName(each.withColumn("url", F.coalesce("url", "overview_url", F.lit(""))).drop("overview_url"))
    counted = rows.groupBy("company").agg(F.count("*").alias("n"))
    joined = payloads.select("company", "failure").join(known, "company", "left").join(counted, "company", "left")
    outcome = F.when(F.col("failure").isNotNull(), "request_failed").when(F.col("review_company_id").isNull(), "no_match").when(F.col("n").isNull(), "no_evidence").otherwise("contributed")
    outcomes = joined.select("company", outcome.alias("outcome"), F.when(outcome == "contributed", F.col("review_company_id")).alias("review_company_id"), redact_urls(F.col("failure")).alias("failure"))
    place = Window.partitionBy("company").orderBy("place")
    return outcomes, rows.withColumn("place", F.row_number().over(place))
