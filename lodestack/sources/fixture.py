"""A table of postings made from the driver's tables, for queries that need job texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import company_name_key
from lodestack.operators.ingest import normalise

START_MS = 1_704_067_200_000
DAY_MS = 86_400_000
NOW_MS = START_MS + 200 * DAY_MS

# Lists whose lengths share no factor, so that their values mix.
SUFFIXES = ["", " Inc.", " LLC", " Staffing", None]
LISTS: dict[str, list[str | None]] = {
    "title": [
        "Senior Backend Engineer", "Junior QA Analyst", "Product Manager", "Data Engineer", "Machine Learning Engineer", "Site Reliability Engineer",
        "Frontend Developer", "UX Designer", "IT Support Specialist", "Staff Software Engineer", "Cafeteria Worker",
    ],
    "w": ["Remote position.", "Hybrid schedule.", "On-site role.", "Great team."],
    "e": ["Full-time.", "Part time.", "6-month contract.", "Full time.", "Contract.", "", "Part-time.", "", "Join us."],
    "y": ["$120k - $150k", "$80,000-$95,000", "$50/hr", "€80k", "£45,000", "Competitive pay", "$20,000 - $25,000"],
    "l": [
        "Must speak German.", "Fluent in French.", "English required.", "Bilingual English/French.", "", "Requires 5+ years of experience.",
        "3 years of experience", "Responsibilities: build things. Tech stack: Python.", "About us: small team. Benefits: health insurance.",
        "Maîtrise du français.", "", "12 years of experience", "Spanish is mandatory.",
    ],
    "x": [
        "Pay for training first.", "Contact us on Telegram.", "Nights and weekends expected.", "We are a family.", "On behalf of our client.",
        "Training is unpaid.", "Buy your own equipment.", "Required in office 3 days per week.", "Relocation required.", *[""] * 10,
    ],
    "location": [
        "Toronto, Ontario", "Montréal, QC", "New York, NY", "Austin, Texas", "Berlin", "Remote", "Vancouver, BC", "Laval, Quebec", "San Francisco",
        "London", None, "Portland, OR", "Calgary", "Paris", "Gatineau, QC", "Seattle, WA", "Ottawa, ON",
    ],
}


def _pick(name: str, number: Column) -> Column:
    values = SUFFIXES if name == "suffix" else LISTS[name]
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posting_id, vec_id, first_seen_at_ms and the columns of a raw posting."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    ns = supplier.count()
    d, c = F.col("doc_id"), F.col("cid")
    rows = docs.select("doc_id", F.when(d % 20 == 19, d - 1).otherwise(d).alias("cid"))
    body = docs.select(F.col("doc_id").alias("cid"), F.coalesce("text", F.lit("")).alias("body"))
    names = supplier.select(F.pmod("s_suppkey", F.lit(ns)).alias("company_number"), "s_name")
    rows = rows.join(body, "cid").withColumn("company_number", c % ns).join(names, "company_number", "left")
    html = F.concat(
        F.lit("<p>"), _pick("w", c), F.lit(" "), _pick("e", c), F.lit(" "), _pick("y", c), F.lit("</p><p>"), _pick("l", c), F.lit(" "), _pick("x", c),
        F.lit("</p><p>"), F.col("body"), F.lit("</p>"),
    )
    pay = lambda a, b: F.when(c % 6 == 0, a).when(c % 6 == 3, b).cast("double")
    seen = F.lit(START_MS) + ((F.floor(d / 200) * 53 + d * 37) % 200).cast("bigint") * DAY_MS
    return rows.select(
        d.alias("posting_id"), F.when(d % 10 != 7, F.col("company_number")).alias("vec_id"), seen.alias("first_seen_at_ms"), F.lit("fixture").alias("source"), d.cast("string").alias("external_id"),
        _pick("title", c).alias("title"), F.concat("s_name", _pick("suffix", F.floor(c / ns))).alias("company_name"), html.alias("description_html"), F.lit(None).cast("string").alias("url"),
        seen.alias("posted_at_ms"), _pick("location", c).alias("location_raw"), pay(85000, 40000).alias("salary_min"), pay(110000, 50000).alias("salary_max"),
        F.when(c % 3 == 0, "CAD").alias("salary_currency"),
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(raw_postings(spark, sf_dir))


def posting_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posting_id and vec (of unit length) of the postings that have one.

    A company's postings have one embedding, each with a part of its own in one
    place, so their similarities lie on both sides of the thresholds.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = vectors.count()
    rows = raw_postings(spark, sf_dir).where("vec_id is not null").select("posting_id", (F.col("vec_id") % n).alias("vec_id"))
    size, own = F.size("e"), F.col("posting_id") * 5
    moved = F.transform("e", lambda x, i: x + F.when(i == own % size, (F.col("posting_id") % 7) / 10).otherwise(0.0))
    rows = rows.join(vectors, "vec_id").select("posting_id", moved.alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("norm", norm).select("posting_id", F.transform("m", lambda x: x / F.col("norm")).alias("vec"))


def evaluations(rows: DataFrame) -> DataFrame:
    """posting_id and outcome of four of five of ``rows`` (posting_id)."""
    k = F.col("posting_id") % 5
    return rows.where(k != 0).select("posting_id", F.when(k == 1, "knocked_out").when(k == 2, "needs_review").otherwise("passed").alias("outcome"))


def feedback(rows: DataFrame) -> DataFrame:
    """posting_id and label of a third of ``rows`` (posting_id)."""
    k = F.col("posting_id") % 6
    return rows.where(k.isin(1, 2)).select("posting_id", F.when(k == 1, "up").otherwise("down").alias("label"))


def company_intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research of most companies, by key."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    k = F.col("s_suppkey") % 5
    mood = F.when(k == 1, "positive").when(k == 2, "mixed").when(k == 3, "negative").otherwise("unknown")
    fetched = F.lit(NOW_MS) - (F.col("s_suppkey") * 7 % 61).cast("bigint") * DAY_MS
    return supplier.where(k != 0).select(
        company_name_key(F.col("s_name")).alias("company_name_key"), F.col("s_name").alias("display_name"), mood.alias("sentiment"),
        F.concat(F.lit("what is said of "), F.repeat(F.concat("s_name", F.lit(", ")), (F.col("s_suppkey") % 12).cast("int"))).alias("reputation_notes"), fetched.alias("fetched_at_ms"),
    )
