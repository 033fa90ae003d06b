"""From raw postings to normalised ones, new ones only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.storage import grown, settled


def normalise(raw: DataFrame) -> DataFrame:
    """Clean text, salary, claims and fingerprint of raw postings; a source's own salary wins field by field.

    Other columns are carried; ``description_html`` becomes ``description_raw``.
    """
    clean = F.coalesce(T.strip_html(F.col("description_html")), F.lit(""))
    staged = raw.withColumn("description_clean", clean).withColumn("_salary", T.parse_salary(F.col("description_clean")))
    return (
        staged.withColumns({
            "remote_claim": T.remote_claim(F.col("location_raw"), F.col("description_clean")),
            "employment_type": T.employment_type(F.col("description_clean")),
            "salary_min": F.coalesce("salary_min", F.col("_salary.min")),
            "salary_max": F.coalesce("salary_max", F.col("_salary.max")),
            "salary_currency": F.coalesce("salary_currency", F.col("_salary.currency")),
            "fingerprint": T.fingerprint(F.col("title"), F.col("company_name"), F.col("description_clean")),
        })
        .withColumnRenamed("description_html", "description_raw")
        .drop("_salary")
    )


def once(raw: DataFrame) -> DataFrame:
    """One row for each (source, external_id), the first by all columns, with the number of its ``copies``."""
    keys = ["source", "external_id"]
    own = Window.partitionBy(*keys)
    first = own.orderBy(*[F.col(c).asc_nulls_last() for c in sorted(set(raw.columns) - set(keys))])
    return raw.withColumn("_n", F.row_number().over(first)).withColumn("copies", F.count("*").over(own)).where("_n = 1").drop("_n")


def unseen(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``raw`` whose (source, external_id) isn't stored; of repeated ones in the batch the first by all columns."""
    keys = ["source", "external_id"]
    return once(raw).drop("copies").join(stored.select(*keys).distinct(), keys, "left_anti")


def with_ids(rows: DataFrame, last_id: int, order: list[str]) -> DataFrame:
    """posting_id after ``last_id``, in the given total order.

    Ranges are numbered within themselves and shifted by the sizes of those
    before, so no task holds all rows.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = settled(ranged.withColumn("_at", F.monotonically_increasing_id() - F.col("_part").cast("long") * F.lit(1 << 33)))
    sizes = ranged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0))).select("_part", "_shift")
    return ranged.join(F.broadcast(shifts), "_part").withColumn("posting_id", F.lit(last_id + 1) + F.col("_shift") + F.col("_at")).drop("_part", "_at", "_shift")


def embedding_rows(postings: DataFrame) -> DataFrame:
    """posting_id and the text that represents a posting to an embedder."""
    return postings.select("posting_id", T.embedding_text(F.col("title"), F.col("company_name"), F.col("description_clean")).alias("text"))


def run_counts(batch: DataFrame, added: DataFrame, links: DataFrame) -> DataFrame:
    """Per source: fetched, added and linked as duplicates.

    ``batch`` has one row for each posting fetched, or those of :func:`once` with
    their copies, so that the sources' files aren't read again.
    """
    fetched = batch.groupBy("source").agg((F.sum("copies") if "copies" in batch.columns else F.count("*")).alias("fetched"))
    new = added.groupBy("source").agg(F.count("*").alias("added"))
    linked = grown(links).join(added.select("posting_id", "source"), "posting_id").groupBy("source").agg(F.count("*").alias("duplicates"))
    out = fetched.join(new, "source", "left").join(linked, "source", "left")
    return out.select("source", "fetched", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"))
