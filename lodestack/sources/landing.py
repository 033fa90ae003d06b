"""Raw postings from the landing zones of five job boards, and the boards' registry.

Each reader takes JSON documents as the boards' interfaces give them, one per
line or file, and maps them in the JVM; fetching them is outside the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import vocabulary as V
from lodestack.functions.text import blank_to_null, date_ms, strip_html
from lodestack.schemas import RAW_POSTING
from lodestack.storage import settled


def _posting(source: str, **columns: Column) -> list[Column]:
    """Columns of a raw posting; those not given are null."""
    made = []
    for part in RAW_POSTING.split(", "):
        name, kind = part.split()
        value = F.lit(source) if name == "source" else columns.get(name, F.lit(None))
        made.append(value.cast(kind).alias(name))
    return made


def page_walk(payloads: DataFrame, page: Column, rows: Column, page_rows: int = V.ADZUNA_PAGE_ROWS, pages: int = V.ADZUNA_PAGES) -> DataFrame:
    """The landed pages that a walk from page 1 reads: up to the first short or missing one, ``pages`` at most.

    ``page`` counts from 1, ``rows`` is a page's list.
    """
    counted = payloads.withColumn("__page", page).where(F.col("__page").between(1, pages))
    full = counted.where(F.size(rows) >= page_rows).select("__page").distinct()
    # pages - 1 numbers at most: the first that isn't full ends the walk
    known = {r[0] for r in full.collect()}
    last = next((n for n in range(1, pages + 1) if n not in known), pages)
    return counted.where(F.col("__page") <= last).drop("__page")


def adzuna(payloads: DataFrame) -> DataFrame:
    """From {results: [...]} pages; the currency is never told. Pages with a number are walked (see :func:`page_walk`)."""
    if "page" in payloads.columns and not payloads.isStreaming and payloads.where("page is not null").take(1):
        payloads = page_walk(payloads, F.col("page"), F.col("results"))
    r = payloads.select(F.explode("results").alias("r"))
    return r.select(*_posting(
        "adzuna", external_id=F.col("r.id"), title=F.col("r.title"), company_name=F.col("r.company.display_name"), description_html=F.col("r.description"),
        url=F.col("r.redirect_url"), posted_at_ms=date_ms(F.col("r.created")), location_raw=F.col("r.location.display_name"), salary_min=F.col("r.salary_min"), salary_max=F.col("r.salary_max"),
    ))


def hackernews(payloads: DataFrame) -> DataFrame:
    """From threads {title, created_at_i, children: [...]}: the latest hiring thread's comments with a text.

    The first line names title and, before a bar, company. A stream takes every
    such thread, as the latest one isn't known.
    """
    threads = payloads.where(F.col("title").rlike("(?i)who is hiring"))
    if not threads.isStreaming and "created_at_i" in threads.columns:
        latest = threads.agg(F.max(F.coalesce("created_at_i", F.lit(0))).alias("at")).first()["at"]
        threads = threads.where(F.coalesce("created_at_i", F.lit(0)) == F.lit(latest))
    r = threads.select(F.explode("children").alias("r")).where(F.trim(F.coalesce("r.text", F.lit(""))) != "")
    line = F.trim(F.get(F.split(F.regexp_replace("r.text", "(?i)<p>", "\n"), "\n"), F.lit(0)))
    head = F.substring(strip_html(line), 1, 140)
    parts = F.split(head, r"\|")
    company = F.when(F.size(parts) > 1, blank_to_null(F.get(parts, F.lit(0))))
    url = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("r.id").cast("string"))
    return r.select(*_posting("hackernews", external_id=F.col("r.id").cast("string"), title=head, company_name=company, description_html=F.col("r.text"), url=url, posted_at_ms=F.col("r.created_at_i").cast("bigint") * 1000))


def remoteok(rows: DataFrame) -> DataFrame:
    """From one object per posting; notices without id or position are no postings; amounts up to 0 are none."""
    paid = lambda c: F.when(F.col(c) > 0, F.col(c))
    currency = F.when(paid("salary_min").isNotNull() | paid("salary_max").isNotNull(), "USD")
    kept = rows.where("id is not null and position is not null")
    return kept.select(*_posting(
        "remoteok", external_id=F.col("id").cast("string"), title=F.col("position"), company_name=F.col("company"), description_html=F.col("description"), url=F.col("url"),
        posted_at_ms=date_ms(F.col("date")), location_raw=blank_to_null(F.col("location")), salary_min=paid("salary_min"), salary_max=paid("salary_max"), salary_currency=currency,
    ))


def arbeitnow(payloads: DataFrame) -> DataFrame:
    """From {data: [...]}; an empty place of a remote posting is 'Remote'."""
    r = payloads.select(F.explode("data").alias("r")).where("r.slug is not null and r.title is not null")
    place = F.coalesce(blank_to_null(F.col("r.location")), F.when(F.col("r.remote"), "Remote"))
    return r.select(*_posting("arbeitnow", external_id=F.col("r.slug"), title=F.col("r.title"), company_name=F.col("r.company_name"), description_html=F.col("r.description"), url=F.col("r.url"), posted_at_ms=F.col("r.created_at").cast("bigint") * 1000, location_raw=place))


def themuse(payloads: DataFrame) -> DataFrame:
    """From {results: [...]}; places are joined by commas."""
    r = payloads.select(F.explode("results").alias("r")).where("r.id is not null and r.name is not null")
    places = blank_to_null(F.array_join(F.filter(F.transform("r.locations", lambda x: F.trim(x["name"])), lambda x: x != ""), ", "))
    return r.select(*_posting("themuse", external_id=F.col("r.id").cast("string"), title=F.col("r.name"), company_name=F.col("r.company.name"), description_html=F.col("r.contents"), url=F.col("r.refs.landing_page"), posted_at_ms=date_ms(F.col("r.publication_date")), location_raw=places))


@dataclass(frozen=True)
class Source:
    """A job board: how its JSON is read, and which credentials fetching needs."""

    name: str
    schema: str
    read: Callable[[DataFrame], DataFrame]
    credentials: tuple[str, ...] = ()

    def records(self, spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
        """The JSON records in ``path`` in this source's schema; what can't be read whole is in the column _corrupt_record."""
        schema = f"{self.schema}, _corrupt_record string"
        return spark.read.schema(schema).option("multiLine", whole_files).option("mode", "PERMISSIVE").json(path)

    def load(self, spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
        """Raw postings of the JSON files in ``path``; unknown fields are ignored.

        A record that is not valid JSON gives the postings that could be read of
        it; :meth:`malformed` has all such records, so nothing is lost unseen.
        """
        return self.read(self.records(spark, path, whole_files).drop("_corrupt_record"))

    def malformed(self, spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
        """_corrupt_record: the texts of records that aren't valid."""
        return settled(self.records(spark, path, whole_files)).where("_corrupt_record is not null").select("_corrupt_record")


SOURCES = {
    s.name: s
    for s in (
        Source(
            "adzuna",
            "page int, results array<struct<id:string,title:string,description:string,redirect_url:string,created:string,company:struct<display_name:string>,location:struct<display_name:string>,salary_min:double,salary_max:double>>",
            adzuna,
            ("app_id", "app_key"),
        ),
        Source("hackernews", "title string, created_at_i bigint, children array<struct<id:bigint,text:string,created_at_i:bigint>>", hackernews),
        Source("remoteok", "id string, position string, company string, description string, url string, date string, location string, salary_min double, salary_max double", remoteok),
        Source("arbeitnow", "data array<struct<slug:string,title:string,company_name:string,description:string,remote:boolean,url:string,created_at:bigint,location:string,tags:array<string>>>", arbeitnow),
        Source(
            "themuse",
            "results array<struct<id:bigint,name:string,contents:string,refs:struct<landing_page:string>,publication_date:string,company:struct<name:string>,locations:array<struct<name:string>>>>",
            themuse,
        ),
    )
}


@dataclass(frozen=True)
class IngestConfig:
    """What is fetched; a field of None isn't set."""

    enabled: tuple[str, ...] | None = None
    query: str | None = None
    city: str | None = None
    province: str | None = None
    country: str | None = None
    category: str | None = None
    credentials: dict[str, dict[str, str]] = field(default_factory=dict)


def resolve(*layers: IngestConfig) -> IngestConfig:
    """Field by field the last layer that sets it; texts trimmed, empty ones unset, the country in lower case."""
    clean = lambda x: x.strip() or None if isinstance(x, str) else x
    made = {}
    for name in ("enabled", "query", "city", "province", "country", "category"):
        values = [v for v in (clean(getattr(layer, name)) for layer in layers) if v is not None]
        made[name] = values[-1] if values else None
    made["country"] = made["country"].lower() if made["country"] else "us"
    credentials: dict[str, dict[str, str]] = {}
    for layer in layers:
        for source, values in layer.credentials.items():
            credentials.setdefault(source, {}).update({k: v for k, v in values.items() if v})
    return IngestConfig(**made, credentials=credentials)


def resolved(layers: DataFrame, owner: str = "owner") -> DataFrame:
    """:func:`resolve` for many owners at once: ``owner``, query, city, province, country, category and place.

    ``layers`` has ``owner``, layer (a later one has a larger number) and the five
    texts; of each the last layer counts that sets it.
    """
    names = ("query", "city", "province", "country", "category")

    def last_set(name: str) -> Column:
        text = blank_to_null(F.trim(name))
        return F.max(F.when(text.isNotNull(), F.struct("layer", text.alias("text")))).text.alias(name)

    made = layers.groupBy(owner).agg(*[last_set(n) for n in names])
    place_of = blank_to_null(F.concat_ws(", ", "city", "province"))
    return made.withColumn("country", F.lower(F.coalesce("country", F.lit("us")))).withColumn("place", place_of)


def muse_category(field: Column) -> Column:
    """One board's category for what a user writes; null for a field it doesn't know, as it would answer with nothing."""
    table = F.create_map(*[F.lit(x) for pair in V.MUSE_CATEGORIES.items() for x in pair])
    return F.element_at(table, F.lower(F.trim(field)))


def place(config: IngestConfig) -> str | None:
    """City and province joined by a comma, as far as there are any."""
    return ", ".join(p.strip() for p in (config.city, config.province) if p and p.strip()) or None


def chosen_sources(config: IngestConfig) -> list[Source]:
    """Enabled known sources in the registry's order, without those whose credentials are missing."""
    wanted = SOURCES if config.enabled is None else config.enabled
    complete = lambda s: all(config.credentials.get(s.name, {}).get(k) for k in s.credentials)
    return [s for s in SOURCES.values() if s.name in wanted and complete(s)]


def read_all(spark: SparkSession, folders: dict[str, str], sources: Sequence[Source]) -> DataFrame:
    """Raw postings of all ``sources`` that have a folder, in one table."""
    made = spark.createDataFrame([], RAW_POSTING)
    for source in sources:
        if source.name in folders:
            made = made.unionByName(source.load(spark, folders[source.name]))
    return made
