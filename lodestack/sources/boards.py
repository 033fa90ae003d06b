"""The landing zone of a job board as a Spark data source: ``spark.read.format("jobboard")``.

A landing zone is a folder with a folder ``page=<n>`` for each page that was fetched,
whose files hold one JSON record a line. Each file of a page is a partition of its own; filters
on ``page`` are pushed down, so that other pages are neither listed for tasks nor
opened; and a stream's offset is the walk over the pages: the last page up to which
all have landed, so a page that comes late holds back those behind it, and after a
restart the walk goes on where it was.

Files are read through pyarrow's file systems (local, HDFS, S3 and others), in tasks.
Rows are page, file and record (the JSON text); :func:`load` maps them to raw postings.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lodestack.sources.landing import SOURCES, Source
from lodestack.storage import ready

FORMAT = "jobboard"
PAGE_ROWS = "page int, file string, record string"
_PAGE = re.compile(r"page=(\d+)$")
#: Bytes of a batch of records.
BATCH_BYTES = 4 << 20


@dataclass
class PageOf(InputPartition):
    """One file of a landed page."""

    folder: str
    page: int
    file: str


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def landed_pages(path: str) -> list[int]:
    """Numbers of the pages that have landed whole: Spark's writer and others put files in place by renaming them."""
    files, root = _opened(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(m[1]) for f in found if f.type == fs.FileType.Directory and (m := _PAGE.search(f.path)))


def _files(folder: str, page: int) -> list[PageOf]:
    """A partition for each file of a page, so that what a task reads doesn't grow with the page."""
    files, root = _opened(folder)
    found = files.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True))
    return [PageOf(folder, page, f.base_name) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]


def _read(partition: PageOf) -> Iterator[pa.RecordBatch]:
    """The file's records, line by line, in batches of at most 256 records and about ``BATCH_BYTES``."""
    files, root = _opened(partition.folder)
    held: list[str] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array([partition.page] * len(held), pa.int32()), pa.array([partition.file] * len(held)), pa.array(held)]
        return pa.RecordBatch.from_arrays(columns, names=["page", "file", "record"])

    with files.open_input_stream(f"{root}/page={partition.page}/{partition.file}") as stream, io.BufferedReader(stream) as lines:
        for line in lines:
            record = line.decode("utf-8").removesuffix("\n")
            if not record.strip():
                continue
            held.append(record)
            size += len(line)
            if len(held) == 256 or size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
    if held:
        yield batch()


class JobBoardReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of the page; gives back what Spark has to test itself."""
        kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("page",):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f

    def wanted(self, page: int) -> bool:
        holds = {"==": lambda v: page == v, ">": lambda v: page > v, ">=": lambda v: page >= v, "<": lambda v: page < v, "<=": lambda v: page <= v, "in": lambda v: page in v}
        return all(holds[kind](value) for kind, value in self.tests)

    def partitions(self) -> Sequence[PageOf]:
        return [f for n in landed_pages(self.path) if self.wanted(n) for f in _files(self.path, n)]

    def read(self, partition: PageOf | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from _read(partition)


class JobBoardStream(DataSourceStreamReader):
    """Offsets are {"page": the last page of the walk}."""

    def __init__(self, path: str, pages: int | None) -> None:
        self.path, self.pages = path, pages

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        there, last = set(landed_pages(self.path)), 0
        while last + 1 in there and (self.pages is None or last < self.pages):
            last += 1
        return {"page": last}

    def partitions(self, start: dict, end: dict) -> Sequence[PageOf]:
        return [f for n in range(start["page"] + 1, end["page"] + 1) for f in _files(self.path, n)]

    def read(self, partition: PageOf) -> Iterator[pa.RecordBatch]:
        yield from _read(partition)

    def commit(self, end: dict) -> None:
        pass


class JobBoard(DataSource):
    """Options: path, and pages (how far a stream walks at most)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PAGE_ROWS

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("a job board's landing zone needs a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema: object) -> JobBoardReader:
        return JobBoardReader(self._path())

    def streamReader(self, schema: object) -> JobBoardStream:
        pages = self.options.get("pages")
        return JobBoardStream(self._path(), int(pages) if pages else None)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, with filters pushed down."""
    ready(spark).dataSource.register(JobBoard)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def land(rows: DataFrame, path: str, page: str = "page") -> None:
    """Write a board's records as its landing zone; ``page`` numbers the pages and is a field of the records too."""
    kept = rows.select(F.col(page).alias("page"), F.to_json(F.struct("*")).alias("value"))
    kept.repartition("page").write.mode("append").partitionBy("page").text(path)


def records(source: Source, pages: DataFrame, walked: bool = True) -> DataFrame:
    """Rows of the data source as the source's JSON records; what isn't JSON is a row of nulls.

    With ``walked`` a record whose schema has a page gets its folder's number, so that the source's walk over pages applies.
    """
    read = pages.select(F.from_json("record", source.schema).alias("r"), "page")
    made = read.select("r.*", F.col("page").alias("__page"))
    return (made.withColumn("page", F.col("__page")) if walked and "page" in made.columns else made).drop("__page")


def load(spark: SparkSession, name: str, path: str, pages: int | None = None) -> DataFrame:
    """Raw postings of a board's landing zone, of its first ``pages`` pages if that is given."""
    source = SOURCES[name]
    rows = register(spark).read.format(FORMAT).option("path", path).load()
    return source.read(records(source, rows if pages is None else rows.where(F.col("page") <= pages)))


def load_stream(spark: SparkSession, name: str, path: str, pages: int | None = None) -> DataFrame:
    """The same as a stream that walks the pages as they land."""
    reader = register(spark).readStream.format(FORMAT).option("path", path)
    return SOURCES[name].read(records(SOURCES[name], (reader if pages is None else reader.option("pages", str(pages))).load()))
