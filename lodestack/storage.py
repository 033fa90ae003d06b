"""The folder that driver and executors share, and tables cut off from their lineage in it."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO_ROOT = str(Path(__file__).resolve().parents[1])

#: Folders made for sessions without one, by application id.
_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; in a local session without one a folder of its own.

    Elsewhere a missing setting is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _made:
        _made[context.applicationId] = tempfile.mkdtemp(prefix="lodestack-")
    return _made[context.applicationId]


def ready(spark: SparkSession) -> SparkSession:
    """``spark`` with a checkpoint folder, and workers that can import this package."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, REPO_ROOT])
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    # texts are long: the default of 10,000 rows makes Arrow batches of tens of MB in each task, JVM and worker
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1500")
    return spark


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and kept in the shared folder, so that a lost executor costs a read and no recomputation.

    They are Parquet, so that who needs few columns reads no others.
    """
    spark = ready(rows.sparkSession)
    folder = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def grown(rows: DataFrame) -> DataFrame:
    """``rows``, which are as many as the postings or companies: a join with them merges and never broadcasts.

    Catalyst measures a table by its files. Columns of ids and of few values take a few bytes a row
    there and ten to forty times as many in the driver, so it would broadcast millions of rows.
    """
    return rows.hint("merge")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage with all that is in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
