"""Written intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Spark's own switch: shuffle files go when the job that made them is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a folder of this machine serves a local session, and a cluster gets an error."""
    at = spark.conf.get(SETTING, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="chronopanel-")
        spark.conf.set(SETTING, at)
    return at.rstrip("/")


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _folder(spark: SparkSession) -> str:
    """This application's tables."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def write_table(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and return it as read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(*tables: DataFrame) -> None:
    """Delete the files of tables from write_table() that no later plan reads."""
    for table in tables:
        _delete(table.sparkSession, table.written_at)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written: once its results are saved, nothing reads them."""
    _delete(spark, _folder(spark))
