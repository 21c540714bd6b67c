"""Immutable tables with content hashes, and views over them. Paths are whatever Spark can read and write."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def row_text(columns: Sequence[str]) -> Column:
    """The values joined by |, null as \\N; numbers by their shortest text."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))


def with_row_hash(df: DataFrame, columns: Sequence[str], name: str = "row_sha256") -> DataFrame:
    return df.withColumn(name, F.sha2(row_text(columns), 256))


def content_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_rows, content): a digest that doesn't depend on the order of rows; each row's SHA-256 is summed, so repeats count."""
    piece = lambda at: F.conv(F.substring(F.sha2(row_text(columns), 256), at, 15), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count("*").alias("n_rows"), F.sum(piece(1)).alias("a"), F.sum(piece(16)).alias("b"))
    return sums.select("n_rows", F.sha2(F.concat_ws(":", F.col("n_rows"), F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))), 256).alias("content"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def write_once(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Write a table where none is, refusing repeated keys; returns it as read back with one row of (n_rows, content) beside it in path_manifest."""
    if repeated_keys(df, keys).limit(1).count():
        raise ValueError(f"repeated keys {list(keys)} for {path}")
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    content_hash(back, sorted(back.columns)).withColumn("path", F.lit(path)).coalesce(1).write.mode("errorifexists").json(f"{path}_manifest")
    return back


def is_intact(spark: SparkSession, path: str) -> bool:
    """Whether a table still has the content that its manifest names."""
    back = spark.read.parquet(path)
    now, then = content_hash(back, sorted(back.columns)).first(), spark.read.json(f"{path}_manifest").first()
    return (now["n_rows"], now["content"]) == (then["n_rows"], then["content"])


def register_views(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Temporary views over Parquet paths, and (view, n_rows) of each."""
    out = None
    for name, path in sorted(tables.items()):
        df = spark.read.parquet(path)
        df.createOrReplaceTempView(name)
        one = df.agg(F.lit(name).alias("view"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def primary_with_recovery(primary: DataFrame, recovery: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of primary, and those of recovery whose keys it hasn't; feed says which."""
    extra = recovery.join(primary.select(*keys).distinct(), list(keys), "left_anti")
    return primary.withColumn("feed", F.lit("primary")).unionByName(extra.withColumn("feed", F.lit("recovery")))


def reconciliation(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """(keys, a, b, difference, status) of two tables, rows of either kept."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), list(keys), "full")
    difference = F.abs(F.col("a") - F.col("b"))
    status = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(difference <= tolerance, "equal").otherwise("different")
    return both.select(*keys, "a", "b", difference.alias("difference"), status.alias("status"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all of the cluster shares, as spark.checkpoint.dir names it.

    Where that is unset, a folder of this machine serves a local session, and a cluster gets an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="chronopanel-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """df written to the shared folder, among this application's tables, and read back, for what several branches of a plan read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written by materialized(): once its results are saved, nothing reads them."""
    fs, at = _file_system(spark, f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}")
    fs.delete(at, True)


def hashed_rows(rows: DataFrame, columns: Sequence[str], snapshot: str, hour: int) -> DataFrame:
    """(date, available_at, record_hash): when each session's row is known, and a hash of what it says, with the snapshot that it is of.

    The values are hashed as a JSON list of texts, so that neither a separator within one nor a null can pass for something else.
    """
    said = F.to_json(F.array(*(F.col(c).cast("string") for c in columns), F.lit(snapshot)))
    return rows.select("date", F.timestamp_add("HOUR", F.lit(hour), F.col("date").cast("timestamp")).alias("available_at"), F.sha2(said, 256).alias("record_hash"))


MANIFEST = "manifest.json"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish_bundle(tables: dict[str, tuple[DataFrame, Sequence[str]]], path: str, note: str = "") -> None:
    """Write tables (name: rows and their keys) as one bundle: each staged, read back and hashed, then one manifest put in place by a rename.

    A reader that finds no manifest sees nothing, whatever has been written; a bundle is published once. Repeated keys
    end it before the manifest. Staged folders have names of their own, so a second try doesn't meet the remains of a first.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    fs, final = _file_system(spark, f"{path}/{MANIFEST}")
    if fs.exists(final):
        raise FileExistsError(f"{path} is published")
    entries = []
    for name, (df, keys) in sorted(tables.items()):
        if not name.isidentifier():
            raise ValueError(f"not a table's name: {name!r}")
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{path}/{folder}")
        back = spark.read.schema(df.schema).parquet(f"{path}/{folder}")
        if repeated_keys(back, keys).limit(1).count():
            raise ValueError(f"repeated keys {list(keys)} in {name}")
        said = content_hash(back, sorted(back.columns)).first()
        entries.append({"name": name, "folder": folder, "keys": list(keys), "schema": back.schema.json(), "n_rows": said["n_rows"], "content": said["content"]})
    _, staged = _file_system(spark, f"{path}/_{MANIFEST}-{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(json.dumps({"note": note, "tables": entries}, sort_keys=True).encode())
    out.close()
    if not fs.rename(staged, final):
        raise FileExistsError(f"{path} was published meanwhile")


def bundle_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a published bundle; FileNotFoundError where there is none."""
    fs, final = _file_system(spark, f"{path}/{MANIFEST}")
    if not fs.exists(final):
        raise FileNotFoundError(f"no bundle is published in {path}")
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])


def read_bundle(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a published bundle."""
    entry = next(e for e in bundle_manifest(spark, path)["tables"] if e["name"] == name)
    return spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{path}/{entry['folder']}")


def bundle_audit(spark: SparkSession, path: str) -> DataFrame:
    """(name, n_rows, is_intact): the tables of a bundle, and whether they still hold what the manifest names."""
    found = []
    for entry in bundle_manifest(spark, path)["tables"]:
        back = read_bundle(spark, path, entry["name"])
        now = content_hash(back, sorted(back.columns))
        same = (F.col("n_rows") == entry["n_rows"]) & (F.col("content") == entry["content"])
        found.append(now.select(F.lit(entry["name"]).alias("name"), "n_rows", same.alias("is_intact")))
    return reduce(DataFrame.unionByName, found)
