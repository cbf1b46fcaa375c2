"""Versioned state tables: whole snapshots, and snapshots in buckets of which a round writes only those it touches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARKER = "_SUCCESS"


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions below a path that were written completely: those with a success marker."""
    at, fs = _at(spark, f"{path}/v=*/{MARKER}")
    return sorted(int(s.getPath().getParent().getName()[2:]) for s in fs.globStatus(at) or [])


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """A table's next state as a folder of its own; readers see it when its success marker is there, so all of it or nothing.

    A version that is there completely is never replaced; what an interrupted write left of one is.
    """
    if version in versions(df.sparkSession, path):
        raise FileExistsError(f"{path}/v={version}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/v={version}")


def manifest(spark: SparkSession, path: str, version: int) -> dict | None:
    """What a version in buckets consists of: folder of each bucket, number of buckets, those touched; null for a whole snapshot."""
    at, fs = _at(spark, f"{path}/v={version}/{MARKER}")
    if not fs.getFileStatus(at).getLen():
        return None
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_snapshot(spark: SparkSession, path: str, below: int | None = None, *, only: list[int] | None = None) -> DataFrame:
    """The state of the highest version (below `below`) that was written completely; of one in buckets, of `only` those buckets."""
    found = [n for n in versions(spark, path) if below is None or n < below]
    if not found:
        raise FileNotFoundError(path)
    said = manifest(spark, path, found[-1])
    if said is None:
        if only is not None:
            raise ValueError(f"{path}/v={found[-1]} is not in buckets")
        return spark.read.parquet(f"{path}/v={found[-1]}")
    folders = [f"{path}/{f}" for b, f in said["folders"].items() if only is None or int(b) in set(only)]
    schema = StructType.fromJson(json.loads(said["schema"]))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_buckets(df: DataFrame, path: str, version: int, *, bucket: Column, n: int, touched: list[int] | None = None) -> None:
    """A version that has the rows of `df` in the buckets `touched`, and all others as they were in the version before.

    bucket: the number of a row's bucket, 0 to n - 1. Without `touched` (or where the version before was a whole
    snapshot or had another number of buckets) `df` is the whole state. A touched bucket without a row is empty
    afterwards; a row of `df` in a bucket that is not touched is an error.
    Rows go to a folder that no other writer uses, and the marker, which names the folder of each bucket, is moved into
    place where none is. So of two writers of one version the second fails, and what a writer that died left
    is never read. The driver handles one name for each bucket, and no rows.
    """
    spark = df.sparkSession
    found = versions(spark, path)
    if version in found:
        raise FileExistsError(f"{path}/v={version}")
    before = [v for v in found if v < version]
    last = manifest(spark, path, before[-1]) if before else {"n": n, "folders": {}}
    partial = touched is not None
    if partial and (last is None or last["n"] != n):
        raise ValueError(f"{path} is not in {n} buckets: write the whole state once")
    folder = f"data/{version}-{uuid.uuid4().hex}"
    rows = df.withColumn("__bucket", bucket.cast("int"))
    if partial:
        stray = F.raise_error(F.concat(F.lit("row of a bucket that is not touched: "), F.col("__bucket").cast("string")))
        rows = rows.withColumn("__bucket", F.when(F.array_contains(F.lit(list(touched) or [-1]), F.col("__bucket")), F.col("__bucket")).otherwise(stray.cast("int")))
    # the rebalance brings a bucket's rows together, and splits a bucket that is far larger than others
    rows.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{path}/{folder}")
    at, fs = _at(spark, f"{path}/{folder}")
    new = {s.getPath().getName().split("=")[1]: f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(at) if "=" in s.getPath().getName()}
    kept = {b: f for b, f in last["folders"].items() if int(b) not in set(touched)} if partial else {}
    said = {"n": n, "touched": sorted(touched) if partial else list(range(n)), "folders": kept | new, "schema": df.schema.json()}
    commit(spark, f"{path}/v={version}", json.dumps(said))


def commit(spark: SparkSession, folder: str, text: str) -> None:
    """The marker of a version with its text, written aside and moved into place, never over another."""
    jvm = spark.sparkContext._jvm
    aside, fs = _at(spark, f"{folder}/_{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    aside = fs.makeQualified(aside)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    marker, _ = _at(spark, f"{folder}/{MARKER}")
    try:
        files.rename(aside, fs.makeQualified(marker), options)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(marker):
            raise FileExistsError(folder) from e
        raise


def expire(spark: SparkSession, path: str, *, keep: int = 10) -> list[int]:
    """Remove all but the last `keep` versions and the folders that none of those left names; gives the versions removed.

    A folder of a version above the last one is left alone, as a writer may be at work on it.
    """
    found = versions(spark, path)
    old = found[:-keep] if keep > 0 else []
    used = set()
    for v in found[len(old) :]:
        used |= {f.split("/")[1] for f in (manifest(spark, path, v) or {"folders": {}})["folders"].values()}
    for v in old:
        at, fs = _at(spark, f"{path}/v={v}")
        fs.delete(at, True)
    at, fs = _at(spark, f"{path}/data")
    if found and fs.exists(at):
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name not in used and int(name.split("-")[0]) <= found[-1]:
                fs.delete(s.getPath(), True)
    return old
