"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key by Lamping and Veach's jump consistent hash, for a whole array at once."""
    key, out = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    live, at = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(live):
        out[live] = at
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        at = ((out[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = at < shards
        live, at = live[on], at[on]
    return out


def key_of(value: Column) -> Column:
    """The 64-bit key of a stable id, as decimal text: the first half of the MD5 of the id's text; null has a key of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("\x00null"))), 1, 16), 16, 10)


def shard_of(value: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, that an id alone decides."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(np.array([int(k) for k in keys], np.uint64), shards).astype(np.int32))

    return jump(key_of(value))


def assign_shards(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the id and the number of shards decide, so rows with equal ids share a shard and appending
    a shard moves rows only into it (grown_shard is the shard among shards + 1). size is the text's UTF-8 bytes
    plus 16 (null text: 16, and the checksum of the empty text). Slots count from 0 without gaps within a
    shard, in no promised order: rows are numbered within the partitions that hold them, and each partition's
    start is the sum of the counts before it, so no task sees a whole shard. Null ids are placed as one id.
    Other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    placed = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col(id_col), shards).alias("shard"),
        shard_of(F.col(id_col), shards + 1).alias("grown_shard"),
    )
    placed = checkpointed(placed.withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy("shard", "__part").orderBy(F.lit(1))
    numbered = placed.withColumn("__row", F.row_number().over(own)).join(starts, ["shard", "__part"])
    return numbered.select(
        id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__start") + F.col("__row") - 1).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int, *, id_col: str = "doc_id", shard_col: str = "shard") -> None:
    """Write whole rows as Parquet, one folder for each shard ({shard_col}=0, 1, ...), spread over many tasks.

    A column of `docs` that has that name already, whatever the case, is an error: name another one.
    """
    if shard_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {shard_col!r} already; name another one by shard_col")
    docs.withColumn(shard_col, shard_of(F.col(id_col), shards)).write.mode("errorifexists").partitionBy(shard_col).parquet(path)
