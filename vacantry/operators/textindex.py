"""A stored inverted index over postings: entries clustered by stem, added to by segments, of which a query reads its terms' folders only."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import search as fts
from ..sources import state

#: Folders of a segment; a stem's entries lie in one.
BUCKETS = 256
#: Segments that an index has at most before they are merged.
SEGMENTS = 8
ENTRY = "stem string, token string, id long, stamp string"


def _bucket(stem: Column) -> Column:
    return F.crc32(stem.cast("binary")) % F.lit(BUCKETS)


def _last(spark: SparkSession, path: str) -> tuple[int, dict[str, list[int]]]:
    """The last version and its segments: the folder of each and which buckets it has."""
    found = state.versions(spark, path)
    return (found[-1], state.manifest(spark, path, found[-1])["segments"]) if found else (-1, {})


def _read(spark: SparkSession, path: str, segments: dict[str, list[int]], wanted: Iterable[int]) -> DataFrame:
    folders = [f"{path}/{s}/bucket={b}" for s, buckets in segments.items() for b in sorted(set(wanted) & set(buckets))]
    return spark.read.schema(ENTRY).parquet(*folders) if folders else spark.createDataFrame([], ENTRY)


def short_stamp(stamp: Column) -> Column:
    """A stamp as entries have it: of one of more than 12 characters, or of an odd one, 64 bits of its SHA-256, which tell a posting's contents apart."""
    text = stamp.cast("string")
    digest = F.concat(F.lit("#"), F.substring(F.base64(F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 16))), 1, 11))
    return F.when(text.rlike(r"\A[^#\s]\S{0,11}\z") | text.isNull(), text).otherwise(digest)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of a batch of rows: a row for each token, with the ids of those that have it and their stamps in lines, '' for null."""
    for batch in batches:
        said = batch.column("tokens")
        coded = said.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(said)), pc.list_value_length(said).to_numpy(zero_copy_only=False))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        row = pa.array(row[np.argsort(codes, kind="stable")])
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))]).astype("int32"))
        stamps = pc.fill_null(batch.column("stamp"), "").take(row)
        lists = [pa.ListArray.from_arrays(ends, batch.column("id").take(row)), pc.binary_join(pa.ListArray.from_arrays(ends, stamps), "\n")]
        stems = pa.array([fts.known_stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([stems, coded.dictionary, *lists], names=["stem", "token", "ids", "stamps"])


def blocks(df: DataFrame, *, id_col: str = "posting_id", stamp_col: str = "content_hash") -> DataFrame:
    """(stem, token, ids, stamps): the posting lists of each batch of rows, without a shuffle. Rows without an id are in none."""
    said = fts.tokens(F.concat_ws("\n", "title", "description"))
    each = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), short_stamp(F.col(stamp_col)).alias("stamp"), said.alias("tokens"))
    return each.mapInArrow(_blocks, "stem string, token string, ids array<long>, stamps string")


def _opened(lists: DataFrame, *more: str) -> DataFrame:
    """The entries of posting lists."""
    each = lists.select("stem", "token", *more, F.explode(F.arrays_zip("ids", F.split("stamps", "\n").alias("stamps"))).alias("p"))
    return each.select("stem", "token", F.col("p.ids").alias("id"), F.nullif(F.col("p.stamps"), F.lit("")).alias("stamp"), *more)


def entries(df: DataFrame, **names: str) -> DataFrame:
    """(stem, token, id, stamp) of every distinct token of title and description, stamps as `short_stamp` gives them."""
    return _opened(blocks(df, **names))


def _write(rows: DataFrame, path: str, version: int, others: dict[str, list[int]]) -> None:
    """A segment of `rows`, entries or posting lists, and the version that has it beside `others`.

    A segment is sorted by stem, token and id, so that ids are stored as differences in blocks, and a block's
    bounds tell whether it has a term. A stem that is far more frequent than others is split over files. Lists are
    dealt as they are, and opened where they are written.
    """
    spark, folder = rows.sparkSession, f"data/{version}-{uuid.uuid4().hex}"
    dealt = rows.withColumn("bucket", _bucket(F.col("stem")).cast("int")).hint("rebalance", "bucket")
    dealt = _opened(dealt, "bucket") if "ids" in dealt.columns else dealt
    sorted_ = dealt.sortWithinPartitions("bucket", "stem", "token", "id")
    sorted_.write.option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{folder}")
    state.commit(spark, f"{path}/v={version}", json.dumps({"segments": others | {folder: _buckets_of(spark, f"{path}/{folder}")}}))


def _buckets_of(spark: SparkSession, folder: str) -> list[int]:
    at, fs = state._at(spark, folder)
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if "=" in s.getPath().getName())


def add(df: DataFrame, path: str, **names: str) -> int:
    """Index the rows of `df`, new and changed ones alike, as one further segment; gives the version made.

    Nothing written before is read or written. What a changed posting had before is told apart by its stamp, the hash of
    its content. Of two writers of one version the second fails.
    """
    version, segments = _last(df.sparkSession, path)
    _write(blocks(df, **names), path, version + 1, segments)
    return version + 1


def merge(live: DataFrame, path: str, *, id_col: str = "posting_id", stamp_col: str = "content_hash", most: int = SEGMENTS) -> int | None:
    """More than `most` segments become one, of which entries go whose (id, stamp) no row of `live` has; gives the version made."""
    spark = live.sparkSession
    version, segments = _last(spark, path)
    if len(segments) <= most:
        return None
    now = live.select(F.col(id_col).cast("long").alias("id"), short_stamp(F.col(stamp_col)).alias("__now"))
    rows = _read(spark, path, segments, range(BUCKETS))
    kept = rows.join(now, (rows["id"] == now["id"]) & rows["stamp"].eqNullSafe(now["__now"]), "left_semi").distinct()
    _write(kept, path, version + 1, {})
    return version + 1


def read_terms(spark: SparkSession, path: str, terms: list[str], *, stemmed: bool = True) -> DataFrame:
    """The entries of stems (or of the tokens themselves), out of those stems' folders and no other."""
    wanted = {zlib.crc32((t if stemmed else fts.stem_word(t)).encode()) % BUCKETS for t in terms}
    return _read(spark, path, _last(spark, path)[1], wanted).where(F.col("stem" if stemmed else "token").isin(terms))


def search(df: DataFrame, path: str, query: str, *, stemmed: bool = True, id_col: str = "posting_id", stamp_col: str = "content_hash") -> DataFrame:
    """Rows of `df` whose title and description hold every term of the query, by the index; texts are not read.

    The rows are those of `functions.search.search` where all of `df` were added with the content they have. A row that was
    not added since it changed is not found. A query of stop words only matches nothing.
    """
    terms = fts.query_terms(query, stemmed)
    if not terms:
        return df.limit(0)
    said = read_terms(df.sparkSession, path, terms, stemmed=stemmed).select("id", "stamp", F.col("stem" if stemmed else "token").alias("term"))
    full = said.groupBy("id", "stamp").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms)).select(F.col("id").alias("__id"), F.col("stamp").alias("__stamp"))
    return df.join(full, (df[id_col] == full["__id"]) & short_stamp(df[stamp_col]).eqNullSafe(full["__stamp"]), "left_semi")
