"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, join_groups, shuffle_partitions, stored

KEY = ["digest", "length", "check"]
RUN = "digest string, length long, check long, id long, row long, n long"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    """(id, digest, length, check, row) of each row: SHA-256, bytes and an independent hash of the normalised text, and its number."""
    text = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.sha2(text, 256).alias("digest"),
        F.octet_length(text).cast("long").alias("length"),
        F.xxhash64(text).alias("check"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
    )


def _merged(run: pa.Table) -> pa.Table:
    """One row for each key of a table sorted by (key, id, row), nulls last: the first row's id, and the sum of n."""
    if run.num_rows < 2:
        return run
    new = np.zeros(run.num_rows, bool)
    new[0] = True
    for k in KEY:
        c = run[k].combine_chunks()
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    out = run.take(pa.array(starts))
    # the field as it came, as a stream's next batch has it too
    return out.set_column(out.schema.get_field_index("n"), out.schema.field("n"), pa.array(np.add.reduceat(run["n"].to_numpy(), starts)))


def _merge_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge runs that arrive as one sorted stream; what a batch's last key has is carried into the next batch."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = _merged(pa.concat_tables([held, t]) if held is not None else t)
        held = t.slice(max(0, t.num_rows - 1))
        yield from t.slice(0, max(0, t.num_rows - 1)).to_batches()
    if held is not None:
        yield from held.to_batches()


def tree_merge(rows: DataFrame, *, fan_in: int = 8, width: int | None = None) -> DataFrame:
    """Merge digest rows of RUN's columns to one row for each key: smallest (id, row) and total n.

    Every partition first sorts its digests into a run and merges equal keys. Then the partitions exchange runs
    in rounds, each of several binomial steps: a partition's number is written in digits of base `fan_in`, and in
    a round it deals its run to the partners that differ in one digit, by that digit of the digest's own
    partition, and merges the runs it receives. After the last round each digest's rows have met in its own
    partition. A key that many partitions hold arrives at most once from each partner, so copies shrink by the
    fan-in at every level. Ids meet only where SHA-256, length and a second hash all agree.
    """
    spark = rows.sparkSession
    width = max(2, width or shuffle_partitions(spark))
    fan_in = max(2, fan_in)
    radices = []
    while np.prod(radices, dtype=float) < width:
        radices.append(min(fan_in, -(-width // int(np.prod(radices)))))
    size = int(np.prod(radices))
    target = (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * size / F.lit(float(2**32))).cast("int")
    order = [*KEY, F.col("id").asc_nulls_last(), "row"]

    def merge(df: DataFrame) -> DataFrame:
        return df.select(*[f.split()[0] for f in RUN.split(", ")], "owner").sortWithinPartitions(*order).mapInArrow(_merge_stream, RUN + ", owner int")

    run = merge(rows.withColumn("owner", F.pmod(F.spark_partition_id(), F.lit(size)).cast("int")))
    step = 1
    for radix in radices:
        digit = lambda x: F.floor(x / F.lit(step)).cast("int") % F.lit(radix)  # noqa: B023, E731
        run = run.withColumn("owner", (F.col("owner") + (digit(target) - digit(F.col("owner"))) * F.lit(step)).cast("int"))
        run = merge(run.repartitionById(size, F.col("owner")))
        step *= radix
    return run.drop("owner")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is one space; null counts as empty. The
    smallest id of a group stays; a null id stays only where all are null, and of rows with the smallest id
    repeated one stays. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = checkpointed(digests(docs, id_col, text_col))
    return _grouped(rows, fan_in).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def _merged_groups(rows: DataFrame, fan_in: int) -> DataFrame:
    merged = tree_merge(rows.withColumn("n", F.lit(1).cast("long")), fan_in=fan_in)
    return merged.select(*KEY, F.col("id").alias("keep_id"), F.col("row").alias("__row"), F.col("n").alias("group_size"))


def _grouped(rows: DataFrame, fan_in: int) -> DataFrame:
    return join_groups(rows, checkpointed(_merged_groups(rows, fan_in)), KEY, "group_size").withColumn("kept", F.col("row") == F.col("__row"))


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """The rows of `docs` that stay, one for each group of equal texts, with all their columns.

    It is the one with the smallest id, null ids last, and of equal ids the first as stored: rows are decided on
    one by one, also where ids are repeated or null. An empty table gives an empty result.
    """
    row = free_name(docs, "__row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = checkpointed(digests(numbered, id_col, text_col, F.col(row)))
    kept = _merged_groups(rows, fan_in).select(F.col("__row").alias("__kept"))
    return numbered.join(kept, numbered[row] == kept["__kept"], "left_semi").drop(row)
