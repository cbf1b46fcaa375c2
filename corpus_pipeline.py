"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantry.llm import exact, langid, mixing, pieces, simhash
from vacantry.llm.common import free_name, remove_table, stored
from vacantry.llm.queries import MIX_SEED, MIX_WEIGHTS, language_model, model_file

#: Not expressible: the stages learn a classifier and draw segmentations.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or with a doubtful language go.

    Null and empty texts have no letters. Equal texts are judged alike, whatever their ids; a null language teaches
    nothing, and where no language is learnt only texts without letters go. An empty table stays empty; further
    columns stay as they are.
    """
    return langid.keep_identified(docs, language_model(docs))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id, null ids last, and of equal ids the first as stored.

    A null text counts as empty. Rows are decided on one by one, so repeated rows leave one. An empty table stays
    empty; further columns stay as they are.
    """
    return exact.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints.

    By op2_simhash's settings: shingles of three words, at most two differing bits. Near copies that differ in
    more bits stay: of 850 texts of 100 words with one word changed, only 145 were within two bits.
    Null and empty texts have the fingerprint zero, like each other; of a component the smallest id stays, and of
    rows with that id one. An empty table stays empty; further columns stay as they are.
    """
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources have their target weights, in random order.

    A null source is of those that have no weight of their own. Rows of equal ids, null too, get equal numbers of
    copies, none as well. An empty table stays empty; columns named like mixing's own are replaced and then dropped
    unless the documents had them.
    """
    return mixing.mix(docs, MIX_WEIGHTS, other=1.0, seed=MIX_SEED).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each row's text, as pieces, with the CRC-32 of the text decoded from them in decoded_crc32.

    A row's number, in the order in which its table is stored, is part of its key, so that each copy that mixing
    made gets samples of its own, without a shuffle. A null text has no pieces and no checksum, an empty one no
    pieces and the checksum of nothing. An empty table gives no rows; further columns do not matter.
    """
    row = free_name(docs, "row")
    drawn = pieces.sample_encode(docs.withColumn(row, F.monotonically_increasing_id()), model_file=model_file(), k=2, copy_col=row, decoded=True, chunk=1 << 19)
    return drawn.withColumn("decoded_crc32", F.crc32(F.col("text").cast("binary"))).drop("text")


STAGES = [
    ("language", identify_language),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read again, and removed when the next one's is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            remove_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
