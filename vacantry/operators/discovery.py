"""Finding new boards and reviewing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import display_name

NEW_PER_RUN, SLOW_ATS, SLOW_BATCH = 50, "workday", 5


class BatchTooLarge(RuntimeError):
    """More approvals of the slow kind than one batch may hold."""


def new_tokens(directory: DataFrame, sources: DataFrame, discovered: DataFrame) -> DataFrame:
    """(ats, token) of the directory that are neither registered nor discovered, in whatever state."""
    known = sources.select("ats", "token").union(discovered.select("ats", "token"))
    return directory.select("ats", "token").distinct().join(known, ["ats", "token"], "left_anti")


def cap_per_ats(tokens: DataFrame, n: int = NEW_PER_RUN) -> DataFrame:
    """The first n tokens of each ats, by token."""
    own = Window.partitionBy("ats").orderBy("token")
    return tokens.withColumn("__r", F.row_number().over(own)).where(F.col("__r") <= n).drop("__r")


def queue_candidates(tokens: DataFrame, fetched: DataFrame, now: Column | None = None) -> DataFrame:
    """Pending boards of the tokens whose fetch went well, with the number of jobs and a derived name."""
    good = tokens.join(fetched.where("ok"), ["ats", "token"])
    at = F.lit(None).cast("timestamp") if now is None else now
    return good.select("ats", "token", display_name(F.col("ats"), F.col("token")).alias("derived_employer_name"), F.col("job_count").alias("discovered_job_count"), F.lit("pending").alias("status"), at.alias("discovered_at"))


def discovery_stats(directory: DataFrame, sources: DataFrame, discovered: DataFrame, fetched: DataFrame, *, n: int = NEW_PER_RUN, failed_ats: list[str] | None = None) -> DataFrame:
    """Counts for each ats and, with a null ats, over all: found, already_known, validated, failed, skipped_for_cap, search_failed."""
    new = new_tokens(directory, sources, discovered)
    tried = cap_per_ats(new, n).join(fetched, ["ats", "token"], "left")
    found = directory.select("ats", "token").distinct().groupBy("ats").agg(F.count(F.lit(1)).alias("found"))
    fresh = new.groupBy("ats").agg(F.count(F.lit(1)).alias("fresh"))
    good = F.coalesce(F.col("ok"), F.lit(False))
    done = tried.groupBy("ats").agg(F.count(F.lit(1)).alias("tried"), F.sum(good.cast("long")).alias("validated"))
    rows = found.join(fresh, "ats", "left").join(done, "ats", "left").na.fill(0)
    rows = rows.select(
        "ats", "found", (F.col("found") - F.col("fresh")).alias("already_known"), "validated", (F.col("tried") - F.col("validated")).alias("failed"),
        (F.col("fresh") - F.col("tried")).alias("skipped_for_cap"), F.col("ats").isin(failed_ats or []).alias("search_failed"),
    )
    names = ("found", "already_known", "validated", "failed", "skipped_for_cap")
    return rows.rollup("ats").agg(*[F.sum(c).alias(c) for c in names], F.coalesce(F.bool_or("search_failed"), F.lit(False)).alias("search_failed"))


def review(boards: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Boards after decisions (ats, token, decision): only pending ones change, and are stamped."""
    out = boards.join(decisions.select("ats", "token", "decision"), ["ats", "token"], "left")
    on = (F.col("status") == "pending") & F.col("decision").isin("approved", "rejected")
    on = F.coalesce(on, F.lit(False))
    return out.withColumns({"reviewed_at": F.when(on, now).otherwise(F.col("reviewed_at")), "status": F.when(on, F.col("decision")).otherwise(F.col("status"))}).drop("decision")


def count_drift(boards: DataFrame, again: DataFrame) -> DataFrame:
    """Boards whose number of jobs differs from the one discovered."""
    out = boards.join(again.select("ats", "token", F.col("job_count").alias("refetched")), ["ats", "token"])
    return out.where("discovered_job_count <> refetched").select("ats", "token", "discovered_job_count", "refetched")


def guard_batch(decisions: DataFrame, boards: DataFrame, *, ats: str = SLOW_ATS, n: int = SLOW_BATCH) -> DataFrame:
    """`decisions`, or an error if more than n pending boards of the slow ats are to be approved at once."""
    slow = decisions.where((F.col("decision") == "approved") & (F.col("ats") == ats)).join(boards.where("status = 'pending'").select("ats", "token"), ["ats", "token"], "left_semi")
    if slow.limit(n + 1).count() > n:
        raise BatchTooLarge(f"more than {n} approvals of {ats}")
    return decisions
