"""Keyed snapshot comparison of a source's batch with what is known, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_hash, slugify

KEY = ("source_ats", "source_job_id")
CONTENT = ("title", "description", "location", "is_remote", "location_city", "location_region", "location_country", "location_resolved", "location_alias_version", "salary_min", "salary_max", "source_url", "content_hash")


def last_of_batch(batch: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row for each key of a batch: the last by `ordinal`."""
    own = Window.partitionBy(*KEY).orderBy(F.col(ordinal).desc())
    return batch.withColumn("__r", F.row_number().over(own)).where("__r = 1").drop("__r")


def upsert(current: DataFrame, batch: DataFrame, sources: DataFrame, now: Column, *, ordinal: str = "ordinal") -> DataFrame:
    """The next snapshot, with `outcome` of each row: created, reopened, updated, unchanged, closed, or null (not concerned).

    current: POSTING's columns. batch: the normalised columns and `ordinal`, the order of processing. sources:
    source_ats, board_token and employer of the boards read, an empty board too; batch rows carry board_token, and
    a new posting's employer is its source's. Open postings of an (ats, employer) that was read close if no batch of it
    has their id, so an empty batch closes all. Reopened ones lose their tags; updated ones keep them; both and
    created ones are flagged.
    """
    sources = sources.select("source_ats", "board_token", "employer").distinct()
    new = last_of_batch(batch.drop("employer"), ordinal).join(sources, ["source_ats", "board_token"]).withColumn("content_hash", content_hash())
    new = new.select(*KEY, F.struct(*[c for c in CONTENT], "employer").alias("b"))
    read = sources.select("source_ats", "employer").distinct().withColumn("read", F.lit(True))
    old = current.join(read, ["source_ats", "employer"], "left").withColumn("read", F.coalesce("read", F.lit(False)))
    old = old.select(*KEY, F.struct(*CONTENT, "employer", "status", "classification_tags", "ruleset_version", "needs_classification", "scraped_at", "read").alias("a"))
    both = old.join(new, list(KEY), "full")
    a, b = F.col("a"), F.col("b")
    outcome = (
        F.when(a.isNull(), "created")
        .when(b.isNotNull() & (a["status"] == "closed"), "reopened")
        .when(b.isNotNull() & ~a["content_hash"].eqNullSafe(b["content_hash"]), "updated")
        .when(b.isNotNull(), "unchanged")
        .when((a["status"] == "open") & a["read"], "closed")
    )
    fresh = F.col("outcome").isin("created", "reopened", "updated")
    seen = b.isNotNull()
    out = both.withColumn("outcome", outcome)
    return out.select(
        *KEY,
        *[F.when(fresh, b[c]).otherwise(a[c]).alias(c) for c in CONTENT],
        F.coalesce(a["employer"], b["employer"]).alias("employer"),
        F.when(seen, "open").when(F.col("outcome") == "closed", "closed").otherwise(a["status"]).alias("status"),
        F.when(F.col("outcome").isin("created", "reopened"), F.array().cast("array<string>")).otherwise(a["classification_tags"]).alias("classification_tags"),
        F.when(F.col("outcome").isin("created", "reopened"), "").otherwise(a["ruleset_version"]).alias("ruleset_version"),
        F.when(fresh, True).otherwise(a["needs_classification"]).alias("needs_classification"),
        F.when(seen, now).otherwise(a["scraped_at"]).alias("scraped_at"),
        "outcome",
    )


def pending(snapshot: DataFrame) -> DataFrame:
    """Keys that need classification after an upsert."""
    return snapshot.where(F.col("outcome").isin("created", "reopened", "updated")).select(*KEY)


def ingest_stats(snapshot: DataFrame, sources: DataFrame, failed: DataFrame) -> DataFrame:
    """Counts of each outcome for each (ats, employer) of an active source; a failed source has an error and no counts."""
    count = lambda o: F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)).cast("long").alias(o)
    counts = snapshot.groupBy("source_ats", "employer").agg(*[count(o) for o in ("created", "reopened", "updated", "unchanged", "closed")])
    active = sources.where("is_active").select("source_ats", "board_token", "employer")
    bad = failed.select("source_ats", "board_token", F.lit(True).alias("failed"))
    rows = active.join(bad, ["source_ats", "board_token"], "left").join(counts, ["source_ats", "employer"], "left")
    ok = F.col("failed").isNull()
    outcomes = [F.when(ok, F.coalesce(F.col(o), F.lit(0))).alias(o) for o in ("created", "reopened", "updated", "unchanged", "closed")]
    return rows.select("source_ats", "board_token", *outcomes, F.when(ok, F.lit(None)).otherwise("parse error").alias("error"))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df`, failing when it runs if a key occurs twice."""
    own = Window.partitionBy(*keys)
    once = F.when(F.count(F.lit(1)).over(own) > 1, F.raise_error(F.lit(f"key {keys} is not unique"))).otherwise(F.lit(True))
    return df.withColumn("__once", once).where("__once").drop("__once")


def assign_employers(requests: DataFrame) -> DataFrame:
    """(name, seq) requests to the employer slug of each: one employer for each (slug, trimmed name, whatever its case).

    The first name seen with a slug has the slug itself, the others -2, -3, ... in the order first seen. A name
    seen again keeps its employer (a deliberate choice: names are compared with all employers of the slug).
    """
    slugs = requests.select("name").distinct().select(F.col("name").alias("__name"), slugify(F.col("name")).alias("base"))
    keyed = requests.join(slugs, F.col("name").eqNullSafe(F.col("__name"))).drop("__name").withColumn("key", F.lower(F.trim("name")))
    first = keyed.groupBy("base", "key").agg(F.min("seq").alias("first"))
    rank = F.row_number().over(Window.partitionBy("base").orderBy("first", "key"))
    named = first.withColumn("k", rank).withColumn("slug", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("k").cast("string"))))
    return keyed.join(named.select("base", "key", "slug"), ["base", "key"]).select("seq", "name", "slug")


def register(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether each requested (ats, board_token) is registered already; carries the number of jobs found."""
    known = sources.select("ats", "board_token").distinct().withColumn("known", F.lit(True))
    out = requests.join(known, ["ats", "board_token"], "left")
    return out.select("ats", "board_token", "job_count", F.when(F.col("known"), "already_registered").otherwise("registered").alias("result"))


def coverage(postings: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rates, top): resolved share with the number of distinct unresolved strings, and the n most frequent of those."""
    bad = F.when(~F.col("location_resolved"), F.col("location"))
    rates = postings.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.col("location_resolved").cast("long")), F.lit(0)).alias("resolved"),
        F.avg(F.col("location_resolved").cast("double")).alias("rate"),
        F.count_distinct(bad).alias("distinct_unresolved"),
    )
    top = postings.where("not location_resolved").groupBy("location").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "location").limit(n)
    return rates, top


#: Texts that a sketch of the most frequent ones tracks.
TRACKED = 8192


def coverage_states(postings: DataFrame, by: str) -> DataFrame:
    """A mergeable state of coverage for each value of `by`, as a round: total, resolved, and sketches of the unresolved texts' number and frequencies.

    A state has a bounded size whatever the number of texts, so states are stored by round and old postings need not be read again.
    """
    bad = "FILTER (WHERE NOT location_resolved)"
    return postings.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.col("location_resolved").cast("long")), F.lit(0)).alias("resolved"),
        F.expr(f"hll_sketch_agg(location, 14) {bad}").alias("texts"),
        F.expr(f"approx_top_k_accumulate(location, {TRACKED}) {bad}").alias("frequent"),
    )


def coverage_over(states: DataFrame, by: str | None = None, n: int = 20) -> DataFrame:
    """(by, total, resolved, rate, distinct_unresolved, top, most_off) of states merged by `by`, or of all.

    distinct_unresolved has a standard error of 0.8 %. top holds the n most frequent unresolved texts with their counts, by
    count and then text; no count, and none of a text left out, is off by more than most_off, which is 3.5 / TRACKED of
    the unresolved. Up to TRACKED different texts all counts are exact.
    """
    merged = states.groupBy(*([by] if by else [])).agg(
        F.sum("total").alias("total"), F.sum("resolved").alias("resolved"), F.hll_union_agg("texts").alias("__texts"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("__frequent")
    )
    found = F.expr(f"approx_top_k_estimate(__frequent, {TRACKED})")
    ranked = F.array_sort(F.transform(found, lambda x: F.struct((-x["count"]).alias("less"), x["item"].alias("item"))))
    top = F.transform(F.slice(ranked, 1, n), lambda x: F.struct(x["item"].alias("location"), (-x["less"]).alias("n")))
    off = F.floor(F.lit(3.5 / TRACKED) * (F.col("total") - F.col("resolved")))
    return merged.select(*([by] if by else []), "total", "resolved", (F.col("resolved") / F.col("total")).alias("rate"), F.coalesce(F.hll_sketch_estimate("__texts"), F.lit(0)).alias("distinct_unresolved"), top.alias("top"), off.alias("most_off"))
