"""The pipeline by micro-batches: landed feed payloads to places, a snapshot, tags and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_list
from ..operators import gazetteer, location, matching, rules, telemetry, upsert
from ..schemas import ATS, POSTING
from ..session import checkpointed
from ..sources import feeds
from ..sources.state import manifest, read_snapshot, versions, write_buckets, write_snapshot

#: Landed records: the normalised columns, the board they come from and their order in it.
LANDED = "source_ats string, board_token string, ordinal int, source_job_id string, title string, description string, location string, is_remote boolean, location_city string, location_region string, location_country string, location_resolved boolean, location_alias_version string, salary_min int, salary_max int, source_url string"
_MATCHES = "user_id long, posting_id string, match_score double, match_status string, matched_tags array<string>, computed_at timestamp"
#: Landed payloads: what a board of a platform sent, as JSON.
PAYLOADS = "source_ats string, board_token string, payload string"
#: The fields of a flat record, the payload of the platform whose records come one by one.
_FLAT = "ordinal int, ats_id string, title string, description string, location string, is_remote boolean, salary_min int, salary_max int, url string"


#: Buckets of a state table, and over how many of them a board's postings are spread.
BUCKETS, SPREAD = 256, 8


def state_at(spark: SparkSession, path: str, schema, below: int | None = None, only: list[int] | None = None) -> DataFrame:
    try:
        return read_snapshot(spark, path, below, only=only)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)


def posting_id() -> Column:
    return F.concat_ws(":", "source_ats", "source_job_id")


def as_matched(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumn("posting_id", posting_id()).withColumn("employer_slug", F.col("employer"))


def posting_bucket(n: int, employer: Column | None = None, sub: Column | None = None) -> Column:
    """A posting's bucket: those of an employer at a platform are in SPREAD of n (a multiple of it), as they are compared together."""
    sub = F.pmod(F.xxhash64("source_job_id"), F.lit(SPREAD)) if sub is None else sub
    own = F.pmod(F.xxhash64("source_ats", F.col("employer") if employer is None else employer), F.lit(n // SPREAD))
    return (own * SPREAD + sub).cast("int")


def match_bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("posting_id"), F.lit(n)).cast("int")


def _numbers(df: DataFrame) -> list[int]:
    """Numbers of buckets, of which there are no more than buckets."""
    return sorted(r[0] for r in df.distinct().collect())


def _in_buckets(spark: SparkSession, path: str, below: int, n: int) -> bool:
    """Whether the state before is in n buckets (or there is none), so that some can be replaced."""
    found = [v for v in versions(spark, path) if v < below]
    said = manifest(spark, path, found[-1]) if found else {"n": n}
    return said is not None and said["n"] == n


def touched_buckets(current: DataFrame, batch: DataFrame, read: DataFrame, n: int) -> list[int]:
    """Buckets that a round may change: of employers read, of postings that the batch has and that are known with another employer, of flagged ones."""
    subs = read.select("source_ats", "employer").distinct().withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    keys = batch.select("source_ats", "source_job_id").distinct()
    known = current.join(keys, ["source_ats", "source_job_id"], "left_semi").select(posting_bucket(n))
    flagged = current.where("needs_classification").select(posting_bucket(n))
    return _numbers(subs.select(posting_bucket(n, sub=F.col("sub"))).union(known).union(flagged))


def read_payloads(payloads: DataFrame, gaz: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(records, failed): landed payloads in LANDED's columns, places resolved, without the boards that have a bad record; and those boards."""
    by_ats = {ats: payloads.where(F.col("source_ats") == ats) for ats in ATS}
    flat = F.from_json("payload", _FLAT)
    by_ats["workday"] = by_ats["workday"].select("board_token", flat.alias("r")).select("board_token", "r.*")
    good, failed = feeds.split_bad(feeds.unify_feeds(by_ats))
    return feeds.placed(good, gaz), failed


def tick(spark: SparkSession, batch: DataFrame, sources: DataFrame, profiles: DataFrame, state_dir: str, version: int, ruleset: dict = rules.RULESET_V1, *, rematch_on: str = "tags", failed: DataFrame | None = None, boards: DataFrame | None = None, buckets: int | None = None) -> None:
    """One round: upsert the batch, classify what is flagged, match what changed; each state is a new version.

    Only `boards` are compared, by default those in the batch, so a board that sent nothing closes nothing, nor does
    one of the `failed`.
    What is matched anew are postings that got other tags, or with rematch_on="content" also those created, reopened
    or updated. A round that is run again after a failure starts from the states before its version, replaces what
    was left half-written and goes on where it broke off, so it ends in the same states.
    With `buckets` the states are in so many (a multiple of SPREAD), of which a round reads and writes those it touches.
    """
    if rematch_on not in ("tags", "content"):
        raise ValueError(f"no such rule: {rematch_on!r}")
    if version in versions(spark, f"{state_dir}/matches"):
        return
    boards = batch.select("source_ats", "board_token").distinct() if boards is None else boards
    read = sources.join(boards, ["source_ats", "board_token"], "left_semi")
    if failed is not None:
        read = read.join(failed, ["source_ats", "board_token"], "left_anti")
    at, matched = f"{state_dir}/postings", f"{state_dir}/matches"
    if version not in versions(spark, at):
        touched = None
        current = state_at(spark, at, POSTING, version)
        if buckets and _in_buckets(spark, at, version, buckets):
            touched = touched_buckets(current, batch, read, buckets)
            current = state_at(spark, at, POSTING, version, touched) if versions(spark, at) else current
        current = current.select(*[f.name for f in POSTING.fields])
        merged = upsert.upsert(current, batch, read, F.current_timestamp()).withColumn("id", posting_id())
        tagged, _ = rules.classify_pending(merged, ruleset)
        before = current.select(posting_id().alias("id"), F.col("classification_tags").alias("before"))
        changed = ~F.col("classification_tags").eqNullSafe(F.coalesce("before", F.array().cast("array<string>")))
        if rematch_on == "content":
            changed = changed | F.coalesce(F.col("outcome").isin("created", "reopened", "updated"), F.lit(False))
        now = tagged.join(before, "id", "left").withColumn("rematch", changed).drop("before", "id", "outcome")
        if buckets:
            write_buckets(now, at, version, bucket=posting_bucket(buckets), n=buckets, touched=touched)
        else:
            write_snapshot(now, at, version)
    written = manifest(spark, at, version)
    # what is flagged in other buckets was matched in an earlier round
    postings = as_matched(read_snapshot(spark, at, version + 1, only=written["touched"] if written else None))
    ids = postings.where("rematch").select("posting_id")
    if not buckets:
        new = matching.match_postings(state_at(spark, matched, _MATCHES, version), postings, profiles, ids, now=F.current_timestamp())
        write_snapshot(new, matched, version)
        return
    touched = _numbers(ids.select(match_bucket(buckets))) if _in_buckets(spark, matched, version, buckets) else None
    some = touched if versions(spark, matched) else None
    new = matching.match_postings(state_at(spark, matched, _MATCHES, version, some), postings, profiles, ids, now=F.current_timestamp())
    write_buckets(new, matched, version, bucket=match_bucket(buckets), n=buckets, touched=touched)


def _stream(landed: DataFrame, each, state_dir: str):
    query = landed.writeStream.foreachBatch(each).option("checkpointLocation", f"{state_dir}/checkpoint")
    return query.trigger(availableNow=True).start()


def run_pipeline_stream(spark: SparkSession, in_dir: str, state_dir: str, sources: DataFrame, profiles: DataFrame, ruleset: dict = rules.RULESET_V1, *, buckets: int | None = BUCKETS, **kw):
    """Read the records (LANDED) that have landed since the last run, in micro-batches, and stop; the checkpoint keeps what was done."""
    return _stream(spark.readStream.schema(LANDED).json(in_dir), lambda batch, n: tick(spark, batch, sources, profiles, state_dir, n, ruleset, buckets=buckets, **kw), state_dir)


def run_feed_stream(spark: SparkSession, in_dir: str, state_dir: str, sources: DataFrame, profiles: DataFrame, gaz: dict[str, DataFrame], ruleset: dict = rules.RULESET_V1, *, buckets: int | None = BUCKETS, **kw):
    """The same from what boards sent (PAYLOADS): feeds, places, upsert, tags and matches in one run."""
    look = gazetteer.prepared(gaz)

    def each(batch: DataFrame, n: int) -> None:
        records, failed = read_payloads(batch, look)
        boards = batch.select("source_ats", "board_token").distinct()  # one that sent an empty list has no record, and closes all
        tick(spark, records, sources, profiles, state_dir, n, ruleset, failed=failed, boards=boards, buckets=buckets, **kw)

    return _stream(spark.readStream.schema(PAYLOADS).json(in_dir), each, state_dir)


#: What a user saves of a profile: lists as comma-separated texts.
EDITS = "user_id long, ts timestamp, seq long, target_titles string, target_tags string, target_locations string, excluded_employers string, min_salary int, remote_pref string, is_active boolean"
_LISTS = ("target_titles", "target_tags", "target_locations", "excluded_employers")


def edited_profiles(edits: DataFrame, gaz: dict[str, DataFrame], *, gap: str = "10 seconds") -> DataFrame:
    """The profiles that a log of saves (EDITS) ends in, places normalised: of saves less than `gap` apart the last counts, and of those the last."""
    said = [c for c in edits.columns if c not in ("user_id", "ts", "seq")]
    settled = telemetry.debounce(edits.withColumn("said", F.struct(*said)), "user_id", seq="seq", gap=gap, payload="said")
    last = settled.groupBy("user_id").agg(F.max_by("said", "last_ts").alias("said")).select("user_id", "said.*")
    return as_profiles(last, gaz)


def as_profiles(last: DataFrame, gaz: dict[str, DataFrame]) -> DataFrame:
    """Saved fields as profiles: lists parsed and places normalised."""
    listed = last.withColumns({c: csv_list(F.col(c)) for c in _LISTS})
    return listed.join(location.normalize_targets(listed, gaz), "user_id")


def apply_edits(edits: DataFrame, profiles: DataFrame, postings: DataFrame, matches: DataFrame, gaz: dict[str, DataFrame], now: Column) -> tuple[DataFrame, DataFrame]:
    """(profiles, matches) after the saves of a log: edited profiles replace those of their users and are matched anew."""
    return replace_profiles(edited_profiles(edits, gaz), profiles, postings, matches, now)


def replace_profiles(edited: DataFrame, profiles: DataFrame, postings: DataFrame, matches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    rest = profiles.join(edited.select("user_id"), "user_id", "left_anti")
    everyone = rest.unionByName(edited.select(*profiles.columns))
    return everyone, matching.rematch_profiles(matches, postings, everyone, edited.select("user_id"), now)


def run_edit_stream(spark: SparkSession, in_dir: str, state_dir: str, profiles: DataFrame, postings: DataFrame, matches: DataFrame, gaz: dict[str, DataFrame], *, wait: int = 10, every: str = "1 second", now: Column | None = None):
    """Saves (EDITS, JSON lines) that land in a folder refresh their users' profiles and matches, once a user has been still for `wait` seconds.

    The states are `profiles` and `matches` below state_dir, a version for each micro-batch in which a user settled;
    the given tables are what they begin as. A micro-batch that is run again after a failure starts from the versions
    before its own and goes on where it broke off; the saves that wait are in the checkpoint. Nothing else may write
    these two tables meanwhile: rounds of postings (`tick`) have a folder of their own.
    """
    look = gazetteer.prepared(gaz)
    at = {"profiles": f"{state_dir}/profiles", "matches": f"{state_dir}/matches"}
    when = F.current_timestamp() if now is None else now
    said = [n.strip().split(" ") for n in EDITS.split(",") if n.strip().split(" ")[0] not in ("user_id", "ts", "seq")]

    def before(name: str, first: DataFrame, n: int) -> DataFrame:
        return read_snapshot(spark, at[name], n) if any(v < n for v in versions(spark, at[name])) else first

    def each(batch: DataFrame, n: int) -> None:
        # read whole, also where nothing is left to do, as Spark stores the state of a batch while it is read
        saved = F.from_json("said", ", ".join(" ".join(x) for x in said))
        last = checkpointed(batch.select(F.col("user_id").cast("long").alias("user_id"), saved.alias("s")).select("user_id", "s.*"))
        if n in versions(spark, at["matches"]) or last.isEmpty():
            return
        if n not in versions(spark, at["profiles"]):
            edited = as_profiles(last, look).select(*profiles.columns)
            rest = before("profiles", profiles, n).select(*profiles.columns).join(last.select("user_id"), "user_id", "left_anti")
            marked = rest.unionByName(edited).join(last.select("user_id", F.lit(n).cast("long").alias("edited_in")), "user_id", "left")
            write_snapshot(marked, at["profiles"], n)
        everyone = read_snapshot(spark, at["profiles"], n + 1)
        ids = everyone.where(F.col("edited_in") == n).select("user_id")
        new = matching.rematch_profiles(before("matches", matches, n), postings, everyone.select(*profiles.columns), ids, when)
        write_snapshot(new, at["matches"], n)

    saves = spark.readStream.schema(EDITS).json(in_dir).withColumn("said", F.to_json(F.struct(*[x[0] for x in said])))
    query = telemetry.settled(saves, "user_id", wait=wait).writeStream.foreachBatch(each).option("checkpointLocation", f"{state_dir}/checkpoint")
    return query.trigger(processingTime=every).start()
