"""Feeds of postings in four shapes, read from landed JSON into one schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_remote, unescape
from ..operators.location import resolve_locations
from ..schemas import ATS, NORMALISED

#: Schemas of the payloads, one for each shape; fields that nothing reads are left out.
FEED_A = "struct<jobs:array<struct<id:string,title:string,absolute_url:string,location:string,content:string>>>"
FEED_B = "array<struct<id:variant,text:variant,hostedUrl:string,categories:struct<location:string>,workplaceType:string,descriptionPlain:string>>"
FEED_C = "struct<jobs:array<struct<id:variant,title:variant,location:string,isRemote:boolean,jobUrl:string,descriptionPlain:string>>>"


class FeedError(ValueError):
    """A feed of an unknown kind."""


def _normalised(df: DataFrame, ats: str, *, job_id: Column, title: Column, body: Column, place: Column, remote: Column, url: Column, bad: Column, pay: tuple = (None, None)) -> DataFrame:
    """The common columns, without the places resolved, and `bad`, whether the record lacks what it must have."""
    return df.select(
        "board_token",
        "ordinal",
        F.lit(ats).alias("source_ats"),
        job_id.cast("string").alias("source_job_id"),
        title.alias("title"),
        F.coalesce(body, F.lit("")).alias("description"),
        F.coalesce(place, F.lit("")).alias("location"),
        (F.coalesce(remote, F.lit(False)) | is_remote(place)).alias("is_remote"),
        *[(F.lit(None) if p is None else p).cast("int").alias(n) for p, n in zip(pay, ("salary_min", "salary_max"), strict=True)],
        F.coalesce(url, F.lit("")).alias("source_url"),
        F.coalesce(bad, F.lit(True)).alias("bad"),
    )


def _jobs(boards: DataFrame, jobs: Column) -> DataFrame:
    """One row for each record; a payload that does not parse leaves one record without fields.

    A board may have several payloads, its pages; then `first` is what a page's ordinals start from.
    """
    first = F.col("first") if "first" in boards.columns else F.lit(0)
    broken = F.when(jobs.isNull(), F.array(F.lit(None).cast("int")))
    parsed = boards.select("board_token", first.alias("__first"), jobs.alias("__jobs"), broken.alias("__broken"))
    good = parsed.where("__jobs is not null").select("board_token", "__first", F.posexplode("__jobs").alias("__at", "j")).select("board_token", (F.col("__first") + F.col("__at")).alias("ordinal"), "j")
    none = parsed.where("__jobs is null").select("board_token", F.col("__first").alias("ordinal"))
    return good.unionByName(none, allowMissingColumns=True)


def feed_a(boards: DataFrame) -> DataFrame:
    """(board_token, payload): an object of jobs; the body is HTML-unescaped once; bad without id or title."""
    df = _jobs(boards, F.from_json("payload", FEED_A)["jobs"])
    j = F.col("j")
    place = F.get_json_object(j["location"], "$.name")
    return _normalised(df, "greenhouse", job_id=j["id"], title=j["title"], body=unescape(j["content"]), place=place, remote=F.lit(False), url=j["absolute_url"], bad=j["id"].isNull() | F.coalesce(j["title"] == "", F.lit(True)))


def _falsy(c: Column) -> Column:
    """Whether a JSON value counts as none: null, false, the number 0, or an empty text, list or object; the texts "0" and "false" do not."""
    said, text = c.cast("string"), F.schema_of_variant(c) == "STRING"
    return F.coalesce((said == "") | (~text & (said.isin("false", "[]", "{}") | (said.try_cast("double") == 0))), F.lit(True))


def feed_b(boards: DataFrame) -> DataFrame:
    """(board_token, payload): a bare array; remote by its flag or the place's text; bad with an id or title that is empty, too."""
    df = _jobs(boards, F.from_json("payload", FEED_B))
    j = F.col("j")
    return _normalised(df, "lever", job_id=j["id"], title=j["text"].cast("string"), body=j["descriptionPlain"], place=j["categories"]["location"], remote=j["workplaceType"] == "remote", url=j["hostedUrl"], bad=_falsy(j["id"]) | _falsy(j["text"]))


def feed_c(boards: DataFrame) -> DataFrame:
    """(board_token, payload): an object of jobs with a remote flag of their own."""
    df = _jobs(boards, F.from_json("payload", FEED_C)["jobs"])
    j = F.col("j")
    return _normalised(df, "ashby", job_id=j["id"], title=j["title"].cast("string"), body=j["descriptionPlain"], place=j["location"], remote=j["isRemote"], url=j["jobUrl"], bad=_falsy(j["id"]) | _falsy(j["title"]))


def feed_d(records: DataFrame) -> DataFrame:
    """Flat records (board_token, ordinal, ats_id, title, description, location, is_remote, salary_min, salary_max, url): the only shape with pay; a null id is ''."""
    c = F.col
    return _normalised(
        records, "workday", job_id=F.coalesce(c("ats_id").cast("string"), F.lit("")), title=c("title"), body=c("description"), place=c("location"), remote=c("is_remote"), url=c("url"), bad=F.lit(False), pay=(c("salary_min"), c("salary_max"))
    )


#: Readers by ats; a new feed is added here.
FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = dict(zip(ATS, (feed_a, feed_b, feed_c, feed_d), strict=True))


def unify_feeds(feeds: dict[str, DataFrame]) -> DataFrame:
    """All feeds in one schema, by ats; an unknown one is an error."""
    out = None
    for ats, df in feeds.items():
        if ats not in FEEDS:
            raise FeedError(f"no feed reader for {ats!r}")
        part = FEEDS[ats](df)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FeedError("no feeds")
    return out


def placed(records: DataFrame, gaz: dict[str, DataFrame]) -> DataFrame:
    """Good records with their places resolved: board_token, ordinal and NORMALISED's columns."""
    out = resolve_locations(records, gaz)
    return out.select("board_token", "ordinal", *[F.col(f.name).cast(f.dataType) for f in NORMALISED.fields])


def split_bad(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, failed): records of boards without a bad record, and the boards that have one; one bad record fails its whole board."""
    failed = records.groupBy("source_ats", "board_token").agg(F.bool_or("bad").alias("bad")).where("bad").select("source_ats", "board_token")
    return records.join(failed, ["source_ats", "board_token"], "left_anti").drop("bad"), failed
