"""Reference files (company directories, place names) and versioned snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.rules import RuleError
from .state import read_snapshot, versions, write_snapshot  # noqa: F401

#: The column of a directory that is the board's token.
TOKEN_COLUMN = {"greenhouse": "slug", "lever": "slug", "ashby": "slug", "workday": "url"}
_CITY_FIELDS = "id name asciiname alternatenames latitude longitude feature_class feature_code country_code cc2 admin1_code admin2 admin3 admin4 population elevation dem timezone modified".split()
GAZETTEER_TABLES = ("countries", "regions", "cities", "ambiguous", "prefixes")


class GazetteerError(ValueError):
    """A gazetteer version is missing or malformed."""


def read_directory(df: DataFrame, ats: str) -> DataFrame:
    """(ats, token) of a directory's rows: trimmed, not empty, distinct and in order."""
    token = F.trim(F.col(TOKEN_COLUMN[ats]))
    return df.select(F.lit(ats).alias("ats"), token.alias("token")).where("token <> ''").distinct().orderBy("token")


def read_directory_csv(spark: SparkSession, path: str, ats: str) -> DataFrame:
    return read_directory(spark.read.csv(path, header=True, schema="name string, slug string, url string"), ats)


def in_line_order(read: DataFrame) -> DataFrame:
    """The rows of a scan of line-based files with `ord`, their number from 0 in the order of file names and lines.

    Spark packs splits by size, not by name, so a row's own number says little. Here each split of a file counts its
    rows, running sums over (file, start of the split) give where it begins, and a row adds its place in its split.
    Only one row for each split goes through one task.
    """
    rows = read.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__row"))
    splits = rows.groupBy("__file", "__start").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__file", "__start")) - F.col("__n")
    placed = rows.join(splits.select("__file", "__start", "__first", before.alias("__before")), ["__file", "__start"])
    return placed.withColumn("ord", F.col("__before") + F.col("__row") - F.col("__first")).drop("__file", "__start", "__first", "__before", "__row")


def _tsv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    return in_line_order(spark.read.csv(path, sep="\t", schema=", ".join(f"`{f}` string" for f in fields), multiLine=False, mode="PERMISSIVE"))


def _number(name: str):
    return F.coalesce(F.expr(f"try_cast(trim(`{name}`) as bigint)"), F.lit(0))


def _text(name: str):
    return F.coalesce(F.trim(name), F.lit("")).alias(name)


def read_cities(spark: SparkSession, path: str, min_population: int = 15000) -> DataFrame:
    """CITY_ROW's columns and ord, of rows of at least 15 columns and that population; a bad number is 0."""
    df = _tsv(spark, path, _CITY_FIELDS).where("population is not null or coalesce(elevation, dem, timezone, modified) is not null")
    names = ["name", "asciiname", "alternatenames", "feature_code", "country_code", "admin1_code"]
    return df.select("ord", *[_text(n) for n in names], _number("population").alias("population")).where(F.col("population") >= min_population)


def read_admin1(spark: SparkSession, path: str) -> DataFrame:
    """(ord, code, name) of first-level regions; of a repeated code the last row."""
    df = _tsv(spark, path, ["code", "name", "ascii", "id"]).where("name is not null").select("ord", F.trim("code").alias("code"), F.trim("name").alias("name"))
    last = df.where("code <> ''").groupBy("code").agg(F.max_by("name", "ord").alias("name"), F.min("ord").alias("ord"))
    return last.select("ord", "code", "name")


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """(ord, iso, iso3, name, population), without comments, rows of under 8 columns and rows without a code."""
    fields = "iso iso3 number fips name capital area population rest".split()
    df = _tsv(spark, path, fields).where("not startswith(coalesce(iso, '#'), '#') and trim(iso) <> ''").where("population is not null or rest is not null")
    return df.select("ord", *[_text(n) for n in ("iso", "iso3", "name")], _number("population").alias("population"))


def load_rules(spark: SparkSession, path: str, version: str) -> dict:
    """A ruleset from {path}/{version}.json (small, read on the driver by Spark, so from any store)."""
    try:
        text = spark.read.text(f"{path}/{version}.json", wholetext=True).first()
    except Exception as e:
        raise RuleError(f"no ruleset of version {version!r}") from e
    data = json.loads(text[0]) if text else None
    if not isinstance(data, dict) or not isinstance(data.get("rules"), list):
        raise RuleError(f"ruleset {version!r} has no rules")
    return {"version": version, **data}


def write_gazetteer(tables: dict[str, DataFrame], path: str, version: str, attribution: str = "") -> None:
    """One Parquet table for each part of a gazetteer, below {path}/{version}; an existing version is not replaced."""
    for name in GAZETTEER_TABLES:
        tables[name].withColumn("version", F.lit(version)).withColumn("attribution", F.lit(attribution)).write.mode("errorifexists").parquet(f"{path}/{version}/{name}")


def load_gazetteer(spark: SparkSession, path: str, version: str) -> dict[str, DataFrame]:
    need = {"countries": {"name", "aliases", "population"}, "regions": {"code", "country", "full_aliases"}, "cities": {"name", "country", "aliases"}, "ambiguous": {"token"}, "prefixes": {"code", "country"}}
    out = {}
    for name in GAZETTEER_TABLES:
        try:
            out[name] = spark.read.parquet(f"{path}/{version}/{name}")
        except Exception as e:
            raise GazetteerError(f"no table {name} of gazetteer {version!r}") from e
        if not need[name] <= set(out[name].columns):
            raise GazetteerError(f"table {name} of gazetteer {version!r} lacks columns")
    return out


class NotEmpty(RuntimeError):
    """A strict diff found something."""


def write_diff(diff: DataFrame, path: str, *, form: str = "json", strict: bool = False) -> None:
    """A diff as JSON lines, or as text, `kind id: old -> new` a line, places without their unknown parts; strict: an error if there is any."""
    if form == "text":
        said = [F.array_join(F.filter(F.array(*[F.col(f"{x}.location_{p}") for p in ("city", "region", "country")]), lambda v: F.coalesce(v, F.lit("")) != ""), ", ") for x in ("old", "new")]
        lines = diff.select(F.concat_ws("", "kind", F.lit(" "), F.col("id").cast("string"), F.lit(": "), said[0], F.lit(" -> "), said[1]).alias("value"))
        lines.write.mode("errorifexists").text(path)
    elif form == "json":
        diff.write.mode("errorifexists").json(path)
    else:
        raise ValueError(f"no such form: {form!r}")
    if strict and not diff.sparkSession.read.text(path).isEmpty():
        raise NotEmpty(path)
