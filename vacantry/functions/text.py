"""Scalar functions on postings, as Column expressions; the few that Spark lacks are vectorised UDFs."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What marks a place text as remote, in the order in which they are removed.
REMOTE_MARKERS = ("remote", "anywhere", "work from home", "wfh", "world wide", "worldwide", "remoto")
#: Tiers of populated places, most significant first; any other code has tier 9.
FEATURE_TIERS = {"PPLC": 0, "PPLA": 1, "PPLA2": 2, "PPLA3": 3, "PPLA4": 4, "PPLA5": 5}
DEFAULT_TIER = 9
RECOMMENDED_FROM = 0.40
HASHED_FIELDS = ("title", "description", "location", "is_remote", "salary_min", "salary_max")


def is_remote(place: Column) -> Column:
    """Whether a place text contains a remote marker; null is not remote."""
    low = F.lower(place)
    hit = F.lit(False)
    for marker in REMOTE_MARKERS:
        hit = hit | low.contains(marker)
    return F.coalesce(hit, F.lit(False))


def content_hash(*fields: str) -> Column:
    """SHA-256 of the named fields (by default those that make up a posting's content); null and '' differ."""
    names = fields or HASHED_FIELDS
    said = [F.concat(F.lit(f"{f}="), F.coalesce(F.concat(F.lit("'"), F.col(f).cast("string"), F.lit("'")), F.lit("None"))) for f in names]
    return F.sha2(F.concat_ws("|", *said), 256)


def salary_ceiling(least: Column, most: Column) -> Column:
    return F.coalesce(most, least)


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities resolved once: &amp;lt; becomes &lt;."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def fold_unicode(text: pd.Series) -> pd.Series:
    """NFKC and full case folding, which Spark's lower() is not."""
    return text.map(lambda s: unicodedata.normalize("NFKC", s).strip().casefold(), na_action="ignore")


def title_case(text: Column) -> Column:
    """Upper case after every character that is no letter, lower case otherwise."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def display_name(ats: Column, token: Column) -> Column:
    """A readable employer name: the company label of a URL token's host, - and _ as spaces, in title case."""
    label = F.when(ats == "workday", F.regexp_extract(token, r"^[A-Za-z]+://([^./]+)", 1)).otherwise(token)
    return title_case(F.trim(F.translate(F.when(label == "", token).otherwise(label), "-_", "  ")))


def valid_board_url(token: Column, domain: str = "myworkdayjobs.com") -> Column:
    """An https URL whose host is {company}.{instance}.{domain} and whose path is a site, both of plain labels."""
    dots = domain.replace(".", r"\.")
    return F.coalesce(token.rlike(rf"^https://[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.{dots}/[A-Za-z0-9_-]+/*$"), F.lit(False))


@F.pandas_udf(T.StringType())
def plain_ascii(text: pd.Series) -> pd.Series:
    """NFKD without what is not ASCII: accents go, and letters that have no plain form."""
    return text.map(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode(), na_action="ignore")


def slugify(name: Column) -> Column:
    plain = F.lower(plain_ascii(name))
    kept = F.regexp_replace(plain, r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(kept), r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def csv_list(text: Column) -> Column:
    """Comma-separated entries, trimmed, without empty ones, in order and with repeats."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def clean_query(text: Column) -> Column:
    return F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit("")))


def has_unresolved_target(targets: Column) -> Column:
    return F.coalesce(F.exists(targets, lambda t: ~t["resolved"]), F.lit(False))


def status_for_score(score: Column) -> Column:
    return F.when(score >= RECOMMENDED_FROM, "recommended").otherwise("below_threshold")


def feature_tier(code: Column) -> Column:
    tiers = F.create_map(*[F.lit(x) for pair in FEATURE_TIERS.items() for x in pair])
    return F.coalesce(tiers[F.coalesce(code, F.lit(""))], F.lit(DEFAULT_TIER))


def looks_like_airport(alias: Column) -> Column:
    return F.coalesce(alias.rlike(r"^\p{Lu}{3}$"), F.lit(False))


def clean_alias(raw: Column) -> Column:
    """Folded as the places that are looked up, without full stops; null if nothing is left."""
    return F.nullif(F.trim(F.replace(fold_unicode(raw), F.lit("."), F.lit(""))), F.lit(""))


def log_filter(logs, *, service: str | None = None, level: str = "ERROR", line: str = "line", label: str = "service"):
    """JSON log lines of a level, and of a service if one is named; lines that are no JSON are left out."""
    hit = F.get_json_object(F.col(line), "$.levelname") == level
    return logs.where(hit if service is None else hit & (F.col(label) == service))


def facet_filter(df, search: str | None = None, search_in: tuple[str, ...] = (), **equal):
    """Rows whose named columns equal the values given, and, if `search` is given, that contain it in any of `search_in`, whatever the case."""
    for name, value in equal.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    if search:
        hit = F.lit(False)
        for name in search_in:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(name).cast("string")), F.lit(search.lower())), F.lit(False))
        df = df.where(hit)
    return df
