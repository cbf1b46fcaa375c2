"""Schemas of the tables that move between stages."""

from __future__ import annotations

from pyspark.sql import types as T

ATS = ("greenhouse", "lever", "ashby", "workday")
REMOTE_PREFS = ("any", "remote_only", "onsite_only")

PLACE = T.StructType(
    [T.StructField("city", T.StringType()), T.StructField("region", T.StringType()), T.StructField("country", T.StringType()), T.StructField("resolved", T.BooleanType())]
)

#: What every feed ends in.
NORMALISED = T.StructType(
    [
        T.StructField("source_ats", T.StringType()),
        T.StructField("source_job_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("is_remote", T.BooleanType()),
        T.StructField("location_city", T.StringType()),
        T.StructField("location_region", T.StringType()),
        T.StructField("location_country", T.StringType()),
        T.StructField("location_resolved", T.BooleanType()),
        T.StructField("location_alias_version", T.StringType()),
        T.StructField("salary_min", T.IntegerType()),
        T.StructField("salary_max", T.IntegerType()),
        T.StructField("source_url", T.StringType()),
    ]
)

#: What a posting has besides, once it is in the snapshot.
POSTING = T.StructType(
    [
        *NORMALISED.fields,
        T.StructField("employer", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("classification_tags", T.ArrayType(T.StringType())),
        T.StructField("ruleset_version", T.StringType()),
        T.StructField("needs_classification", T.BooleanType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("scraped_at", T.TimestampType()),
    ]
)

COUNTRY_ROW = "iso string, iso3 string, name string, population long"
ADMIN1_ROW = "code string, name string"
CITY_ROW = "name string, asciiname string, alternatenames string, feature_code string, country_code string, admin1_code string, population long"
