"""The pipeline's tables, derived from the driver's; each view is SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gazetteer, location, rules

POSTINGS = """
SELECT doc_id AS posting_id,
       CASE doc_id % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'workday' END AS source_ats,
       CAST(doc_id AS STRING) AS source_job_id, source AS employer, source AS employer_slug,
       source || '-' || CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS STRING) AS board_token,
       substr(text, 1, 60) AS title, text AS description,
       CASE doc_id % 6 WHEN 0 THEN n_name || ', ' || r_name WHEN 1 THEN 'Remote - ' || r_name WHEN 2 THEN n_name || ' Area'
            WHEN 3 THEN r_name || ' > ' || n_name WHEN 4 THEN 'Hybrid' ELSE 'Nowhere' END AS location,
       doc_id % 6 = 1 AS is_remote,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(n_chars * 25 AS INT) END AS salary_min,
       CASE WHEN doc_id % 9 = 1 THEN CAST(n_chars * 30 AS INT) END AS salary_max,
       'https://jobs.example.com/' || CAST(doc_id AS STRING) AS source_url,
       CASE WHEN doc_id % 11 = 0 THEN 'closed' ELSE 'open' END AS status,
       CAST('2024-01-01' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(doc_id % 60 AS INT) AS scraped_at
FROM {documents} JOIN {nation} ON doc_id % 25 = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

PROFILES = """
SELECT c_custkey AS user_id, CAST(floor(c_custkey / 10) AS BIGINT) AS k, c_mktsegment AS segment, n_name, r_name,
       CASE WHEN CAST(floor(c_custkey / 10) AS BIGINT) % 4 = 0 THEN NULL ELSE CAST(floor(abs(c_acctbal) * 10) AS INT) END AS min_salary,
       CASE CAST(floor(c_custkey / 10) AS BIGINT) % 3 WHEN 0 THEN 'any' WHEN 1 THEN 'remote_only' ELSE 'onsite_only' END AS remote_pref,
       c_acctbal >= 0 AS is_active
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

#: Five countries made of regions, and four whose codes show the other branches: shown names, numbered regions, taken codes.
COUNTRIES = """
SELECT r_regionkey AS ord, 'Q' || chr(65 + r_regionkey) AS iso, 'QQ' || chr(65 + r_regionkey) AS iso3, r_name AS name,
       CAST((r_regionkey + 1) * 1000000 AS BIGINT) AS population FROM {region}
UNION ALL
SELECT 10 + r_regionkey, CASE r_regionkey WHEN 0 THEN 'CA' WHEN 1 THEN 'AU' WHEN 2 THEN 'US' ELSE 'NL' END,
       CASE r_regionkey WHEN 0 THEN 'CAN' WHEN 1 THEN 'AUS' WHEN 2 THEN 'USA' ELSE 'NLD' END,
       CASE r_regionkey WHEN 0 THEN 'Canada' WHEN 1 THEN 'Australia' WHEN 2 THEN 'United States' ELSE 'Netherlands' END,
       CAST(100000 AS BIGINT) FROM {region} WHERE r_regionkey < 4
"""

#: CA.05 is NL and CA.10 is QC, which countries have; AU.QE takes the alias of the country QE.
ADMIN1 = """
SELECT n_nationkey AS ord, 'Q' || chr(65 + n_regionkey) || '.' || CASE WHEN n_nationkey % 4 = 3 THEN '0' || chr(48 + n_nationkey % 10) ELSE chr(65 + n_nationkey) || 'N' END AS code,
       CASE WHEN n_nationkey % 6 = 1 THEN n_name WHEN n_nationkey % 6 = 2 THEN 'Central' ELSE 'Province ' || CAST(n_nationkey AS STRING) END AS name FROM {nation}
UNION ALL
SELECT 100 + n_nationkey, 'CA.' || lpad(CAST(n_nationkey AS STRING), 2, '0'), 'Canton ' || CAST(n_nationkey AS STRING) FROM {nation} WHERE n_nationkey BETWEEN 1 AND 14
UNION ALL
SELECT 200 + n_nationkey, CASE WHEN n_nationkey = 9 THEN 'AU.QE' ELSE 'AU.' || lpad(CAST(n_nationkey AS STRING), 2, '0') END, 'Bush ' || CAST(n_nationkey AS STRING)
FROM {nation} WHERE n_nationkey BETWEEN 1 AND 9
"""

#: A city for each nation, and a town for each supplier; three towns share a further name.
CITIES = """
SELECT n_nationkey AS ord, n_name AS name, n_name AS asciiname,
       'LON,Old ' || n_name || ',' || CASE WHEN n_nationkey % 5 = 0 THEN 'Springfield' ELSE r_name END AS alternatenames,
       CASE WHEN n_nationkey % 3 = 0 THEN 'PPLA' ELSE 'PPL' END AS feature_code, 'Q' || chr(65 + n_regionkey) AS country_code,
       CASE WHEN n_nationkey % 4 = 3 THEN '0' || chr(48 + n_nationkey % 10) ELSE chr(65 + n_nationkey) || 'N' END AS admin1_code,
       CAST(14000 + n_nationkey * 1000 AS BIGINT) AS population
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT 1000 + s_suppkey, 'Town ' || CAST(s_suppkey AS STRING), 'Town ' || CAST(s_suppkey AS STRING),
       'LON,Canada,Newport ' || CAST(CAST(floor(s_suppkey / 3) AS BIGINT) AS STRING),
       CASE WHEN s_suppkey % 3 = 0 THEN 'PPLA' ELSE 'PPL' END, 'Q' || chr(65 + n_regionkey),
       CASE WHEN n_nationkey % 4 = 3 THEN '0' || chr(48 + n_nationkey % 10) ELSE chr(65 + n_nationkey) || 'N' END,
       CAST(floor(s_acctbal) AS BIGINT) + 12000
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

#: A place text of every customer, in eight shapes.
PLACES = """
SELECT c_custkey AS place_id, c_nationkey AS n,
       CASE c_custkey % 8 WHEN 0 THEN iso || ' - ' || n_name WHEN 1 THEN other || ' - ' || n_name WHEN 2 THEN n_name || ' ' || code
            WHEN 3 THEN 'Nowhere at all|' || n_name || ', ' || r_name WHEN 4 THEN n_name || ' (' || r_name || ' site)'
            WHEN 5 THEN n_name || ', ' || code || ' 10065' WHEN 6 THEN 'Retail - ' || r_name || ' - ' || n_name ELSE 'Hybrid - ' || code END AS location
FROM (SELECT c_custkey, c_nationkey, n_name, r_name, 'Q' || chr(65 + n_regionkey) AS iso, 'Q' || chr(65 + (n_regionkey + 1) % 5) AS other,
             CASE WHEN n_nationkey % 4 = 3 THEN '0' || chr(48 + n_nationkey % 10) ELSE chr(65 + n_nationkey) || 'N' END AS code
      FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey) made
"""

ACTIONS = """
SELECT user_id, event_id % (SELECT count(*) FROM {documents}) AS posting_id, event_id AS seq, ts,
       CASE event_type WHEN 'view' THEN 'save' WHEN 'purchase' THEN 'apply' WHEN 'error' THEN 'dismiss' ELSE event_type END AS action FROM {events}
"""

DIRECTORY = """
SELECT CASE s_suppkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'workday' END AS ats,
       CASE WHEN s_suppkey % 4 = 3 THEN 'https://acme-' || CAST(s_suppkey AS STRING) || '.wd' || CAST(s_nationkey AS STRING) || CASE WHEN s_suppkey % 8 = 3 THEN '.myworkdayjobs.com/site' ELSE '.example.com/site' END
            ELSE '  o''neil_3m-' || lower(s_name) || ' ' END AS token,
       s_suppkey, s_nationkey, s_acctbal FROM {supplier}
"""

VIEWS = {"postings": POSTINGS, "profiles": PROFILES, "countries": COUNTRIES, "admin1": ADMIN1, "cities": CITIES, "places": PLACES, "actions": ACTIONS, "directory": DIRECTORY}
TABLES = ("documents", "nation", "region", "customer", "events", "supplier", "pages", "part", "orders", "lineitem")

_W = r"(^|[^a-z0-9_à-ÿ])"
_E = r"($|[^a-z0-9_à-ÿ])"
#: Rules whose words are frequent in the driver's texts.
RULESET = {
    "version": "demo",
    "rules": [
        {"tag": "article", "type": "keyword_any", "keywords": ["The ", "la ", "die "]},
        {"tag": "noun", "type": "keyword_any", "keywords": ["tion"]},
        {"tag": "german", "type": "keyword_all", "keywords": ["sch", "keit"]},
        {"tag": "of", "type": "regex", "pattern": f"{_W}of{_E}"},
        {"tag": "remote", "type": "field_equals", "field": "is_remote", "value": True},
        {"tag": "high_comp", "type": "salary_threshold", "field": "salary_min", "min": 50000},
    ],
}
#: The same without one rule and with another bound.
RULESET_B = {"version": "demo2", "rules": [r if r["tag"] != "high_comp" else {**r, "min": 80000} for r in RULESET["rules"] if r["tag"] != "of"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def profiles(spark: SparkSession, sf_dir: str, gaz: dict[str, DataFrame] | None = None) -> DataFrame:
    """Profiles with their lists, and their targets normalised if a gazetteer is given."""
    k, c = F.col("k"), F.col
    tags = [["article", "noun"], ["german", "german", "article"], ["of"], ["high_comp", "remote", "noun"], []]
    wanted = F.array().cast("array<string>")
    for i, t in enumerate(tags[:4]):
        wanted = F.when(k % 5 == i, F.array(*[F.lit(x) for x in t])).otherwise(wanted)
    places = F.when(k % 3 == 0, F.array(c("n_name"), F.lit("Remote"), c("r_name"))).when(k % 3 == 1, F.array(F.lit("Nowhere"))).otherwise(F.array(c("n_name"), F.lit("where")))
    out = view(spark, sf_dir, "profiles").select(
        "user_id",
        F.array(F.lower(F.substring("segment", 1, 2)), F.lit("the ")).alias("target_titles"),
        wanted.alias("target_tags"),
        places.alias("target_locations"),
        F.array(F.concat(F.lit("src"), (k % 20).cast("string"))).alias("excluded_employers"),
        "min_salary",
        "remote_pref",
        "is_active",
    )
    return out if gaz is None else location.with_targets(out, gaz)


def gazetteer_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    v = lambda n: view(spark, sf_dir, n)
    return gazetteer.build_gazetteer(v("cities"), v("admin1"), v("countries"), version="v3")


_PREPARED: dict[tuple, dict[str, DataFrame]] = {}


def gaz(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The gazetteer, ready to look places up; prepared once in a session for the same files, unchanged."""
    made = F.max("_metadata.file_modification_time").alias("t")
    key = (spark.sparkContext.applicationId, sf_dir, *(table(spark, sf_dir, n).agg(made).first()["t"] for n in ("nation", "region", "supplier")))
    if key not in _PREPARED:
        _PREPARED[key] = gazetteer.prepared(gazetteer_tables(spark, sf_dir))
    return _PREPARED[key]


def tagged_postings(spark: SparkSession, sf_dir: str, places: dict[str, DataFrame] | None = None) -> DataFrame:
    """Postings with tags and resolved places."""
    out = rules.classify(view(spark, sf_dir, "postings"), RULESET, "classification_tags")
    return location.resolve_locations(out, places if places is not None else gaz(spark, sf_dir))
