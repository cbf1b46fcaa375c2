"""SQL for the registered queries, written for DuckDB over the same tables."""

from __future__ import annotations

from ..operators.discovery import SLOW_BATCH
from .queries import NOW_TEXT
from .views import TABLES, VIEWS

V = {name: sql.format(**{t: t for t in TABLES}) for name, sql in VIEWS.items()}
_W, _E = r"(^|[^a-z0-9_à-ÿ])", r"($|[^a-z0-9_à-ÿ])"

V["g"] = """
SELECT n_nationkey AS n, n_name, r_name, r_regionkey, 'Q' || chr(65 + r_regionkey) AS iso, lower(n_name) AS low, 14000 + n_nationkey * 1000 AS pop,
       CASE WHEN n_nationkey % 4 = 3 THEN '0' || chr(48 + n_nationkey % 10) ELSE chr(65 + n_nationkey) || 'N' END AS code
FROM nation JOIN region ON n_regionkey = r_regionkey"""

V["placed"] = """
SELECT p.*, CASE WHEN kind = 'multi' AND n >= 1 OR kind = 'city' AND n >= 1 THEN n_name ELSE '' END AS location_city,
       CASE WHEN kind = 'city' AND n >= 1 OR kind = 'multi' AND n % 6 = 1 THEN code ELSE '' END AS location_region,
       CASE WHEN kind IN ('multi', 'country') OR kind = 'city' AND n >= 1 THEN iso ELSE '' END AS location_country,
       kind IN ('multi', 'country', 'nowhere') OR kind = 'city' AND n >= 1 AS location_resolved, 'v3' AS location_alias_version
FROM (SELECT p.*, g.n, g.n_name, g.code, g.iso,
             CASE posting_id % 6 WHEN 0 THEN CASE WHEN r_name = 'EUROPE' THEN 'city' ELSE 'multi' END WHEN 1 THEN 'country' WHEN 2 THEN 'city'
                  WHEN 3 THEN CASE WHEN r_name = 'EUROPE' THEN 'none' ELSE 'multi' END WHEN 4 THEN 'nowhere' ELSE 'none' END AS kind
      FROM postings p JOIN g ON posting_id % 25 = g.n) p"""


def _tags(bound: int = 50000, of: bool = True, prefix: str = "") -> str:
    t = f"lower(coalesce({prefix}title, '') || chr(10) || coalesce({prefix}description, ''))"
    parts = [
        f"CASE WHEN contains({t}, 'the ') OR contains({t}, 'la ') OR contains({t}, 'die ') THEN 'article' END",
        f"CASE WHEN contains({t}, 'sch') AND contains({t}, 'keit') THEN 'german' END",
        f"CASE WHEN {prefix}salary_min >= {bound} THEN 'high_comp' END",
        f"CASE WHEN contains({t}, 'tion') THEN 'noun' END",
        f"CASE WHEN regexp_matches({t}, '{_W}of{_E}') THEN 'of' END" if of else "NULL",
        f"CASE WHEN {prefix}is_remote THEN 'remote' END",
    ]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


V["tagged"] = f"SELECT *, {_tags()} AS tags FROM placed"

_CITY = "CASE WHEN n >= 1 THEN struct_pack(raw := n_name, city := n_name, region := code, country := iso, resolved := true) ELSE struct_pack(raw := n_name, city := NULL::VARCHAR, region := NULL::VARCHAR, country := NULL::VARCHAR, resolved := false) END"
_NONE = "struct_pack(raw := {raw}, city := NULL::VARCHAR, region := NULL::VARCHAR, country := {country}, resolved := {resolved})"
V["people"] = f"""
SELECT p.user_id, p.min_salary, p.remote_pref, p.is_active,
       [lower(substr(segment, 1, 2)), 'the '] AS target_titles,
       CASE k % 5 WHEN 0 THEN ['article', 'noun'] WHEN 1 THEN ['german', 'german', 'article'] WHEN 2 THEN ['of'] WHEN 3 THEN ['high_comp', 'remote', 'noun'] ELSE []::VARCHAR[] END AS target_tags,
       CASE k % 3 WHEN 0 THEN [p.n_name, 'Remote', p.r_name] WHEN 1 THEN ['Nowhere'] ELSE [p.n_name, 'where'] END AS target_locations,
       'src' || (k % 20) AS excluded,
       CASE k % 3 WHEN 0 THEN [{_CITY.replace("n_name", "g.n_name")}, {_NONE.format(raw="'Remote'", country="NULL::VARCHAR", resolved="true")},
                               {_NONE.format(raw="p.r_name", country="CASE WHEN p.r_name <> 'EUROPE' THEN iso END", resolved="true")}]
                  WHEN 1 THEN [{_NONE.format(raw="'Nowhere'", country="NULL::VARCHAR", resolved="false")}]
                  ELSE [{_CITY.replace("n_name", "g.n_name")}, {_NONE.format(raw="'where'", country="NULL::VARCHAR", resolved="false")}] END AS targets
FROM profiles p JOIN g ON p.n_name = g.n_name"""

V["pairs"] = """
SELECT * FROM tagged JOIN people ON is_active
  AND (remote_pref = 'any' OR remote_pref = CASE WHEN is_remote THEN 'remote_only' ELSE 'onsite_only' END)
  AND coalesce(employer, '') <> excluded AND (min_salary IS NULL OR coalesce(salary_max, salary_min) IS NULL OR min_salary <= coalesce(salary_max, salary_min))"""

_NOWHERE = "x.resolved AND x.city IS NULL AND x.region IS NULL AND x.country IS NULL"
V["parts"] = f"""
SELECT *, list_sort(list_distinct(list_filter(target_tags, lambda x: list_contains(tags, x)))) AS matched,
       list_filter(targets, lambda x: NOT ({_NOWHERE})) AS real,
       list_transform(list_filter(targets, lambda x: {_NOWHERE}), lambda x: x.raw) AS idle FROM pairs"""
V["scored"] = """
SELECT user_id, posting_id, round_even(0.5::DOUBLE * tag + 0.2::DOUBLE * title_hit + 0.2::DOUBLE * place + 0.1::DOUBLE * pay, 6) AS match_score, matched FROM (
  SELECT user_id, posting_id, matched,
    CASE WHEN len(target_tags) > 0 THEN len(matched)::DOUBLE / len(target_tags) ELSE 0 END AS tag,
    CASE WHEN len(list_filter(target_titles, lambda x: contains(lower(coalesce(title, '')), x) OR contains(x, lower(coalesce(title, ''))))) > 0 THEN 1.0::DOUBLE ELSE 0 END AS title_hit,
    CASE WHEN remote_pref = 'remote_only' THEN CASE WHEN is_remote THEN 1.0::DOUBLE ELSE 0 END
         WHEN is_remote THEN CASE WHEN remote_pref = 'any' THEN 1.0::DOUBLE ELSE 0 END
         WHEN len(real) = 0 THEN 1
         WHEN len(list_filter(real, lambda x: x.resolved AND (x.city IS NULL OR x.city = location_city) AND (x.region IS NULL OR x.region = location_region)
                              AND (x.country IS NULL OR x.country = location_country))) > 0 THEN 1
         WHEN location_resolved THEN 0
         WHEN len(list_filter(target_locations, lambda x: NOT list_contains(idle, x) AND contains(lower(location), lower(x)))) > 0 THEN 1 ELSE 0 END AS place,
    CASE WHEN min_salary IS NULL THEN 1.0::DOUBLE WHEN salary_min IS NULL THEN 0.5 WHEN salary_min >= min_salary THEN 1 ELSE 0 END AS pay FROM parts)"""
V["shown"] = """
SELECT user_id, posting_id, match_score, CASE WHEN match_score >= 0.4 THEN 'recommended' ELSE 'below_threshold' END AS match_status,
       array_to_string(matched, '|') AS matched_tags FROM scored"""
for _name, _from in (("tagged", "placed"), ("pairs", "tagged"), ("parts", "pairs"), ("scored", "parts"), ("shown", "scored")):
    V[f"{_name}_old"] = V[_name].replace(f"FROM {_from}", f"FROM {_from}_old")
V["tagged_old"] = f"SELECT *, {_tags(80000, False)} AS tags FROM placed WHERE posting_id % 7 <> 0"
V["pairs_old"] = V["pairs_old"].replace("ON is_active\n  AND (", "ON (")
V["changed"] = "SELECT t.posting_id FROM tagged t LEFT JOIN tagged_old o ON t.posting_id = o.posting_id WHERE o.posting_id IS NULL OR t.tags <> o.tags"
V["done"] = """
SELECT user_id, posting_id, arg_max(s, (ts, seq)) AS status, max(ts) AS ts FROM (
  SELECT *, CASE action WHEN 'save' THEN 'saved' WHEN 'apply' THEN 'applied' WHEN 'dismiss' THEN 'dismissed' END AS s FROM actions) WHERE s IS NOT NULL GROUP BY user_id, posting_id"""
V["ranked"] = """
SELECT s.user_id, s.posting_id, match_score, coalesce(d.status, '') AS action, row_number() OVER (PARTITION BY s.user_id ORDER BY match_score DESC, s.posting_id) AS rank
FROM shown s LEFT JOIN done d ON s.user_id = d.user_id AND s.posting_id = d.posting_id WHERE match_status = 'recommended' AND coalesce(d.status, '') <> 'dismissed'"""

_HASH = "sha256('title=' || coalesce('''' || title || '''', 'None') || '|description=' || coalesce('''' || description || '''', 'None') || '|location=' || coalesce('''' || location || '''', 'None') || '|is_remote=' || coalesce('''' || CAST(is_remote AS VARCHAR) || '''', 'None') || '|salary_min=' || coalesce('''' || CAST(salary_min AS VARCHAR) || '''', 'None') || '|salary_max=' || coalesce('''' || CAST(salary_max AS VARCHAR) || '''', 'None'))"
V["old"] = f"SELECT *, {_HASH} AS content_hash FROM postings WHERE posting_id % 7 <> 0"
V["new"] = f"""
SELECT *, {_HASH} AS content_hash FROM (
  SELECT * REPLACE (CASE WHEN posting_id % 17 = 1 THEN '2 ' || title ELSE title END AS title, CASE WHEN posting_id % 13 = 0 THEN description || '!' ELSE description END AS description)
  FROM postings WHERE posting_id % 5 <> 0 AND employer <> 'src3')"""
V["merged"] = f"""
SELECT o, coalesce(a_ats, b_ats) AS source_ats, coalesce(a_id, b_id) AS source_job_id, CASE WHEN o IN ('created', 'reopened', 'updated') THEN b_title ELSE a_title END AS title,
       CASE WHEN o IN ('created', 'reopened', 'updated') THEN b_hash ELSE a_hash END AS content_hash, coalesce(a_emp, b_emp) AS employer,
       CASE WHEN b_id IS NOT NULL THEN 'open' WHEN o = 'closed' THEN 'closed' ELSE a_status END AS status,
       CASE WHEN o IN ('created', 'reopened') THEN '' ELSE 'old' END AS tags, CASE WHEN o IN ('created', 'reopened') THEN '' ELSE 'v0' END AS ruleset_version,
       o IS NOT NULL AND o IN ('created', 'reopened', 'updated') AS needs_classification, CASE WHEN b_id IS NOT NULL THEN TIMESTAMP '{NOW_TEXT}' ELSE a_seen END AS scraped_at, o AS outcome
FROM (SELECT *, CASE WHEN a_id IS NULL THEN 'created' WHEN b_id IS NOT NULL AND a_status = 'closed' THEN 'reopened' WHEN b_id IS NOT NULL AND a_hash <> b_hash THEN 'updated'
                     WHEN b_id IS NOT NULL THEN 'unchanged' WHEN a_status = 'open' AND a_emp <> 'src3' THEN 'closed' END AS o
      FROM (SELECT source_ats AS a_ats, source_job_id AS a_id, title AS a_title, content_hash AS a_hash, employer AS a_emp, status AS a_status, scraped_at AS a_seen FROM old) a
      FULL JOIN (SELECT source_ats AS b_ats, source_job_id AS b_id, title AS b_title, content_hash AS b_hash, employer AS b_emp FROM new) b ON a_ats = b_ats AND a_id = b_id)"""
V["tokens"] = "SELECT DISTINCT ats, trim(token) AS token, s_suppkey, s_nationkey FROM directory"
V["fresh"] = "SELECT ats, token, s_suppkey, s_nationkey, row_number() OVER (PARTITION BY ats ORDER BY token) AS r FROM tokens WHERE s_suppkey % 6 <> 0 AND s_suppkey % 9 <> 1"
V["stamped"] = """
SELECT p.*, location_city AS right_city, location_resolved AS right_resolved, CASE WHEN posting_id % 3 = 0 THEN 'v1' ELSE 'v3' END AS seen,
       CASE WHEN posting_id % 10 = 2 THEN 'Elsewhere' ELSE location_city END AS had_city, location_resolved OR posting_id % 12 = 5 AS had_resolved FROM placed p"""
_NAME = "CASE WHEN s_suppkey % 4 = 3 THEN 'Acme ' || s_suppkey ELSE 'O''Neil 3M Supplier#' || substr(s_name, 10) END"
V["named"] = f"SELECT d.*, {_NAME} AS display FROM directory d JOIN supplier s USING (s_suppkey)"
V["towns"] = """
SELECT 1000 + s_suppkey AS ord, s_suppkey AS s, 'Town ' || s_suppkey AS city, code AS region, iso AS country, CAST(floor(s_acctbal) AS BIGINT) + 12000 AS pop
FROM supplier JOIN g ON s_nationkey = n WHERE floor(s_acctbal) + 12000 >= 15000"""
V["alias"] = """
SELECT n AS ord, n_name AS city, code AS region, iso AS country, pop, CASE WHEN n % 3 = 0 THEN 1 ELSE 9 END AS tier,
       unnest(list_distinct([low, 'old ' || low] || CASE WHEN n % 5 = 0 THEN ['springfield'] ELSE []::VARCHAR[] END)) AS alias FROM g WHERE n >= 1
UNION ALL
SELECT ord, city, region, country, pop, CASE WHEN s % 3 = 0 THEN 1 ELSE 9 END, unnest(['town ' || s, 'newport ' || (s // 3)]) FROM towns"""
#: Which of city, region and country the shape of a place text gives; region codes of digits are never abbreviations.
V["shapes"] = """
SELECT p.place_id, p.location, g.*, CASE place_id % 8
         WHEN 0 THEN CASE WHEN g.n >= 1 THEN 'city region country' ELSE '' END
         WHEN 1 THEN ''
         WHEN 2 THEN CASE WHEN code >= 'A' THEN 'city region country' ELSE '' END
         WHEN 3 THEN CASE WHEN r_name = 'EUROPE' THEN 'city region country' ELSE 'city country' END
         WHEN 4 THEN CASE WHEN g.n >= 1 THEN 'city region country' ELSE '' END
         WHEN 5 THEN CASE WHEN code >= 'A' THEN 'city region country' ELSE '' END
         WHEN 6 THEN CASE WHEN g.n % 6 = 1 THEN 'city region country' ELSE 'city country' END
         ELSE CASE WHEN code >= 'A' THEN 'region country' ELSE '' END END AS gives
FROM places p JOIN g ON p.n = g.n"""


_NEEDS = {
    "placed": ["postings", "g"], "tagged": ["placed"], "people": ["profiles", "g"], "pairs": ["tagged", "people"], "parts": ["pairs"], "scored": ["parts"], "shown": ["scored"],
    "tagged_old": ["placed"], "pairs_old": ["tagged_old", "people"], "parts_old": ["pairs_old"], "scored_old": ["parts_old"], "shown_old": ["scored_old"], "changed": ["tagged", "tagged_old"], "done": ["actions"], "ranked": ["shown", "done"], "old": ["postings"], "new": ["postings"], "merged": ["old", "new"], "tokens": ["directory"],
    "fresh": ["tokens"], "stamped": ["placed"], "named": ["directory"], "towns": ["g"], "alias": ["g", "towns"], "shapes": ["places", "g"],
}


def _with(final: str, *names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for x in _NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({V[n]})" for n in order) + " " + final


def oracle_sql() -> dict[str, str]:
    bad = "SELECT DISTINCT source_ats, board_token FROM postings WHERE posting_id % 97 = 5 AND source_ats <> 'workday'"
    remote = "is_remote OR source_ats = 'lever' AND posting_id % 8 = 1 OR source_ats = 'ashby' AND posting_id % 8 = 2"
    out = {
        "s_feeds": _with(
            f"""SELECT board_token, source_ats, source_job_id, title, coalesce(CASE WHEN source_ats = 'greenhouse' THEN '<p>' || description || '</p>' ELSE description END, '') AS description, location, {remote} AS is_remote,
            CASE WHEN source_ats = 'workday' THEN salary_min END AS salary_min, CASE WHEN source_ats = 'workday' THEN salary_max END AS salary_max, source_url
            FROM postings WHERE (source_ats, board_token) NOT IN ({bad})""", "postings"),
        "s_bad_boards": _with(bad, "postings"),
        "s_directory": _with("SELECT DISTINCT ats, token FROM tokens", "tokens"),
        "c_posting": _with(f"SELECT posting_id, is_remote AS remote, {_HASH} AS hash, coalesce(salary_max, salary_min) AS ceiling, CASE WHEN coalesce(salary_min / 100000, 0) >= 0.4 THEN 'recommended' ELSE 'below_threshold' END AS status FROM postings", "postings"),
        "c_names": _with("""SELECT s_suppkey, display AS name, s_suppkey % 8 = 3 AS valid, regexp_replace(lower(trim(token)), '[^a-z0-9_ -]', '', 'g') AS slug, trim(token) || '|x|x' AS listed, trim(token) AS query FROM named""", "named"),
        "c_aliases": _with("""SELECT ord, raw, CASE WHEN feature_code = 'PPLA' THEN 1 ELSE 9 END AS tier, regexp_full_match(raw, '[A-Z]{3}') AS airport, 'ab ' || lower(raw) AS alias
            FROM (SELECT ord, feature_code, unnest(string_split(alternatenames, ',')) AS raw FROM cities)""", "cities"),
        "c_unescape": r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS text FROM pages""",
        "c_logs": "SELECT event_id, 'svc1' AS container FROM events WHERE user_id % 3 = 1 AND event_type = 'error' AND user_id % 7 <> 1",
        "c_facets": _with("""SELECT 'posting' AS kind, posting_id AS id FROM postings WHERE status = 'open' AND source_ats = 'lever' AND contains(lower(title), 'the')
            UNION ALL SELECT 'profile', user_id FROM profiles WHERE remote_pref = 'any' AND is_active""", "postings", "profiles"),
        "g_countries": _with("""SELECT DISTINCT iso AS name, CAST((r_regionkey + 1) * 1000000 AS BIGINT) AS population,
            array_to_string(list_sort([lower(r_name), 'qq' || lower(chr(65 + r_regionkey))] || CASE WHEN iso = 'QE' THEN []::VARCHAR[] ELSE [lower(iso)] END), '|') AS aliases FROM g
            UNION ALL SELECT * FROM (VALUES ('Canada', 100000, 'ca|can|canada'), ('AU', 100000, 'au|aus|australia'),
            ('US', 100000, 'u.s.|u.s.a.|united states|united states of america|us|usa'), ('Netherlands', 100000, 'holland|netherlands|nl|nld|the netherlands'))""", "g"),
        "g_regions": _with("""SELECT CASE WHEN n % 6 = 1 THEN n_name WHEN n % 6 = 2 THEN 'Central' ELSE 'Province ' || n END AS name, code, iso AS country,
            CASE WHEN n % 6 NOT IN (1, 2) THEN 'province ' || n ELSE '' END AS full_aliases, CASE WHEN n % 6 = 1 THEN low ELSE '' END AS comma_context_full_aliases,
            CASE WHEN n % 4 = 3 THEN '' ELSE lower(code) END AS abbrev_aliases FROM g
            UNION ALL SELECT kind || ' ' || n, coalesce(postal, lpad(n::VARCHAR, 2, '0')), country, lower(kind) || ' ' || n, '', coalesce(lower(postal), '') FROM (
            SELECT n, 'Canton' AS kind, 'Canada' AS country, ['AB', 'BC', 'MB', 'NB', NULL, NULL, 'NS', 'ON', 'PE', NULL, 'SK', 'YT', 'NT', 'NU'][n] AS postal FROM g WHERE n BETWEEN 1 AND 14
            UNION ALL SELECT n, 'Bush', 'AU', ['ACT', 'NSW', 'NT', 'QLD', 'SA', 'TAS', 'VIC', 'WA', 'QE'][n] FROM g WHERE n BETWEEN 1 AND 9)""", "g"),
        "g_cities": _with("""SELECT n_name AS name, code AS region, iso AS country, CAST(pop AS BIGINT) AS population, CASE WHEN n % 3 = 0 THEN 'PPLA' ELSE 'PPL' END AS feature_code,
            low || '|old ' || low || CASE WHEN n % 5 = 0 THEN '|springfield' ELSE '' END AS aliases FROM g WHERE n >= 1
            UNION ALL SELECT city, region, country, pop, CASE WHEN s % 3 = 0 THEN 'PPLA' ELSE 'PPL' END, 'newport ' || (s // 3) || '|town ' || s FROM towns""", "g", "towns"),
        "g_collisions": _with("""SELECT 'ambiguous' AS kind, 'central' AS alias, '' AS country FROM g WHERE n % 6 = 2 HAVING count(*) > 1
            UNION ALL SELECT DISTINCT 'prefix', lower(iso), iso FROM g UNION ALL SELECT 'prefix', * FROM (VALUES ('au', 'AU'), ('us', 'US'), ('nl', 'Netherlands'))""", "g"),
        "g_lookup": _with("SELECT alias, c.city AS city, c.region AS region, c.country AS country FROM (SELECT alias, arg_min(struct_pack(city, region, country), (-pop, tier, ord)) AS c FROM alias GROUP BY alias)", "alias"),
        "l_clean": """SELECT s_suppkey, 'new york office - ' || lower(s_name) || ' metro area / x, ny 10065-12' || (s_suppkey % 90 + 10) AS place, 'new york office - ' || lower(s_name) AS area,
            'new york ' || lower(s_name) || ' metro area / x, ny 10065 12' || (s_suppkey % 90 + 10) AS text, true AS removed,
            'new york office - ' || lower(s_name) || ' metro area / x|ny 10065-12' || (s_suppkey % 90 + 10) AS segments, CASE WHEN s_suppkey % 2 = 1 THEN 'ny 100065' ELSE 'ny' END AS zip FROM supplier""",
        "l_postings": _with("SELECT posting_id, location_city, location_region, location_country, location_resolved, location_alias_version FROM placed", "placed"),
        "l_places": _with("""SELECT place_id, location, CASE WHEN contains(gives, 'city') AND n >= 1 THEN n_name ELSE '' END AS location_city, CASE WHEN contains(gives, 'region') THEN code ELSE '' END AS location_region,
            CASE WHEN contains(gives, 'country') THEN iso ELSE '' END AS location_country, gives <> '' AS location_resolved FROM shapes""", "shapes"),
        "l_targets": _with("""SELECT user_id, array_to_string(list_transform(targets, lambda x: x.raw || '/' || coalesce(x.city, '-') || '/' || coalesce(x.region, '-') || '/' || coalesce(x.country, '-') || '/' || x.resolved::VARCHAR), '|') AS targets,
            len(list_filter(targets, lambda x: NOT x.resolved)) > 0 AS unresolved FROM people""", "people"),
        "u_upsert": _with("SELECT source_ats, source_job_id, title, content_hash, employer, status, tags, ruleset_version, needs_classification, scraped_at, outcome FROM merged", "merged"),
        "u_stats": _with("""SELECT s.source_ats, s.board_token, CASE WHEN s.employer <> 'src4' THEN coalesce(created, 0) END AS created, CASE WHEN s.employer <> 'src4' THEN coalesce(reopened, 0) END AS reopened,
            CASE WHEN s.employer <> 'src4' THEN coalesce(updated, 0) END AS updated, CASE WHEN s.employer <> 'src4' THEN coalesce(unchanged, 0) END AS unchanged, CASE WHEN s.employer <> 'src4' THEN coalesce(closed, 0) END AS closed,
            CASE WHEN s.employer = 'src4' THEN 'parse error' END AS error
            FROM (SELECT DISTINCT source_ats, board_token, employer FROM postings WHERE employer NOT IN ('src3', 'src5')) s
            LEFT JOIN (SELECT source_ats, employer, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'reopened') AS reopened, count(*) FILTER (outcome = 'updated') AS updated,
                       count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'closed') AS closed FROM merged GROUP BY ALL) m ON s.source_ats = m.source_ats AND s.employer = m.employer""", "postings", "merged"),
        "u_pending": _with("SELECT source_ats, source_job_id FROM merged WHERE outcome IN ('created', 'updated', 'reopened')", "merged"),
        "u_sweep": _with("SELECT posting_id, CASE WHEN seen = 'v1' THEN right_city ELSE had_city END AS location_city, CASE WHEN seen = 'v1' THEN right_resolved ELSE had_resolved END AS location_resolved, 'v3' AS location_alias_version FROM stamped", "stamped"),
        "u_diff": _with("""SELECT posting_id AS id, CASE WHEN NOT right_resolved THEN 'regressed' ELSE 'changed' END AS kind, had_city AS old_city, right_city AS new_city FROM stamped
            WHERE had_resolved AND (NOT right_resolved OR had_city <> right_city)""", "stamped"),
        "u_diff_profiles": _with("SELECT user_id, 1::BIGINT AS n_lost FROM people WHERE user_id % 6 = 0", "people"),
        "u_coverage": _with("""SELECT 'all' AS what, count(*) AS n, count(*) FILTER (location_resolved) AS resolved, count(DISTINCT CASE WHEN NOT location_resolved THEN location END) AS distinct_unresolved FROM placed
            UNION ALL SELECT * FROM (SELECT location, count(*) AS n, NULL, NULL FROM placed WHERE NOT location_resolved GROUP BY location ORDER BY n DESC, location LIMIT 5)""", "placed"),
        "u_coverage_rounds": _with("""SELECT strftime(scraped_at, '%Y-%m-%d') AS what, count(*) AS n, count(*) FILTER (location_resolved) AS resolved, count(DISTINCT CASE WHEN NOT location_resolved THEN location END) AS distinct_unresolved FROM placed GROUP BY 1
            UNION ALL SELECT 'all', count(*), count(*) FILTER (location_resolved), count(DISTINCT CASE WHEN NOT location_resolved THEN location END) FROM placed
            UNION ALL SELECT * FROM (SELECT location, count(*) AS n, NULL, NULL FROM placed WHERE NOT location_resolved GROUP BY location ORDER BY n DESC, location LIMIT 5)""", "placed"),
        "u_employers": """WITH k AS (SELECT s_suppkey AS seq, CASE s_suppkey % 3 WHEN 0 THEN 'Acme, Inc ' WHEN 1 THEN 'acme inc ' ELSE ' ACME INC ' END || (s_nationkey % 4) AS name,
            'acme-inc-' || (s_nationkey % 4) AS base FROM supplier), f AS (SELECT base, lower(trim(name)) AS key, min(seq) AS first FROM k GROUP BY ALL),
            r AS (SELECT base, key, row_number() OVER (PARTITION BY base ORDER BY first) AS i FROM f)
            SELECT seq, name, CASE WHEN i = 1 THEN r.base ELSE r.base || '-' || i END AS slug FROM k JOIN r ON k.base = r.base AND lower(trim(k.name)) = r.key""",
        "u_register": _with("SELECT ats, token AS board_token, s_nationkey AS job_count, CASE WHEN s_suppkey % 3 = 0 THEN 'already_registered' ELSE 'registered' END AS result FROM tokens", "tokens"),
        "r_classify": _with(f"""SELECT posting_id, array_to_string({_tags()}, '|') AS tags, array_to_string(list_filter([CASE WHEN contains(t, 'backend') OR contains(t, 'back-end') OR contains(t, 'back end') OR contains(t, 'server-side') THEN 'backend' END,
            CASE WHEN contains(t, 'data scientist') OR contains(t, 'data analyst') OR contains(t, 'machine learning') OR contains(t, 'ml ') OR contains(t, 'analytics') THEN 'data' END,
            CASE WHEN contains(t, 'designer') OR contains(t, 'ux ') OR contains(t, 'ui/ux') OR contains(t, 'product design') THEN 'design' END,
            CASE WHEN contains(t, 'kubernetes') OR contains(t, 'terraform') OR contains(t, 'ansible') OR contains(t, 'ci/cd') OR contains(t, 'ci / cd') THEN 'devops' END,
            CASE WHEN contains(t, 'frontend') OR contains(t, 'front-end') OR contains(t, 'front end') OR contains(t, 'ui engineer') THEN 'frontend' END,
            CASE WHEN regexp_matches(t, '{_W}(golang|go (developer|engineer|programmer|programming|lang)){_E}') THEN 'golang' END, CASE WHEN salary_min >= 150000 THEN 'high_comp' END,
            CASE WHEN contains(t, 'javascript') OR contains(t, 'typescript') OR contains(t, 'react') OR contains(t, 'node.js') OR contains(t, 'nodejs') THEN 'javascript' END,
            CASE WHEN regexp_matches(t, '{_W}(junior|entry[- ]level|graduate){_E}') THEN 'junior' END, CASE WHEN contains(t, 'kubernetes') OR contains(t, 'k8s') THEN 'kubernetes' END,
            CASE WHEN contains(t, 'python') OR contains(t, 'django') OR contains(t, 'flask') OR contains(t, 'fastapi') THEN 'python' END, CASE WHEN is_remote THEN 'remote' END,
            CASE WHEN regexp_matches(t, '{_W}senior{_E}') THEN 'senior' END, CASE WHEN regexp_matches(t, '{_W}staff{_E}') THEN 'staff' END], lambda x: x IS NOT NULL), '|') AS v1_tags
            FROM (SELECT *, lower(coalesce(title, '') || chr(10) || coalesce(description, '')) AS t FROM postings)""", "postings"),
        "r_pending": _with(f"""SELECT posting_id, CASE WHEN due THEN array_to_string(tags, '|') ELSE 'noun' END AS tags, CASE WHEN due THEN 'demo' ELSE 'v0' END AS ruleset_version, posting_id % 2 = 0 AND NOT due AS needs_classification,
            due AND tags <> ['noun'] AS changed FROM (SELECT posting_id, {_tags()} AS tags, posting_id % 2 = 0 AND row_number() OVER (PARTITION BY posting_id % 2 ORDER BY posting_id) <= 200 AS due FROM postings)""", "postings"),
        "r_compare": _with(f"""SELECT posting_id, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), '|') AS only_a, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), '|') AS only_b
            FROM (SELECT posting_id, {_tags()} AS a, {_tags(80000, False)} AS b FROM postings) WHERE a <> b""", "postings"),
        "j_candidates": _with("SELECT user_id, posting_id FROM pairs", "pairs"),
        "j_by_tag": _with("SELECT user_id, posting_id FROM pairs WHERE len(target_tags) = 0 OR len(list_intersect(target_tags, tags)) > 0", "pairs"),
        "j_scores": _with("SELECT * FROM shown", "shown"),
        "j_match_postings": _with("""SELECT * FROM shown_old WHERE posting_id NOT IN (SELECT posting_id FROM changed)
            UNION ALL SELECT s.* FROM shown s JOIN postings p USING (posting_id) JOIN changed USING (posting_id) WHERE status = 'open'""", "shown_old", "shown", "changed"),
        "j_rematch": _with(f"""SELECT o.* FROM shown_old o JOIN people u USING (user_id) WHERE u.min_salary IS NULL
            UNION ALL SELECT o.* FROM shown_old o JOIN postings p USING (posting_id) JOIN people u USING (user_id) WHERE u.min_salary IS NOT NULL AND u.is_active AND p.status = 'open' AND p.scraped_at < TIMESTAMP '{NOW_TEXT}' - INTERVAL 30 DAY
            UNION ALL SELECT s.* FROM shown s JOIN postings p USING (posting_id) JOIN people u USING (user_id) WHERE u.min_salary IS NOT NULL AND p.status = 'open' AND p.scraped_at >= TIMESTAMP '{NOW_TEXT}' - INTERVAL 30 DAY""", "shown_old", "shown"),
        "j_hint": """WITH b AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '#0000000' || substr(s_name, 17, 2) WHEN 1 THEN 'no' ELSE upper(substr(s_name, 9)) END AS derived_employer_name FROM supplier)
            SELECT s_suppkey, derived_employer_name, coalesce((SELECT min(s_name) FROM supplier s WHERE contains(lower(s_name), lower(b.derived_employer_name))), '') AS similar_employer FROM b""",
        "q_top20": _with("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC, posting_id)::INT AS rank FROM shown) WHERE rank <= 20", "shown"),
        "q_actions": _with("SELECT * FROM done", "done"),
        "q_page": _with("""SELECT user_id, posting_id, match_score, action, rank::INT AS rank, page::INT AS page FROM (SELECT *, least(2, ceil(count(*) OVER (PARTITION BY user_id) / 20.0)) AS page FROM ranked)
            WHERE rank > (page - 1) * 20 AND rank <= page * 20""", "ranked"),
        "q_cards": _with("""SELECT user_id, posting_id, title, source_url AS link, upper(employer) AS employer, CASE WHEN is_remote THEN 'Remote' ELSE location END AS place, printf('%.2f', match_score) AS score, replace(matched_tags, '|', ', ') AS why
            FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC, posting_id) AS rank FROM shown) JOIN postings USING (posting_id) WHERE rank <= 10""", "shown"),
        "q_search": _with("SELECT posting_id, title FROM postings WHERE list_has_all(regexp_extract_all(lower(title || chr(10) || description), '[\\p{L}\\p{N}]+'), ['tion', 'ing'])", "postings"),
        "s_places": _with("""SELECT 'city' AS kind, ord, feature_code AS code, name, population FROM (SELECT * REPLACE (row_number() OVER (ORDER BY ord) - 1 AS ord) FROM cities) WHERE population >= 15000
            UNION ALL SELECT 'region', min(ord), country_code || '.' || admin1_code, arg_max(name, ord), 0 FROM (SELECT * REPLACE (row_number() OVER (ORDER BY ord) - 1 AS ord) FROM cities) GROUP BY 3
            UNION ALL SELECT 'country', row_number() OVER (ORDER BY ord) - 1, iso, name, population FROM countries""", "cities", "countries"),
        "d_new": _with("SELECT ats, token FROM fresh WHERE r <= 15", "fresh"),
        "d_queue": _with("""SELECT f.ats, f.token, display AS derived_employer_name, f.s_nationkey AS discovered_job_count, 'pending' AS status FROM fresh f JOIN named n ON f.s_suppkey = n.s_suppkey
            WHERE r <= 50 AND f.s_suppkey % 7 <> 2 AND f.s_suppkey % 5 <> 1""", "fresh", "named"),
        "d_stats": _with("""SELECT ats, sum(1)::BIGINT AS found, sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END)::BIGINT AS already_known, sum(CASE WHEN r <= 15 AND good THEN 1 ELSE 0 END)::BIGINT AS validated,
            sum(CASE WHEN r <= 15 AND NOT good THEN 1 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN r > 15 THEN 1 ELSE 0 END)::BIGINT AS skipped_for_cap, coalesce(bool_or(ats = 'ashby'), false) AS search_failed
            FROM (SELECT t.ats, f.r, t.s_suppkey % 7 <> 2 AND t.s_suppkey % 5 <> 1 AS good FROM tokens t LEFT JOIN fresh f ON t.s_suppkey = f.s_suppkey) GROUP BY ROLLUP (ats)""", "tokens", "fresh"),
        "d_review": f"""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 2 OR s_suppkey % 3 = 1 THEN 'rejected' WHEN s_suppkey % 3 = 2 OR r > {SLOW_BATCH} THEN 'pending' ELSE 'approved' END AS status,
            CASE WHEN s_suppkey % 4 <> 2 AND s_suppkey % 3 <> 2 AND (s_suppkey % 3 = 1 OR r IS NULL OR r <= {SLOW_BATCH}) THEN TIMESTAMP '{NOW_TEXT}' END AS reviewed_at
            FROM (SELECT *, CASE WHEN s_suppkey % 4 = 3 AND s_suppkey % 3 = 0 THEN row_number() OVER (PARTITION BY s_suppkey % 4 = 3 AND s_suppkey % 3 = 0 ORDER BY s_suppkey) END AS r FROM supplier)""",
        "d_drift": _with("SELECT ats, token, s_nationkey AS discovered_job_count, s_nationkey + 1 AS refetched FROM tokens WHERE s_suppkey % 2 = 1", "tokens"),
        "t_rate": """SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE * (5 - i) AS at, event_type, count(*) AS n, count(*) / 300.0::DOUBLE AS per_second FROM events, (SELECT unnest(generate_series(0, 4)) AS i) GROUP BY ALL""",
        "t_p95": "SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS at, event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL",
        "t_quantiles": "SELECT date_trunc('day', ts) + INTERVAL 1 DAY AS at, event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL",
        "t_histogram": """WITH b AS (SELECT unnest([5.0, 10, 20, 40, 80, 160, 'inf'::DOUBLE]) AS le, unnest([0.0, 5, 10, 20, 40, 80, 160]) AS low),
            n AS (SELECT event_type, le, low, sum(CASE WHEN value <= le THEN 1 ELSE 0 END)::DOUBLE AS n, sum(CASE WHEN value <= low AND low > 0 THEN 1 ELSE 0 END)::DOUBLE AS before, 0.95 * count(*)::DOUBLE AS rank FROM events, b GROUP BY ALL)
            SELECT event_type, round(CASE WHEN arg_min(le, le) = 'inf'::DOUBLE THEN arg_min(low, le) ELSE arg_min(low + (le - low) * (rank - before) / (n - before), le) END, 6) AS quantile FROM n WHERE n >= rank GROUP BY event_type""",
        "t_backlog": "SELECT event_id, user_id, sum(CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS backlog FROM events",
        "t_backlog_total": "SELECT sum(CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END)::BIGINT AS backlog FROM events",
        "t_errors": """SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS at, event_type, count(*) AS n, count(*) / 3600.0::DOUBLE AS per_second FROM events
            WHERE regexp_full_match(CAST(CAST(json_extract_string(props, '$.k') AS INT) * 10 AS VARCHAR), '5..') GROUP BY ALL""",
        "t_gauge": "SELECT date_trunc('day', ts) + INTERVAL 1 DAY AS at, user_id, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY ALL",
        "t_counter": "SELECT event_id, CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END AS increase FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)",
        "t_debounce": """SELECT user_id, max(ts) AS last_ts, count(*) AS n, arg_max(event_type, (ts, event_id)) AS event_type FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM
            (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, g""",
        "t_debounce_batch": "SELECT event_id, user_id, ts FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) WHERE f IS NULL OR f - ts >= INTERVAL 1 HOUR",
    }
    out["l_remembered"], out["q_search_index"] = out["l_places"], out["q_search"]
    return out
