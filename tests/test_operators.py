"""Feeds, upsert, rules, matching, retrieval, discovery, telemetry and the stream, on small tables."""

import collections
import datetime
import json
import os
import random
import shutil
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from test_places import inputs
from vacantry.functions import search, text
from vacantry.operators import discovery, gazetteer, matching, retrieval, rules, telemetry, upsert
from vacantry.plans import queries as plans
from vacantry.schemas import POSTING
from vacantry.sources import feeds, files
from vacantry.streaming import pipeline

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def look(spark):
    return gazetteer.prepared(gazetteer.build_gazetteer(*inputs(spark)))


def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


# --- feeds ---


def test_feeds(spark):
    a = {"jobs": [{"id": 1, "title": "Senior Engineer", "absolute_url": "u1", "location": {"name": "Remote - US"}, "content": "&lt;p&gt;We use &lt;strong&gt;Python&lt;/strong&gt; &amp;amp; Go.&lt;/p&gt;"}, {"id": 0, "title": "Other", "location": None, "content": None}], "meta": {"total": 2}}
    b = [{"id": "x", "text": "T", "hostedUrl": "h", "categories": {"location": "New York"}, "workplaceType": "remote", "descriptionPlain": "d"}]
    c = {"jobs": [{"id": "y", "title": "T", "location": "Berlin", "isRemote": True, "jobUrl": "j"}]}
    flat = spark.createDataFrame([("w", 0, None, "T", "d", "Paris", False, 1, 2, "u")], "board_token string, ordinal int, ats_id string, title string, description string, location string, is_remote boolean, salary_min int, salary_max int, url string")
    board = lambda x: spark.createDataFrame([("t", json.dumps(x))], "board_token string, payload string")
    all_ = feeds.unify_feeds({"greenhouse": board(a), "lever": board(b), "ashby": board(c), "workday": flat})
    good, failed = feeds.split_bad(all_)
    got = {(r["source_ats"], r["source_job_id"]): r for r in good.collect()}
    assert failed.count() == 0 and len(got) == 5
    assert got[("greenhouse", "1")]["description"] == "<p>We use <strong>Python</strong> &amp; Go.</p>" and got[("greenhouse", "1")]["is_remote"]
    assert got[("greenhouse", "0")]["location"] == "" and not got[("greenhouse", "0")]["is_remote"]
    assert got[("lever", "x")]["is_remote"] and got[("ashby", "y")]["is_remote"] and got[("workday", "")]["salary_max"] == 2
    with pytest.raises(feeds.FeedError):
        feeds.unify_feeds({"other": flat})


def test_boards_come_in_pages(spark, monkeypatch):
    """A payload holds no more records than its page may have, whatever its board has; the rows are the same."""
    data = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(str, plans.s_feeds(spark, data).collect()))
    failed = lambda: sorted(map(tuple, plans.s_bad_boards(spark, data).collect()))
    whole = rows(), failed()
    monkeypatch.setattr(plans, "PAGE_IDS", 20, raising=False)
    assert (rows(), failed()) == whole and all(whole)
    made = plans._payloads(spark, data)
    sizes = [r["n"] for r in made["lever"].select(F.expr("json_array_length(payload)").alias("n")).collect()]
    assert max(sizes) <= 5 and sum(sizes) == 50
    assert made["lever"].count() > made["lever"].select("board_token").distinct().count()
    at = [tuple(r) for r in feeds.feed_b(made["lever"]).select("board_token", "ordinal").collect()]
    assert len(at) == 50 == len(set(at))


def test_one_bad_record_fails_its_board(spark):
    rows = [("good", json.dumps([{"id": "1", "text": "T"}])), ("bad", json.dumps([{"id": "1", "text": "T"}, {"id": "", "text": "T"}])), ("broken", "{"), ("none", "[]")]
    good, failed = feeds.split_bad(feeds.unify_feeds({"lever": spark.createDataFrame(rows, "board_token string, payload string")}))
    assert [r["board_token"] for r in good.collect()] == ["good"] and {r["board_token"] for r in failed.collect()} == {"bad", "broken"}


# --- upsert ---

CONTENT = "source_ats string, board_token string, ordinal int, source_job_id string, title string, description string, location string, is_remote boolean, location_city string, location_region string, location_country string, location_resolved boolean, location_alias_version string, salary_min int, salary_max int, source_url string"


def batch(spark, *jobs, board="b"):
    rows = [("lever", board, k, i, title, "d", "Here", False, "", "", "", False, "v3", None, None, "u") for k, (i, title) in enumerate(jobs)]
    return spark.createDataFrame(rows, CONTENT)


def step(spark, current, jobs, board="b"):
    sources = spark.createDataFrame([("lever", "b", "acme"), ("lever", "c", "other")], "source_ats string, board_token string, employer string").where(F.col("board_token") == board)
    names = [f.name for f in POSTING.fields]
    current = spark.createDataFrame([], POSTING) if current is None else current.select(*names)
    out = upsert.upsert(current, batch(spark, *jobs, board=board), sources, now())
    return spark.createDataFrame(out.collect(), out.schema)


def outcomes(df):
    return {r["source_job_id"]: r["outcome"] for r in df.collect()}


def test_upsert_sequences(spark):
    s = step(spark, None, [("1", "A"), ("2", "B")])
    assert outcomes(s) == {"1": "created", "2": "created"} and all(r["needs_classification"] and r["employer"] == "acme" for r in s.collect())
    tagged = s.withColumns({"needs_classification": F.lit(False), "classification_tags": F.array(F.lit("python")), "ruleset_version": F.lit("v1")})
    same = step(spark, tagged, [("1", "A"), ("2", "B")])
    assert outcomes(same) == {"1": "unchanged", "2": "unchanged"} and not any(r["needs_classification"] for r in same.collect())
    new = {r["source_job_id"]: r for r in step(spark, tagged, [("1", "A2")]).collect()}
    assert new["1"]["outcome"] == "updated" and new["1"]["classification_tags"] == ["python"] and new["1"]["needs_classification"]
    assert new["2"]["outcome"] == "closed" and new["2"]["status"] == "closed"
    again = {r["source_job_id"]: r for r in step(spark, step(spark, tagged, [("1", "A")]), [("1", "A"), ("2", "B")]).collect()}
    assert again["2"]["outcome"] == "reopened" and again["2"]["classification_tags"] == [] and again["2"]["ruleset_version"] == "" and again["2"]["status"] == "open"
    assert set(outcomes(step(spark, tagged, [])).values()) == {"closed"}
    assert outcomes(step(spark, tagged, [("9", "Z")], board="c")) == {"1": None, "2": None, "9": "created"}
    twice = {r["source_job_id"]: r for r in step(spark, None, [("1", "A"), ("1", "B")]).collect()}
    assert twice["1"]["title"] == "B" and twice["1"]["outcome"] == "created"
    stats = upsert.ingest_stats(step(spark, tagged, [("1", "A2")]), spark.createDataFrame([("lever", "b", "acme", True)], "source_ats string, board_token string, employer string, is_active boolean"), spark.createDataFrame([], "source_ats string, board_token string")).first()
    assert (stats["updated"], stats["closed"], stats["error"]) == (1, 1, None)


def test_hash_tells_null_from_empty(spark):
    df = spark.createDataFrame([("", None, "1"), (None, "", "2")], "title string, description string, k string")
    assert len({r[0] for r in df.select(text.content_hash("title", "description")).collect()}) == 2


def test_employers(spark):
    got = upsert.assign_employers(spark.createDataFrame([("Acme Inc", 0), ("Acme, Inc.", 1), (" acme inc ", 2), ("Acme, Inc.", 3)], "name string, seq int")).collect()
    assert {r["seq"]: r["slug"] for r in got} == {0: "acme-inc", 1: "acme-inc-2", 2: "acme-inc", 3: "acme-inc-2"}


def test_unique(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert upsert.assert_unique(df, ["k"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        upsert.assert_unique(df.union(df), ["k"]).collect()


# --- text ---


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(text.title_case(lit("o'neil 3m-corp éa"))) == "O'Neil 3M-Corp Éa"
    assert one(text.display_name(lit("workday"), lit("https://acme-corp.wd5.myworkdayjobs.com/x"))) == "Acme Corp"
    assert one(text.display_name(lit("lever"), lit("big_co"))) == "Big Co"
    assert one(text.valid_board_url(lit("https://a.b.myworkdayjobs.com/x"))) and not one(text.valid_board_url(lit("https://a/b.c.myworkdayjobs.com/x")))
    for bad in ("https://a.b.myworkdayjobs.com/x@evil/..", "https://a.b.myworkdayjobs.com", "https://a.b.myworkdayjobs.com/", "https://a.b.myworkdayjobs.com/x/y", "http://a.b.myworkdayjobs.com/x"):
        assert not one(text.valid_board_url(lit(bad)))
    assert one(text.slugify(lit("  Ácme & Sons, Inc. - x_ "))) == "acme-sons-inc-x" and one(text.slugify(lit("Škoda Łódź"))) == "skoda-odz"
    assert one(text.clean_alias(lit(" Gießen."))) == "giessen" and len(one(text.title_case(F.repeat(lit("a"), lit(1_100_000))))) == 1_100_000
    assert one(text.csv_list(lit(" a, ,b,a "))) == ["a", "b", "a"] and one(text.csv_list(lit(None).cast("string"))) == []
    assert one(text.clean_query(lit(" a\0b "))) == "ab" and one(text.unescape(lit("&amp;lt;&eacute;"))) == "&lt;é"
    assert one(text.fold_unicode(lit("Straße ﬁ"))) == "strasse fi" and one(text.clean_alias(lit(" U.S. "))) == "us" and one(text.clean_alias(lit(" . "))) is None
    assert one(text.is_remote(lit("Work From Home, US"))) and not one(text.is_remote(lit(None).cast("string")))
    assert one(text.status_for_score(lit(0.4))) == "recommended" and one(text.looks_like_airport(lit("LON"))) and not one(text.looks_like_airport(lit("Lon")))


# --- rules ---


def test_rules_golden(spark):
    rows = [("Senior Backend Engineer", "We use Python and Kubernetes to run our platform.", True, 160000), ("Product Designer", "Craft delightful UX for our users.", False, None), ("Office Manager", "Keep the office running smoothly.", False, None), ("senioritis", "go home", False, None), ("Go developer", None, None, 149999)]
    got = rules.classify(spark.createDataFrame(rows, "title string, description string, is_remote boolean, salary_min int")).collect()
    assert [r["tags"] for r in got] == [["backend", "devops", "high_comp", "kubernetes", "python", "remote", "senior"], ["design"], [], [], ["golang"]]
    with pytest.raises(rules.RuleError):
        rules.rule_expr({"type": "what"}, F.lit(""))


def test_ruleset_files(spark, tmp_path):
    (tmp_path / "v2.json").write_text(json.dumps({"rules": [{"tag": "x", "type": "keyword_all", "keywords": ["a", "b"]}]}))
    (tmp_path / "v3.json").write_text("{}")
    assert files.load_rules(spark, str(tmp_path), "v2")["rules"][0]["tag"] == "x"
    for v in ("v3", "v4"):
        with pytest.raises(rules.RuleError):
            files.load_rules(spark, str(tmp_path), v)


# --- matching: Spark against a local scorer ---

TARGET = "array<struct<raw:string,city:string,region:string,country:string,resolved:boolean>>"
PROFILES = f"user_id long, target_titles array<string>, target_tags array<string>, target_locations array<string>, target_locations_normalized {TARGET}, excluded_employers array<string>, min_salary int, remote_pref string, is_active boolean"
POSTINGS = "posting_id long, title string, classification_tags array<string>, location string, location_city string, location_region string, location_country string, location_resolved boolean, is_remote boolean, salary_min int, salary_max int, employer_slug string"


def local_score(p, j):
    """(score, tags) of a pair, or null if a gate stops it: a plain model to hold the columns against."""
    tags, targets = set(j["classification_tags"] or []), p["target_tags"] or []
    ceiling = j["salary_max"] if j["salary_max"] is not None else j["salary_min"]
    if j["employer_slug"] in (p["excluded_employers"] or []) or p["remote_pref"] == ("onsite_only" if j["is_remote"] else "remote_only"):
        return None
    if p["min_salary"] is not None and ceiling is not None and ceiling < p["min_salary"]:
        return None
    matched = sorted({x for x in targets if x in tags})
    title = (j["title"] or "").lower()
    hit = any(x and (x.lower() in title or title in x.lower()) for x in p["target_titles"] or [])
    stated = p["target_locations_normalized"] or []
    idle = [t for t in stated if t[4] and not (t[1] or t[2] or t[3])]
    real = [t for t in stated if t not in idle]
    own = (j["location_city"], j["location_region"], j["location_country"])
    if j["is_remote"] or not real:
        place = 1.0
    elif any(t[4] and all(not a or a == b for a, b in zip(t[1:4], own, strict=True)) for t in real):
        place = 1.0
    elif j["location_resolved"]:
        place = 0.0
    else:
        raws = {t[0] for t in idle}
        place = float(any(x and x not in raws and x.lower() in (j["location"] or "").lower() for x in p["target_locations"] or []))
    pay = 1.0 if p["min_salary"] is None else 0.5 if j["salary_min"] is None else float(j["salary_min"] >= p["min_salary"])
    return round(0.5 * (len(matched) / len(targets) if targets else 0.0) + 0.2 * hit + 0.2 * place + 0.1 * pay, 6), matched


some = st.sampled_from
tags = st.lists(some(["a", "b", "c"]), max_size=4)
profile = st.tuples(st.lists(some(["Engineer", "x", ""]), max_size=2), tags, st.lists(some(["NY", "Remote", "york", ""]), max_size=2),
                    st.lists(some([("NY", None, None, None, False), ("Remote", None, None, None, True), ("US", None, None, "US", True), ("x", "Albany", "NY", "US", True)]), max_size=3),
                    st.lists(some(["acme"]), max_size=1), some([None, 100, 200]), some(["any", "remote_only", "onsite_only"]))
posting = st.tuples(some(["Senior Engineer", "", "x"]), tags, some(["New York", "albany", None]), some([("", "", "", False), ("Albany", "NY", "US", True), ("", "", "UK", True)]), st.booleans(), some([None, 100, 150]), some([None, 150, 300]), some(["acme", "b"]))


@given(st.lists(profile, min_size=1, max_size=4), st.lists(posting, min_size=1, max_size=4))
@settings(max_examples=8, deadline=None)
def test_scores_equal_a_local_scorer(spark, profiles, postings):
    ps = [(i, a, b, c, d, e, f, g, True) for i, (a, b, c, d, e, f, g) in enumerate(profiles)]
    js = [(i, a, b, c, *d, e, f, g, h) for i, (a, b, c, d, e, f, g, h) in enumerate(postings)]
    pf, jf = spark.createDataFrame(ps, PROFILES), spark.createDataFrame(js, POSTINGS)
    got = {(r["user_id"], r["posting_id"]): (r["match_score"], r["matched_tags"]) for r in matching.scored(jf, pf).collect()}
    want = {(p["user_id"], j["posting_id"]): s for p in pf.collect() for j in jf.collect() if (s := local_score(p, j))}
    assert got == want


def many_of_both(spark, users, jobs, seed=1):
    """Profiles and postings with ties, unknown pay, empty titles, rare and common tags."""
    rng = random.Random(seed)
    pick = lambda xs, k: [rng.choice(xs) for _ in range(rng.randrange(k + 1))]
    where = [("", "", "", False), ("Albany", "NY", "US", True), ("", "", "UK", True)]
    spots = [("NY", None, None, None, False), ("US", None, None, "US", True), ("x", "Albany", "NY", "US", True)]
    common = ["a", "b"] + [f"r{i}" for i in range(12)]
    ps = [(i, pick(["Engineer", "nurse of x", "x", "ok", ""], 2), pick(common, 3), pick(["NY", "york"], 1), pick(spots, 2), pick(["acme", "b"], 1), rng.choice([None, 100, 150, 400]), rng.choice(["any", "remote_only", "onsite_only"]), rng.random() < 0.9) for i in range(users)]
    js = [(i, rng.choice(["Senior Engineer", "Nurse", "Cook", "x", "", None, f"Cook {i % 7}"]), pick(common, 2), rng.choice(["New York", None]), *rng.choice(where), rng.random() < 0.3, rng.choice([None, 0, 100, 100, 150, 260, 500]), rng.choice([None, 90, 300, 900]), rng.choice(["acme", "b", "c"])) for i in range(jobs)]
    return spark.createDataFrame(ps, PROFILES), spark.createDataFrame(js, POSTINGS)


@pytest.mark.parametrize("n, first, chunk", [(3, 1, 4), (20, 4, 32)])
def test_best_by_bounds_equal_the_best_of_all(spark, n, first, chunk, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", chunk)
    profiles, postings = many_of_both(spark, 40, 300)
    best = collections.defaultdict(list)
    for r in matching.top_matches(postings, profiles, n, first=first).collect():
        best[r["user_id"]].append((r["rank"], r["posting_id"], r["match_score"], r["matched_tags"]))
    all_ = collections.defaultdict(list)
    for r in matching.scored(postings, profiles).collect():
        all_[r["user_id"]].append((-r["match_score"], r["posting_id"], r["match_score"], r["matched_tags"]))
    assert {u: sorted(x) for u, x in best.items()} == {u: [(k, *x[1:]) for k, x in enumerate(sorted(rows)[:n], 1)] for u, rows in all_.items()}
    assert matching.top_matches(postings.limit(0), profiles).count() == matching.top_matches(postings, profiles.limit(0)).count() == 0


def test_pairs_for_the_best_grow_less_than_both_sides(spark):
    """Four times the users and the postings make far fewer than 16 times the pairs, and few of all."""
    made = {}
    for k in (1, 4):
        profiles, postings = many_of_both(spark, 60 * k, 2000 * k)
        counted = []
        matching.top_matches(postings, profiles, 5, counted=counted)
        made[k] = sum(counted), matching.candidates(postings, profiles).count()
    assert made[1][0] < made[1][1] / 4 and made[4][0] < made[4][1] / 8 and made[4][0] < 12 * made[1][0]


def test_titles_are_found_by_their_rarest_piece(spark):
    titles = ["senior engineer", "x", "ab", "engineers", "nurse of the ward", "wardens"]
    targets = ["engineer", "x", "senior engineer of all", "b", "ward", "the", "abc"]
    df = spark.createDataFrame([(t,) for t in [*titles, ""]], "title_text string")
    hits = {r["title_text"]: r["hits"] for r in matching.title_hits(df, spark.createDataFrame([(targets,)], "titles array<string>")).collect()}
    assert hits == {t: w for t in titles if (w := sorted(x for x in targets if x in t or t in x))}


def test_tag_index_makes_only_pairs_that_share_a_tag(spark, monkeypatch):
    """Before the gates there are the pairs of shared tags, by posting lists, far below all; a common tag is dealt over fields."""
    monkeypatch.setattr(matching, "FIELD_POSTINGS", 16)
    monkeypatch.setattr(matching, "FIELD_WISHES", 2)
    profiles, postings = many_of_both(spark, 60, 400)
    got = {(r["user_id"], r["posting_id"]) for r in matching.candidates_by_tag(postings, profiles).collect()}
    ps, js = [p for p in profiles.collect() if p["is_active"]], postings.collect()
    share = lambda p, j: not p["target_tags"] or set(p["target_tags"]) & set(j["classification_tags"])
    assert got == {(p["user_id"], j["posting_id"]) for p in ps for j in js if share(p, j) and local_score(p, j)}
    met = matching._met_by_tag(matching.posting_side(postings), matching._wishes(profiles))
    sizes = [r["n"] for r in met.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.size("members")).alias("n")).collect()]
    allowed = lambda p, j: p["remote_pref"] != ("onsite_only" if j["is_remote"] else "remote_only")
    assert sum(sizes) == sum(bool(share(p, j)) and allowed(p, j) for p in ps for j in js) < 0.6 * len(ps) * len(js)
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)
    assert matching.candidates_by_tag(postings.limit(0), profiles).count() == 0


# --- retrieval ---


def test_retrieval(spark):
    log = spark.createDataFrame([(1, 1, "save", 1, 0), (1, 1, "apply", 2, 1), (1, 2, "dismiss", 1, 2), (1, 3, "wave", 1, 3)], "user_id long, posting_id long, action string, ts long, seq long")
    done = retrieval.apply_actions(log)
    assert {r["posting_id"]: r["status"] for r in done.collect()} == {1: "applied", 2: "dismissed"}
    matches = spark.createDataFrame([(1, i, 1 - i / 100, "recommended" if i < 50 else "below_threshold", []) for i in range(60)] + [(2, 1, 0.5, "recommended", [])], "user_id long, posting_id long, match_score double, match_status string, matched_tags array<string>")
    got = retrieval.recommend(matches, done, user=1)
    assert [r["posting_id"] for r in got.orderBy("rank").collect()][:3] == [0, 1, 3] and got.count() == 49
    assert retrieval.recommend(matches, done, show_all=True, user=1).where("posting_id = 2").isEmpty()
    sizes = {n: retrieval.page(got, n).count() for n in (1, "x", None, 3, 99, 0)}
    assert sizes == {1: 20, "x": 20, None: 20, 3: 9, 99: 9, 0: 9}


def test_search_and_stems(spark):
    stems = {"running": "run", "ponies": "poni", "caresses": "caress", "engineering": "engin", "engineer": "engin", "generously": "generous", "hopping": "hop", "hoping": "hope", "relational": "relat", "nationally": "nation", "sky": "sky", "cries": "cri", "by": "by", "agreed": "agre", "happy": "happi", "skies": "sky", "knightly": "knight"}
    assert {w: search.stem_word(w) for w in stems} == stems
    df = spark.createDataFrame([(1, "Senior Engineering Manager", "x"), (2, "Cook", "the engine room"), (3, "Nurse", None)], "posting_id long, title string, description string")
    find = lambda q, **k: {r["posting_id"] for r in search.search(df, q, **k).collect()}
    assert find("ENGINEER") == {1, 2} and find("engineer manager") == {1} and find("the and") == set() and find("engine", stemmed=False) == {2}


# --- discovery ---


def test_discovery(spark):
    directory = spark.createDataFrame([("lever", f"t{i:02}") for i in range(60)] + [("ashby", "t00")], "ats string, token string")
    known = spark.createDataFrame([("lever", "t00")], "ats string, token string")
    new = discovery.new_tokens(directory, known, known.limit(0))
    assert new.count() == 60 and discovery.cap_per_ats(new).count() == 51
    boards = spark.createDataFrame([("workday", f"u{i}", "pending", None) for i in range(7)], "ats string, token string, status string, reviewed_at timestamp")
    say = boards.select("ats", "token", F.lit("approved").alias("decision"))
    with pytest.raises(discovery.BatchTooLarge):
        discovery.guard_batch(say, boards)
    out = discovery.review(boards, say.limit(3), now())
    assert out.where("status = 'approved' and reviewed_at is not null").count() == 3
    assert discovery.review(out, say.withColumn("decision", F.lit("rejected")), now()).where("status = 'approved'").count() == 3


# --- telemetry and streams ---


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type = 'click'")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for k, f in enumerate((lambda d: telemetry.rate(d, ["event_type"]), lambda d: telemetry.debounce(d, "user_id", gap="1 hour"))):
        q = f(stream()).writeStream.format("memory").queryName(f"out{k}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        q.awaitTermination(120)
        got, want = {tuple(r) for r in spark.table(f"out{k}").collect()}, {tuple(r) for r in f(events).collect()}
        assert got and got <= want and len(got) > 0.9 * len(want)  # the last windows stay open until the watermark passes them


def test_counter_and_histogram(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 1), ("a", 2, 7.0, 2), ("a", 2, 1.0, 3), ("a", 3, 2.0, 4)], "k string, ts long, value double, event_id long")
    assert [r["increase"] for r in telemetry.counter_increase(df, ["k"]).orderBy("event_id").collect()] == [0.0, 2.0, 1.0, 1.0]
    at = df.withColumn("ts", F.timestamp_seconds("ts")).withColumn("name", F.concat("k", (F.col("event_id") % 2).cast("string")))
    assert [r["last"] for r in telemetry.gauge_last(at, ["k"]).collect()] == [2.0]
    assert [r["total"] for r in telemetry.gauge_sum(at, ["k"], over=["name"]).collect()] == [3.0]
    h = spark.createDataFrame([("a", 1.0, 50), ("a", 2.0, 90), ("a", 4.0, 100), ("a", float("inf"), 100)], "k string, le double, n long")
    assert telemetry.histogram_quantile(h, ["k"]).first()["quantile"] == 3.0


def test_pipeline_stream(spark, tmp_path):
    sources = spark.createDataFrame([("lever", "b", "acme")], "source_ats string, board_token string, employer string")
    profiles = spark.createDataFrame([(1, ["Python"], ["python"], [], [], [], None, "any", True)], PROFILES)

    def land(name, jobs):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps(r.asDict()) + "\n" for r in batch(spark, *jobs).collect()))
        pipeline.run_pipeline_stream(spark, str(tmp_path / "in"), str(tmp_path / "state"), sources, profiles).awaitTermination(180)
        return {r["posting_id"]: r["match_status"] for r in files.read_snapshot(spark, str(tmp_path / "state/matches")).collect()}

    assert land("1.json", [("1", "Python dev"), ("2", "Cook")]) == {"lever:1": "recommended"}
    assert land("2.json", [("1", "Python dev"), ("2", "Python cook")]) == {"lever:1": "recommended", "lever:2": "recommended"}
    state = files.read_snapshot(spark, str(tmp_path / "state/postings"))
    assert {r["source_job_id"]: r["classification_tags"] for r in state.collect()} == {"1": ["python"], "2": ["python"]}


def test_an_interrupted_round_is_repeated(spark, tmp_path, monkeypatch):
    """A round that dies while it writes, or between its two states, ends as one that did not."""
    sources = spark.createDataFrame([("lever", "b", "acme")], "source_ats string, board_token string, employer string")
    profiles = spark.createDataFrame([(1, ["Python"], ["python"], [], [], [], None, "any", True)], PROFILES)
    rounds = [batch(spark, ("1", "Python dev"), ("2", "Cook")), batch(spark, ("1", "Python dev"), ("2", "Python cook"))]
    seen = {}
    write = files.write_snapshot

    def dies(df, path, version):
        if version == 1 and path.endswith(at):
            df.write.parquet(f"{path}/v={version}")
            os.remove(f"{path}/v={version}/_SUCCESS")
            raise RuntimeError("lost")
        write(df, path, version)

    for at in ("", "postings", "matches"):
        state = str(tmp_path / f"s{at}")
        for n, b in enumerate(rounds):
            monkeypatch.setattr(pipeline, "write_snapshot", dies if at else write)
            try:
                pipeline.tick(spark, b, sources, profiles, state, n)
            except RuntimeError:
                monkeypatch.setattr(pipeline, "write_snapshot", write)
                pipeline.tick(spark, b, sources, profiles, state, n)
        rows = files.read_snapshot(spark, f"{state}/matches").drop("computed_at").collect(), files.read_snapshot(spark, f"{state}/postings").drop("scraped_at").collect()
        seen[at] = [sorted(map(str, r)) for r in rows]
    assert seen[""] == seen["postings"] == seen["matches"] and len(seen[""][0]) == 2


def test_feeds_to_matches_in_one_run(spark, tmp_path, look):
    """What boards send goes through readers, places, upsert and tags to matches; a failed board closes nothing, an empty one all."""
    sources = spark.createDataFrame([("lever", "b", "acme"), ("ashby", "c", "beta"), ("workday", "https://x", "gamma")], "source_ats string, board_token string, employer string")
    profiles = spark.createDataFrame([(1, ["Python"], ["python"], [], [], [], None, "any", True)], PROFILES)
    job = lambda i, t: {"id": i, "text": t, "categories": {"location": "Remote"}}
    flat = {"ordinal": 0, "ats_id": "w", "title": "Python", "description": "", "location": "", "is_remote": False, "url": "u"}

    def land(name, *sent):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("source_ats", "board_token", "payload"), (a, b, p if isinstance(p, str) else json.dumps(p)), strict=True))) + "\n" for a, b, p in sent))
        pipeline.run_feed_stream(spark, str(tmp_path / "in"), str(tmp_path / "state"), sources, profiles, look).awaitTermination(300)
        rows = files.read_snapshot(spark, str(tmp_path / "state/postings")).collect()
        return {f"{r['source_ats']}:{r['source_job_id']}": (r["status"], r["location_resolved"]) for r in rows}, files.read_snapshot(spark, str(tmp_path / "state/matches")).collect()

    state, matches = land("1.json", ("lever", "b", [job("1", "Python dev"), job("0", "Cook")]), ("ashby", "c", {"jobs": [{"id": "k", "title": "x"}]}), ("workday", "https://x", flat))
    assert state == {"lever:1": ("open", True), "lever:0": ("open", True), "ashby:k": ("open", False), "workday:w": ("open", False)}
    assert {r["posting_id"] for r in matches} == {"lever:1", "lever:0", "workday:w"} and all(r["computed_at"] for r in matches)
    state, _ = land("2.json", ("lever", "b", "{broken"), ("ashby", "c", {"jobs": []}))
    assert {k: s for k, (s, _) in state.items()} == {"lever:1": "open", "lever:0": "open", "ashby:k": "closed", "workday:w": "open"}


def test_profile_edits_to_a_refreshed_list(spark, look):
    """Saves are debounced, lists parsed, places normalised, and the user is matched anew; others keep what they have."""
    profiles = spark.createDataFrame([(1, [], ["x"], [], [], [], None, "any", True), (2, [], ["x"], [], [], [], None, "any", True)], PROFILES)
    rows = [(i, "Python dev", ["python"], "", "", "", "", False, False, None, None, "e") for i in range(2)]
    postings = spark.createDataFrame(rows, POSTINGS).withColumns({"status": F.lit("open"), "scraped_at": now()})
    matches = spark.createDataFrame([(u, p, 0.1, "below_threshold", [], datetime.datetime(2024, 1, 1)) for u in (1, 2) for p in (0, 1)], "user_id long, posting_id long, match_score double, match_status string, matched_tags array<string>, computed_at timestamp")
    at = lambda s: datetime.datetime(2024, 2, 1, 0, 0, s)
    edits = spark.createDataFrame([(1, at(0), 0, "a", "cook", "", "", None, "any", True), (1, at(3), 1, " Python, ", "python,sql", "", "", None, "any", True)], pipeline.EDITS)
    new, got = pipeline.apply_edits(edits, profiles, postings, matches, look, now())
    assert {r["user_id"]: (r["target_titles"], r["target_tags"]) for r in new.collect()} == {1: (["Python"], ["python", "sql"]), 2: ([], ["x"])}
    assert {(r["user_id"], r["posting_id"]): (r["match_score"], r["computed_at"].month) for r in got.collect()} == {(1, 0): (0.75, 3), (1, 1): (0.75, 3), (2, 0): (0.1, 1), (2, 1): (0.1, 1)}


def test_late_events(spark, tmp_path):
    """A stream counts an event that is late by less than the watermark's delay, and drops one that is later."""
    src, at = tmp_path / "in", lambda m: datetime.datetime(2024, 1, 1, 12, m)
    counts = {}
    for k, minutes in enumerate(([40], [33, 2], [59], [59])):
        spark.createDataFrame([(at(m), "a") for m in minutes], "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(src))
        q = telemetry.rate(stream, ["event_type"], win="1 minute", slide="1 minute", seconds=60).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
        q.foreachBatch(lambda b, n: counts.update({r["at"].minute - 1: r["n"] for r in b.collect()})).trigger(availableNow=True).start().awaitTermination(120)
    assert counts == {33: 1, 40: 1}


def test_pairs_are_dealt_over_all_partitions(spark):
    """Whatever few bytes the sides have, their pairs are made in as many tasks as there are shuffle partitions, none with most of them."""
    profiles = spark.createDataFrame([(i, [f"t{i}"], ["python"], [], [], [], None, "any", True) for i in range(200)], PROFILES)
    postings = spark.createDataFrame([(i, f"Python {i}", ["python"], "", "", "", "", False, False, None, None, "e") for i in range(200)], POSTINGS)
    made = matching.scored(postings, profiles)
    sizes = [r["n"] for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 40_000 and len(sizes) >= 4 and max(sizes) < 20_000
    best = matching.top_matches(postings, profiles, 3).collect()
    rows = made.collect()
    for u in (0, 7):
        want = sorted(((-r["match_score"], r["posting_id"]) for r in rows if r["user_id"] == u))[:3]
        assert [(-r["match_score"], r["posting_id"]) for r in sorted(best, key=lambda r: r["rank"]) if r["user_id"] == u] == want


def test_what_counts_as_missing_is_json_truth(spark):
    """The texts "0" and "false" are ids and titles; 0, false, null and empty ones are none."""
    cases = [('"0"', '"0"', True), ('"1"', '"false"', True), ("0", '"t"', False), ("false", '"t"', False), ('""', '"t"', False), ("null", '"t"', False), ("7", '"t"', True), ('"x"', "0", False), ('"x"', "[]", False)]
    rows = [(f"b{k}", f'[{{"id": {i}, "text": {t}}}]', f'{{"jobs": [{{"id": {i}, "title": {t}}}]}}') for k, (i, t, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "board_token string, b string, c string")
    for reader, column in ((feeds.feed_b, "b"), (feeds.feed_c, "c")):
        got = {r["board_token"]: r["bad"] for r in reader(df.select("board_token", F.col(column).alias("payload"))).collect()}
        assert got == {f"b{k}": not good for k, (_, _, good) in enumerate(cases)}


def test_snapshots_and_diffs(spark, tmp_path):
    files.write_snapshot(spark.range(3), str(tmp_path / "t"), 1)
    files.write_snapshot(spark.range(5), str(tmp_path / "t"), 2)
    os.makedirs(tmp_path / "t" / "v=3")  # broken off
    assert files.read_snapshot(spark, str(tmp_path / "t")).count() == 5 and files.read_snapshot(spark, str(tmp_path / "t"), 2).count() == 3
    files.write_snapshot(spark.range(7), str(tmp_path / "t"), 3)
    assert files.read_snapshot(spark, str(tmp_path / "t")).count() == 7
    with pytest.raises(FileExistsError):
        files.write_snapshot(spark.range(1), str(tmp_path / "t"), 3)
    place = "struct<location_city:string,location_region:string,location_country:string>"
    diff = spark.createDataFrame([(4, "changed", ("Paris", "", "FR"), ("", "TX", "US"))], f"id long, kind string, old {place}, new {place}")
    files.write_diff(diff, str(tmp_path / "text"), form="text")
    assert [r[0] for r in spark.read.text(str(tmp_path / "text")).collect()] == ["changed 4: Paris, FR -> TX, US"]
    files.write_diff(spark.range(0), str(tmp_path / "d0"), strict=True)
    with pytest.raises(files.NotEmpty):
        files.write_diff(spark.range(1), str(tmp_path / "d1"), strict=True)


def test_entry_without_the_corpus_part(tmp_path):
    """The entry imports, and has all other queries, where the optional part, or what it needs, is missing."""
    others = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    assert subprocess.run([sys.executable, "-c", others], cwd=tmp_path / "copy", timeout=120).returncode == 0
    assert subprocess.run([sys.executable, "-c", "import sys; sys.modules['xxhash'] = None; " + others], cwd=ROOT, timeout=120).returncode == 0


def test_recent_window(spark):
    profiles = spark.createDataFrame([(1, [], [], [], [], [], None, "any", True), (2, [], [], [], [], [], None, "any", False)], PROFILES)
    day = lambda n: datetime.datetime(2024, 2, n)
    rows = [(i, "t", [], "", "", "", "", False, False, None, None, "e") for i in range(4)]
    postings = spark.createDataFrame(rows, POSTINGS).join(spark.createDataFrame([(0, "open", day(20)), (1, "open", None), (2, "closed", day(20)), (3, "open", day(20))], "posting_id long, status string, scraped_at timestamp"), "posting_id")
    old = spark.createDataFrame([(u, p, 0.1, "below_threshold", []) for u in (1, 2) for p in range(4)], "user_id long, posting_id long, match_score double, match_status string, matched_tags array<string>")
    got = matching.rematch_profiles(old, postings, profiles, profiles.select("user_id"), now()).collect()
    assert {(r["user_id"], r["posting_id"]): r["match_score"] for r in got} == {(1, 0): 0.3, (1, 1): 0.1, (1, 3): 0.3}
    left = matching.match_postings(old, postings, profiles, postings.where("posting_id in (0, 2)").select("posting_id")).collect()
    assert {(r["user_id"], r["posting_id"]) for r in left} == {(1, 0), (1, 1), (2, 1), (1, 3), (2, 3)}
