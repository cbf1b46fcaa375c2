"""What the findings of round 3 asked for, on small tables."""

import math
import random

from pyspark.sql import functions as F

from vacantry.functions import search as fts
from vacantry.operators import matching, retrieval, telemetry, textindex
from vacantry.plans import queries as plans

from test_operators import POSTINGS as POSTINGS_MATCHED
from test_operators import PROFILES, many_of_both

POSTINGS = "posting_id long, title string, description string, content_hash string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_shuffles_posting_lists_once(spark, tmp_path):
    """lists are made where the texts are read, and an entry's stamp is short; long and odd stamps still tell contents apart."""
    path = str(tmp_path / "i")
    stamps = ["a" * 64, "a" * 63 + "b", "", "#x", "two\nlines", "c d", None, "short"]
    rows = [(1 + i // 2, f"running word{i}", "data", s) for i, s in enumerate(stamps)]
    df = spark.createDataFrame(rows, POSTINGS)
    assert "Exchange" not in plan(textindex.blocks(df))
    textindex.add(df, path)
    got = textindex.read_terms(spark, path, ["run"]).collect()
    assert len(got) == 8 and len({(r["id"], r["stamp"]) for r in got}) == 8 and max(len(r["stamp"] or "") for r in got) <= 12
    for i, row in enumerate(rows):
        found = textindex.search(spark.createDataFrame([row], POSTINGS), path, f"run word{i}")
        other = textindex.search(spark.createDataFrame([row], POSTINGS), path, f"run word{i ^ 1}")
        assert (found.count(), other.count()) == (1, 0), row


def test_stemmed_search_reads_texts_once(spark):
    """rows are judged where they are read; words that begin otherwise than the terms cannot have their stems."""
    df = spark.createDataFrame([(1, "Skies over", "runs"), (2, "sky", "walk"), (3, None, "the running sky"), (None, "sky runs", ""), (4, "", None), (5, "éclairs", "run sky")], "posting_id long, title string, description string")
    got = fts.search(df, "sky run")
    assert "Exchange" not in plan(got) and sorted(r[0] for r in got.collect()) == [1, 3, 5]
    assert [r[0] for r in fts.search(df, "éclair").collect()] == [5]
    words = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(fts.tokens(F.col("text")))).distinct().collect()]
    assert all(fts.stem_word(w)[0] == w[0] for w in [*words, *fts._WHOLE, "yyed", "eed", "ied", "ing"])


def test_quantiles_are_exact(spark, monkeypatch):
    """F8: beyond what a sketch holds, with null names, null values, NaN and bounds that miss."""
    rng = random.Random(7)
    rows = [(rng.randrange(86400 * 2), round(rng.lognormvariate(3, 2), 2), rng.choice(["a", "b", None])) for _ in range(90_000)]
    rows += [(i, float("nan"), "c") for i in range(90)] + [(i, float(i), "c") for i in range(10)] + [(5, None, "d"), (6, None, "a")]
    df = spark.createDataFrame(rows, "s long, value double, name string").select(F.timestamp_seconds("s").alias("ts"), "value", "name").cache()
    days = telemetry.merge_states(telemetry.quantile_states(df, ["name"]), ["name"], win="1 day")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    groups = {}
    for s, x, name in rows:
        groups.setdefault((s // 86400, name), []).extend([] if x is None else [x])
    for slack in (telemetry.SLACK, -0.3):
        monkeypatch.setattr(telemetry, "SLACK", slack)
        got = telemetry.exact_quantiles(df, days, ["name"], shares).collect()
        assert len(got) == len(groups)
        for r in got:
            own = sorted(groups[int(r["at"].timestamp()) // 86400 - 1, r["name"]], key=lambda x: (math.isnan(x), x))
            assert r["n"] == len(own)
            for p, q in shares.items():
                want = own[max(1, -(-len(own) * int(q * 100) // 100)) - 1] if own else None
                assert r[p] == want or (math.isnan(r[p]) and math.isnan(want)), (r, p, want)


def test_upkeep_deals_no_matches(spark):
    """matches are held against the edited where they lie, whatever Spark guesses of the size of those."""
    matches = spark.range(10**7).select(F.col("id").alias("user_id"), F.col("id").alias("posting_id"), F.lit(0.5).alias("match_score"), F.lit("recommended").alias("match_status"), F.array(F.lit("a")).alias("matched_tags"))
    strings = lambda *names: [F.array().cast("array<string>").alias(n) for n in names]
    place = [F.lit(None).cast("string").alias(n) for n in ("location", "location_city", "location_region", "location_country")]
    postings = spark.range(4).select(F.col("id").alias("posting_id"), F.lit(True).alias("is_remote"), F.lit("t").alias("title"), *strings("classification_tags"), *place, F.lit(False).alias("location_resolved"), F.lit(1).alias("salary_min"), F.lit(2).alias("salary_max"), F.lit("e").alias("employer_slug"), F.lit("open").alias("status"), F.timestamp_seconds(F.col("id") * 0 + 10).alias("scraped_at"))
    target = "array<struct<raw:string,city:string,region:string,country:string,resolved:boolean>>"
    profiles = spark.range(4).select(F.col("id").alias("user_id"), F.lit("any").alias("remote_pref"), *strings("target_tags", "target_titles", "target_locations", "excluded_employers"), F.array().cast(target).alias("target_locations_normalized"), F.lit(None).cast("int").alias("min_salary"), (F.col("id") != 3).alias("is_active"))
    ids = spark.range(10**7).where("id % 5000000 = 2")
    now = F.timestamp_seconds(F.lit(100))
    one = matching.match_postings(matches, postings, profiles, ids.withColumnRenamed("id", "posting_id"))
    two = matching.rematch_profiles(matches, postings, profiles, ids.withColumnRenamed("id", "user_id"), now)
    for df in (one, two):
        assert "hashpartitioning(posting_id" not in plan(df) and "hashpartitioning(user_id" not in plan(df)
    assert one.groupBy((F.col("posting_id") == 2).alias("x")).count().orderBy("x").collect() == [(False, 10**7 - 2), (True, 3)]
    assert two.groupBy((F.col("user_id") == 2).alias("x")).count().orderBy("x").collect() == [(False, 10**7 - 2), (True, 4)]


def test_page_makes_no_pair_that_cannot_be_on_it(spark, monkeypatch):
    """the page is what all pairs give, without making them, also where the best ones were dismissed."""
    d = "/root/testdata/sf0.001"
    postings, profiles = (x.cache() for x in plans._sides(spark, d))
    every = matching.scored(postings, profiles).cache()
    log = every.where("posting_id % 3 <> 0").select("user_id", "posting_id", F.lit(1).alias("seq"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.when(F.col("posting_id") % 5 == 0, "save").otherwise("dismiss").alias("action")).cache()
    names = ["user_id", "posting_id", "match_score", "action", "rank", "page"]
    want = retrieval.page(retrieval.recommend(every, retrieval.apply_actions(log)), 2).select(names).collect()
    monkeypatch.setattr(plans, "_sides", lambda *_: (postings, profiles))
    monkeypatch.setattr(plans.v, "view", lambda *_: log)
    monkeypatch.setattr(matching, "scored", None)
    assert want and sorted(plans.q_page(spark, d).collect()) == sorted(want)


def test_candidates_deal_only_what_the_gates_read(spark, monkeypatch):
    """of a posting no text or place is dealt, and profiles that differ in titles and places alone are held in one list."""
    profiles = spark.createDataFrame([(i, [f"t{i}"], [["a"], ["b", "a"], []][i % 3], [f"p{i}"], [], [], None, ["any", "remote_only"][i % 2], True) for i in range(60)], PROFILES)
    postings = spark.createDataFrame([(i, f"Job {i}", ["a"], f"p{i}", "", "", "", False, i % 2 == 0, None, None, "e") for i in range(40)], POSTINGS_MATCHED)
    seen, pairs = [], matching._pairs
    monkeypatch.setattr(matching, "_pairs", lambda met: seen.append(met) or pairs(met))
    got = {(r["user_id"], r["posting_id"]) for r in matching.candidates(postings, profiles).collect()}
    tagged = {(r["user_id"], r["posting_id"]) for r in matching.candidates_by_tag(postings, profiles).collect()}
    assert got == tagged == {(u, j) for u in range(60) for j in range(40) if u % 2 == 0 or j % 2 == 0}
    assert set(seen[0].columns) == {"posting_id", "remote", "ceiling", "employer_slug", "remote_pref", "members"}
    assert set(seen[1].columns) == {*seen[0].columns, "tags", "wanted"}
    assert seen[0].count() == 40 + 20 and seen[1].count() == 3 * 40 + 3 * 20


def test_equal_users_ask_once_and_postings_are_read_once(spark):
    """five times the users who ask for the same make no further pair; postings are worked out once for all that is asked of them."""
    profiles, postings = many_of_both(spark, 30, 300)
    copies = profiles.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("user_id", F.col("user_id") + 1000 * F.col("copy"))
    copies = copies.withColumn("excluded_employers", F.when(F.col("copy") == 1, F.concat("excluded_employers", "excluded_employers")).otherwise(F.col("excluded_employers"))).drop("copy")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def title(text):
        read.add(1)
        return text

    one, five = [], []
    want = matching.top_matches(postings, profiles, 5, counted=one).collect()
    got = matching.top_matches(postings.withColumn("title", title("title")), copies, 5, counted=five).collect()
    assert one == five and want and read.value == 300
    assert sorted(got) == sorted((r["user_id"] + 1000 * k, *r[1:]) for r in want for k in range(5))


def test_cards_join_only_the_best(spark, monkeypatch):
    """of all postings only those are joined with the matches that are among anybody's best."""
    d = "/root/testdata/sf0.001"
    top = spark.createDataFrame([(u, p, 0.5, "recommended", ["a", "b"], 1) for u in range(50) for p in (3, 7, 12)], "user_id long, posting_id long, match_score double, match_status string, matched_tags array<string>, rank int")
    seen, joined = [], matching.joined_matches
    monkeypatch.setattr(plans, "_sides", lambda *_: (plans.v.view(spark, d, "postings"), None))
    monkeypatch.setattr(matching, "top_matches", lambda *_, **__: top)
    monkeypatch.setattr(matching, "joined_matches", lambda m, p, e: seen.append((p, e)) or joined(m, p, e))
    got = plans.q_cards(spark, d).collect()
    every = {r["posting_id"]: r for r in plans.v.view(spark, d, "postings").collect()}
    place = lambda r: "Remote" if r["is_remote"] else r["location"]
    assert sorted(got) == sorted((u, p, every[p]["title"], every[p]["source_url"], every[p]["employer"].upper(), place(every[p]), "0.50", "a, b") for u in range(50) for p in (3, 7, 12))
    assert seen[0][0].count() == 3 and seen[0][1].count() <= 3


def test_scores_are_worked_out_for_lists_of_both_sides(spark, monkeypatch):
    """five times the postings and users of the same kinds and wishes make 25 times the pairs, of which nothing but gates and pay is worked out one by one."""
    profiles, postings = many_of_both(spark, 30, 120)
    again = lambda df, key: df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn(key, F.col(key) + 1000 * F.col("copy")).drop("copy")
    few = matching.scored(postings, profiles).collect()
    made, met = [], matching._met
    monkeypatch.setattr(matching, "_met", lambda *a: made.append(met(*a)) or made[-1])
    matching.scored(postings, profiles)
    got = matching.scored(again(postings, "posting_id"), again(profiles, "user_id"), tags=lambda m: F.array_join(m, "|")).collect()
    want = [(r["user_id"] + 1000 * i, r["posting_id"] + 1000 * k, r["match_score"], r["match_status"], "|".join(r["matched_tags"])) for r in few for i in range(5) for k in range(5)]
    assert few and sorted(got) == sorted(want)
    assert made[0].count() == made[1].count() < len(got) / 10 and any(r["matched_tags"] for r in few)


def test_lists_of_equal_postings_are_bounded(spark):
    """a kind that all postings are of, and a wish that all users have, are dealt into parts; no pair is lost or made twice."""
    profiles, postings = many_of_both(spark, 1, 1)
    users = profiles.withColumn("is_active", F.lit(True)).withColumn("remote_pref", F.lit("any")).withColumn("excluded_employers", F.array(F.lit("none"))).withColumn("min_salary", F.lit(100)).withColumn("user_id", F.explode(F.sequence(F.lit(0), F.lit(299))))
    jobs = postings.withColumn("salary_max", F.lit(900)).withColumn("posting_id", F.explode(F.sequence(F.lit(0), F.lit(999)))).withColumn("salary_min", F.when(F.col("posting_id") % 3 > 0, F.col("posting_id").cast("int")))
    lists = matching._together(matching.posting_side(jobs), matching.KIND, ("posting_id",), "rows").select(F.size("rows")).collect()
    assert sum(n for (n,) in lists) == 1000 and max(n for (n,) in lists) < 2 * matching.TOGETHER
    rows = matching.scored(jobs, users).groupBy("posting_id").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"), F.countDistinct("match_score").alias("scores"), F.min("match_score").alias("s")).collect()
    assert len(rows) == 1000 and all((r["users"], r["n"], r["scores"]) == (300, 300, 1) for r in rows)
    scores = {r["posting_id"]: r["s"] for r in rows}
    assert round(scores[100] - scores[99], 6) == 0.05 and round(scores[99] - scores[98], 6) == 0.05
