"""What the findings of round 4 asked for, on small tables."""

from pyspark.sql import functions as F

from vacantry.llm import exact
from vacantry.operators import location, matching

from test_findings_r03 import plan
from test_operators import many_of_both


def copies(spark, n, texts):
    """n rows in one partition, numbered from 1, of so many different texts; more rows than an Arrow batch's 10,000 come in several."""
    return spark.range(n, numPartitions=1).select((F.col("id") + 1).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % texts).cast("string")).alias("text"))


def test_exact_copies_are_dropped_over_several_batches(spark):
    """the batches of a run have one schema, whatever was merged before; what a batch ends with is merged with the next."""
    assert sorted(r["doc_id"] for r in exact.drop_exact_copies(copies(spark, 25000, 9000)).collect()) == list(range(1, 9001))


def test_exact_groups_over_several_batches(spark):
    """as F1, for the groups of all rows."""
    got = exact.exact_groups(copies(spark, 25000, 9000)).collect()
    assert len(got) == 25000
    for r in got:
        first = (r["doc_id"] - 1) % 9000 + 1
        assert (r["keep_id"], r["group_size"], r["kept"]) == (first, 3 if first <= 7000 else 2, r["doc_id"] == first)


def test_users_are_joined_with_their_lists_without_a_broadcast(spark, monkeypatch):
    """F8: users repeat what few ask for, so their Parquet files are small and their rows in memory are not; their join with the askers is by shuffle."""
    profiles, _ = many_of_both(spark, 30, 1)
    people = matching.profile_side(profiles)
    wishes = people.select(*matching.WISHES).distinct().withColumn("wish", F.monotonically_increasing_id()).localCheckpoint()
    plans, stored = [], matching.stored
    monkeypatch.setattr(matching, "stored", lambda df: plans.append(plan(df)) or stored(df))
    monkeypatch.setattr(matching, "profile_side", lambda df: people)
    users, once = matching.askers(people, wishes, 5)
    joins = [line for p in [*plans, plan(users)] for line in p.splitlines() if "Join" in line and "__wish" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert users.count() == 30 == users.select("user_id").distinct().count() and users.join(once, "asker").count() == 30


def test_profiles_are_worked_out_once(spark, monkeypatch):
    """wishes and askers are read from one table of what scores need of the profiles."""
    profiles, postings = many_of_both(spark, 6, 20)
    read, side = spark.sparkContext.accumulator(0), matching.profile_side

    @F.udf("string")
    def wish(text):
        read.add(1)
        return text

    monkeypatch.setattr(matching, "profile_side", lambda df: side(df.withColumn("remote_pref", wish("remote_pref"))))
    got = matching.top_matches(postings, profiles, 5).collect()
    assert got and read.value == profiles.where("is_active").count()


def test_targets_are_normalised_once_for_each_list(spark, monkeypatch):
    """a list that many profiles have is worked out once; null and empty lists, null targets and repeated ones count as before."""
    lists = [["Springfield", None, "Remote", "Springfield"], [], None, [None], ["Nowhere", "Nowhere"], ["Remote", "Springfield"]]
    place = F.struct(F.when(F.col("raw") == "Springfield", F.col("raw")).alias("city"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("country"), (F.col("raw") != "Nowhere").alias("resolved"))
    asked = []
    monkeypatch.setattr(location, "resolve_distinct", lambda df, gaz: asked.append(df) or df.withColumn("place", place))
    rows = [(i, lists[i % 6]) for i in range(600)]
    profiles = spark.createDataFrame(rows, "user_id long, target_locations array<string>")
    got = {r["user_id"]: [(t["raw"], t["city"], t["resolved"]) for t in r["target_locations_normalized"]] for r in location.normalize_targets(profiles, {}).collect()}
    spring, remote, gone, none = ("Springfield", "Springfield", True), ("Remote", None, True), ("Nowhere", None, False), (None, None, False)
    want = [[spring, none, remote], [], [], [none], [gone, gone], [remote, spring]]
    assert got == {i: want[i % 6] for i in range(600)}
    assert location.with_targets(profiles, {}).columns == [*profiles.columns, "target_locations_normalized"] and asked[0].count() == 3
