"""The stored inverted index, quantile and coverage sketches, and remembered places, against plain forms of each."""

import os
import random

import pytest
from pyspark.sql import functions as F

from test_places import inputs
from vacantry.functions import search as fts
from vacantry.operators import gazetteer, location, telemetry, textindex, upsert
from vacantry.sources import state

POSTINGS = "posting_id long, title string, description string, content_hash string, extra string"


def found(df, **kw):
    return sorted(r["posting_id"] for r in df.select("posting_id").collect())


def test_index_gives_what_a_scan_gives(spark, tmp_path):
    path, rng = str(tmp_path / "i"), random.Random(1)
    words = "run running runner data engineer engineering the of backend café naïve 3d x".split()
    say = lambda: " ".join(rng.choices(words, k=rng.randrange(0, 8)))
    one = [(i, say(), say() if i % 9 else None, f"a{i}", "e") for i in range(60)] + [(None, "running data", "x", "n", "e"), (7, "twice", "twice", "a7", "e")]
    two = [(i, say(), say(), f"b{i}", "e") for i in range(0, 80, 3)]
    one = [r for r in one if r[3] != "a7" or r[1] == "twice"]
    table = lambda rows: spark.createDataFrame(rows, POSTINGS)
    assert textindex.add(table(one), path) == 0 and textindex.add(table(two), path) == 1 and textindex.add(table([]), path) == 2
    replaced = {r[0] for r in two}
    now = table([r for r in one if r[0] not in replaced] + two).cache()

    def alike():
        for query in ("running", "run data", "Engineers of the data", "the of", "", "café", "naïve 3d", "nowhere", "run runner running"):
            for stemmed in (True, False):
                assert found(textindex.search(now, path, query, stemmed=stemmed)) == found(fts.search(now, query, stemmed=stemmed)), (query, stemmed)

    alike()
    files = textindex.read_terms(spark, path, ["engin"]).inputFiles()
    assert files and {f.split("/")[-2] for f in files} == {f"bucket={textindex.zlib.crc32(b'engin') % textindex.BUCKETS}"}
    assert textindex.merge(now, path) is None and textindex.merge(now, path, most=1) == 3
    assert len(state.manifest(spark, path, 3)["segments"]) == 1
    stale = textindex.read_terms(spark, path, ["run", "data", "engin"]).where("stamp like 'a%'").select("id").distinct()
    assert not replaced & {r["id"] for r in stale.collect()}
    alike()


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], POSTINGS)
    path = str(tmp_path / "i")
    assert found(textindex.search(empty, path, "data")) == []  # no index yet
    textindex.add(empty, path)
    assert found(textindex.search(empty, path, "data")) == [] and textindex.merge(empty, path, most=0) == 1


def test_index_stemmed_over_whole_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    p = docs.select(F.col("doc_id").alias("posting_id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("description"), F.sha2("text", 256).alias("content_hash")).cache()
    path = str(tmp_path / "i")
    textindex.add(p, path)
    rows = p.collect()
    for query in ("ering eaing", "tion", "die tions"):
        stems = {fts.stem_word(w) for w in query.split()}
        plain = []
        for r in rows:
            said = "".join(ch if ch.isalpha() or ch.isnumeric() else " " for ch in f"{r.title}\n{r.description}".lower()).split()
            if stems <= {fts.stem_word(w) for w in said if w not in fts.STOP_WORDS}:
                plain.append(r.posting_id)
        assert found(textindex.search(p, path, query)) == sorted(plain) == found(fts.search(p, query))


def test_sketches_merge_to_quantiles(spark):
    rng = random.Random(3)
    values = [rng.lognormvariate(0, 2) for _ in range(60_000)]
    df = spark.createDataFrame([(i % 86400, v) for i, v in enumerate(values)], "s long, value double").select((F.timestamp_seconds("s")).alias("ts"), "value", F.lit("a").alias("name"))
    states = telemetry.quantile_states(df, ["name"])
    hours = telemetry.merge_states(states, ["name"])
    day = telemetry.quantiles(telemetry.merge_states(hours, ["name"], win="1 day"), ["name"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()
    assert len(day) == 1 and day[0]["n"] == len(values)
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert abs(sum(v <= day[0][name] for v in values) / len(values) - q) < 0.002
    assert states.select(F.max(F.length("sketch"))).first()[0] < 16 * telemetry.SKETCH  # bounded, whatever the number of values
    few = telemetry.quantiles(telemetry.quantile_states(spark.createDataFrame([(0, 3.0, "b"), (1, 1.0, "b"), (2, None, "b"), (3, 2.0, "b"), (4, None, "c")], "s long, value double, name string").withColumn("ts", F.timestamp_seconds("s")), ["name"]), ["name"], {"p50": 0.5}).collect()
    assert sorted((r["name"], r["n"], r["p50"]) for r in few) == [("b", 3, 2.0), ("c", 0, None)]
    assert telemetry.quantiles(telemetry.merge_states(states.limit(0), ["name"]), ["name"], {"p50": 0.5}).count() == 0


def test_coverage_of_rounds_merges(spark, tmp_path):
    rng = random.Random(5)
    rows = [(r, f"place {min(int(rng.paretovariate(0.7)), 30_000)}" if rng.random() < 0.9 else None, rng.random() < 0.3) for r in range(4) for _ in range(15_000)] + [(9, "x", True)]
    df = spark.createDataFrame(rows, "round int, location string, location_resolved boolean")
    path = str(tmp_path / "c")
    for r in (0, 1, 2, 3, 9):
        upsert.coverage_states(df.where(F.col("round") == r), "round").write.mode("append").parquet(path)
    got = upsert.coverage_over(spark.read.parquet(path), n=10).first()
    rates, top = upsert.coverage(df, 10)
    rates, top = rates.first(), [(t["location"], t["n"]) for t in top.collect()]
    assert (got["total"], got["resolved"]) == (rates["total"], rates["resolved"]) and got["rate"] == pytest.approx(rates["rate"])
    assert abs(got["distinct_unresolved"] / rates["distinct_unresolved"] - 1) < 0.03
    count = {t["location"]: t["n"] for t in upsert.coverage(df, 10**6)[1].collect()}
    assert len(got["top"]) == 10 and all(abs(t["n"] - count[t["location"]]) <= got["most_off"] for t in got["top"])
    assert [t["location"] for t in got["top"]][:5] == [t[0] for t in top[:5]]
    each = {r["round"]: r for r in upsert.coverage_over(spark.read.parquet(path), "round").collect()}
    assert sorted(each) == [0, 1, 2, 3, 9] and (each[9]["distinct_unresolved"], each[9]["top"], each[9]["rate"]) == (0, [], 1.0)


def test_places_are_remembered(spark, tmp_path, monkeypatch):
    gaz, path = gazetteer.prepared(gazetteer.build_gazetteer(*inputs(spark))), str(tmp_path / "m")
    table = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, location string")
    names = ["id", "location_city", "location_region", "location_country", "location_resolved", "location_alias_version"]
    rows = lambda df: sorted(df.select(names).collect())
    one = table("Berlin, Germany", None, "", "Remote", "Nowhere", "Berlin, Germany")
    asked = []
    real = location.resolve_distinct
    monkeypatch.setattr(location, "resolve_distinct", lambda d, g: asked.append(sorted(r[0] for r in d.collect())) or real(d, g))
    assert rows(location.resolve_remembered(one, gaz, path)) == rows(location.resolve_locations(one, gaz))
    del asked[:]
    assert rows(location.resolve_remembered(one, None, path)) == rows(location.resolve_remembered(one.limit(99), {}, path))
    assert asked == [] and state.versions(spark, path) == [0]  # nothing new: no lookup, no version
    two = table("Remote", "Munich, Germany", "Nowhere")
    got = location.resolve_remembered(two, gaz, path)
    assert asked == [["Munich, Germany"]] and len(state.manifest(spark, path, 1)["touched"]) == 1
    assert rows(got) == rows(location.resolve_locations(two, gaz))
    del asked[:]
    assert {r[-1] for r in rows(location.resolve_remembered(one, gaz, path, version="v4"))} == {"v4"}
    assert asked == [["", "Berlin, Germany", "Nowhere", "Remote"]]  # another version knows nothing yet
    assert rows(location.resolve_remembered(table(), gaz, str(tmp_path / "e"))) == []
    assert not os.path.exists(tmp_path / "e")
