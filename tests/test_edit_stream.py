"""Saves of profiles as a stream: debounce by the clock, refreshed matches, restart, and state that goes."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from test_operators import POSTINGS, PROFILES, look, now  # noqa: F401
from vacantry.sources import state
from vacantry.streaming import pipeline

MATCHES = "user_id long, posting_id long, match_score double, match_status string, matched_tags array<string>, computed_at timestamp"


def until(done, query, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        assert query.exception() is None
        if done():
            return
        time.sleep(0.5)
    raise AssertionError("nothing came in time")


def test_saves_stream_to_refreshed_matches(spark, look, tmp_path, monkeypatch):  # noqa: F811
    users = range(1, 5)
    profiles = spark.createDataFrame([(u, [], ["x"], [], [], [], None, "any", True) for u in users], PROFILES)
    rows = [(i, "Python dev", ["python"], "", "", "", "", False, False, None, None, "e") for i in range(2)]
    postings = spark.createDataFrame(rows, POSTINGS).withColumns({"status": F.lit("open"), "scraped_at": now()})
    matches = spark.createDataFrame([(u, p, 0.1, "below_threshold", [], datetime.datetime(2024, 1, 1)) for u in users for p in (0, 1)], MATCHES)
    save = lambda u, s, title, tags: {"user_id": u, "ts": f"2024-02-01T00:00:{s:02}", "seq": s, "target_titles": title, "target_tags": tags, "target_locations": "", "excluded_employers": "", "remote_pref": "any", "is_active": True}
    first = [save(1, 3, " Python, ", "python,sql"), save(1, 0, "a", "cook"), save(None, 1, "a", "cook")]
    later = [save(2, 9, "Python", "python")]
    src, at = tmp_path / "in", str(tmp_path / "state")
    src.mkdir()
    land = lambda name, saves: (src / name).write_text("".join(json.dumps(s) + "\n" for s in saves))
    start = lambda: pipeline.run_edit_stream(spark, str(src), at, profiles, postings, matches, look, wait=2, now=now())
    done = lambda n: len(state.versions(spark, f"{at}/matches")) >= n

    write = pipeline.write_snapshot

    def dies(df, path, version):
        if path.endswith("matches"):
            raise RuntimeError("lost")
        write(df, path, version)

    land("1.json", first)
    monkeypatch.setattr(pipeline, "write_snapshot", dies)
    query = start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination(120)
    assert state.versions(spark, f"{at}/profiles") and not done(1)
    monkeypatch.setattr(pipeline, "write_snapshot", write)
    query = start()
    until(lambda: done(1), query)
    once = state.read_snapshot(spark, f"{at}/profiles").collect()
    assert {r["user_id"]: r["target_titles"] for r in once} == {1: ["Python"], 2: [], 3: [], 4: []}
    got = {(r["user_id"], r["posting_id"]): (r["match_score"], r["computed_at"].month) for r in state.read_snapshot(spark, f"{at}/matches").collect()}
    assert got == {(u, p): (0.75, 3) if u == 1 else (0.1, 1) for u in users for p in (0, 1)}
    land("2.json", later)
    until(lambda: done(2), query)
    until(lambda: query.lastProgress and query.lastProgress["stateOperators"] and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0, query)
    query.stop()
    query.awaitTermination(30)

    edits = spark.read.schema(pipeline.EDITS).json(str(src))
    new, want = pipeline.apply_edits(edits, profiles, postings, matches, look, now())
    plain = lambda df: sorted(str(r) for r in df.collect())
    assert plain(state.read_snapshot(spark, f"{at}/profiles").select(*new.columns)) == plain(new)
    assert plain(state.read_snapshot(spark, f"{at}/matches").select(*want.columns)) == plain(want)
