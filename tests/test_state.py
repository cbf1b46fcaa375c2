"""State tables in buckets: what a round writes, two writers, a writer that dies, retention; and the stream over them."""

import os

import pytest
from pyspark.sql import functions as F

from test_operators import PROFILES, batch
from vacantry.sources import files, state
from vacantry.streaming import pipeline


def here():
    return F.pmod(F.col("id"), F.lit(4))


def rows(spark, path, **kw):
    return sorted(tuple(r) for r in state.read_snapshot(spark, path, **kw).collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    write = lambda df, v, touched=None: state.write_buckets(df, path, v, bucket=here(), n=4, touched=touched)
    table = lambda *r: spark.createDataFrame(list(r), "id long, x string")
    write(table(*[(i, "a") for i in range(8)]), 0)
    write(table((1, "b"), (9, "b")), 1, [1, 2])
    assert rows(spark, path) == [(0, "a"), (1, "b"), (3, "a"), (4, "a"), (7, "a"), (9, "b")]  # bucket 2 was emptied
    assert rows(spark, path, below=1) == [(i, "a") for i in range(8)] and rows(spark, path, only=[1]) == [(1, "b"), (9, "b")]
    said = [state.manifest(spark, path, v) for v in (0, 1)]
    assert {b for b in said[1]["folders"] if said[1]["folders"][b] != said[0]["folders"].get(b)} == {"1"} and said[1]["touched"] == [1, 2]
    with pytest.raises(FileExistsError):
        write(table((1, "c")), 1, [1])
    with pytest.raises(Exception, match="not touched"):
        write(table((2, "c")), 2, [1])
    assert state.versions(spark, path) == [0, 1] and len(rows(spark, path)) == 6
    write(table(), 2, [])
    assert len(rows(spark, path)) == 6
    write(table(), 3)
    assert rows(spark, path) == []
    with pytest.raises(ValueError):
        state.write_buckets(table(), path, 4, bucket=here(), n=8, touched=[1])
    # the last two versions stay and what they name; what the failed writers left goes
    assert state.expire(spark, path, keep=2) == [0, 1]
    assert rows(spark, path, below=3) == [(0, "a"), (1, "b"), (3, "a"), (4, "a"), (7, "a"), (9, "b")] and rows(spark, path) == []
    assert sorted(f[:2] for f in os.listdir(f"{path}/data")) == ["0-", "1-"]  # version 2 names them; 2 and 3 wrote no bucket, and the failed one goes


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    """Both find the version free and write; the one that commits first wins, and the other's rows are never read."""
    path, commit = str(tmp_path / "t"), state.commit

    def late(*args):
        monkeypatch.setattr(state, "commit", commit)
        state.write_buckets(spark.range(3), path, 0, bucket=here(), n=4)
        commit(*args)

    monkeypatch.setattr(state, "commit", late)
    with pytest.raises(FileExistsError):
        state.write_buckets(spark.range(8), path, 0, bucket=here(), n=4)
    assert rows(spark, path) == [(0,), (1,), (2,)]
    assert [f for f in os.listdir(f"{path}/v=0") if not f.startswith(".")] == ["_SUCCESS"]


def test_rounds_in_buckets_end_as_whole_ones(spark, tmp_path, monkeypatch):
    """The same rounds with states in buckets, also where a writer dies, give the rows of whole snapshots and leave other boards' files alone."""
    boards = [("lever", f"b{i}", f"acme{i}") for i in range(6)]
    sources = spark.createDataFrame(boards, "source_ats string, board_token string, employer string")
    profiles = spark.createDataFrame([(1, ["Python"], ["python"], [], [], [], None, "any", True)], PROFILES)
    first = batch(spark, ("0", "Python dev"), board="b0")
    for i in range(1, 6):
        first = first.unionByName(batch(spark, (str(i), "Python dev"), (f"{i}x", "Cook"), board=f"b{i}"))
    rounds = [first, batch(spark, ("1x", "Python cook"), board="b1"), batch(spark, ("2", "Cook"), ("1", "Python"), board="b2")]

    def dies(*args):
        monkeypatch.setattr(state, "commit", commit)
        raise RuntimeError("lost")

    commit, seen = state.commit, {}
    for how in ("whole", "buckets", "lost"):
        at = str(tmp_path / how)
        for n, b in enumerate(rounds):
            if how == "lost":
                monkeypatch.setattr(state, "commit", dies)
                with pytest.raises(RuntimeError):
                    pipeline.tick(spark, b, sources, profiles, at, n, buckets=64)
            pipeline.tick(spark, b, sources, profiles, at, n, buckets=None if how == "whole" else 64)
        tables = files.read_snapshot(spark, f"{at}/matches").drop("computed_at"), files.read_snapshot(spark, f"{at}/postings").drop("scraped_at", "rematch")
        seen[how] = [sorted(map(str, t.collect())) for t in tables]
    assert seen["whole"] == seen["buckets"] == seen["lost"] and len(seen["whole"][1]) == 11
    for table, most in (("postings", 8), ("matches", 2)):
        a, b = (state.manifest(spark, f"{tmp_path}/buckets/{table}", v)["folders"] for v in (0, 1))
        assert 0 < sum(a.get(k) != f for k, f in b.items()) <= most and sum(a.get(k) == f for k, f in b.items()) >= 4
