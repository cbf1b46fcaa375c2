"""The pipeline's stages: what each keeps, by brute force on small tables."""

import collections
import zlib

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from vacantry.llm import exact, langid, queries, simhash

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        before, after = docs.collect(), out.collect()
        if name == "language":
            judged = langid.predict(docs, queries.language_model(docs)).collect()
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in judged if not r["rejected"]}
        elif name == "exact dedup":
            first = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                first.setdefault(_norm(r["text"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted(first.values())
        elif name == "near dedup":
            groups = simhash.near_groups(docs).collect()
            assert sorted(r["doc_id"] for r in after) == sorted({r["component_id"] for r in groups})
        elif name == "mixing":
            con = duckdb.connect()
            con.register("documents", docs.toPandas())
            want = con.execute(queries.MIX_SQL).df()
            assert sorted((r["doc_id"], r["text"]) for r in after) == sorted(zip(want["doc_id"], want["text"], strict=True))
        else:
            n = collections.Counter((r["doc_id"], r["sample"]) for r in after)
            copies = collections.Counter(r["doc_id"] for r in before)
            assert all(n[(d, 0)] == c for d, c in copies.items())
            crc = {r["doc_id"]: zlib.crc32((r["text"] or "").encode()) for r in before}
            assert all(r["decoded_crc32"] == crc[r["doc_id"]] for r in after)
            drawn = collections.Counter((r["doc_id"], tuple(r["pieces"])) for r in after)
            again = [d for d, c in copies.items() if c > 1]
            assert not again or any(drawn[x] == 1 for x in drawn if x[0] in again)  # copies draw for themselves
        seen.append((name, len(after)))
        docs = out
    assert [n for n, _ in seen] == ["language", "exact dedup", "near dedup", "mixing", "pieces"]


def _norm(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    none = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_odd_rows_go_through(spark):
    rows = [(1, "Alpha beta gamma.", "en", "src1", 5), (2, None, None, None, None), (None, "Das ist ein Text", "de", None, 1), (1, "Alpha beta gamma.", "en", "src1", 5), (3, "", "en", "src2", 0)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert set(out.columns) == set(docs.columns)
        out.collect()
    assert exact.drop_exact_copies(docs).count() == 3
    drawn = corpus_pipeline.encode_pieces(spark, docs.withColumn("row", F.lit("x")), DATA).collect()
    of = lambda d: [(r["pieces"], r["decoded_crc32"]) for r in drawn if r["doc_id"] == d]
    assert len(of(1)) >= 12 and {c for _, c in of(1)} == {zlib.crc32(b"Alpha beta gamma.")} and len({tuple(p) for p, _ in of(1)}) > 2
    assert {(p, c) for p, c in of(2)} == {(None, None)} and {(tuple(p or ()), c) for p, c in of(3)} == {((), 0)}
