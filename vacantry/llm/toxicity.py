"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Hashes, bucket, pairs, split_words


@dataclass(frozen=True)
class Config:
    bits: int = 20  # 2**bits weights
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.1
    epochs: int = 6
    rows: int = 16_000  # bound of the labelled rows learnt from
    seed: int = 42


def features(words: list[bytes], known: Hashes, bits: int) -> np.ndarray:
    """Buckets of a text's words, pairs of neighbours and pairs with one word between, repeats included."""
    h = known.of(words)
    spread = h * np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate([bucket(spread, bits), bucket(pairs(h[:-1], h[1:], 1), bits), bucket(pairs(h[:-2], h[2:], 2), bits)])


def train(rows: Iterable[tuple[int, str]], config: Config) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) from (label, text) rows; a text's features count once each.

    Every coordinate has its own rate, from the sum of its squared gradients, and its weight is zero unless its
    accumulated gradient exceeds l1. The bias is a coordinate without penalty. The rows come in the order of a
    hash; texts are read one by one, whole, and only their features are held.
    """
    known, data = Hashes(), []
    for y, text in rows:
        data.append((np.unique(features(split_words(text), known, config.bits)).astype(np.int32), y))
    z, n = np.zeros(1 << config.bits), np.zeros(1 << config.bits)
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(config.seed)

    def weights(z, n):
        return np.where(np.abs(z) <= config.l1, 0.0, (np.sign(z) * config.l1 - z) / ((config.beta + np.sqrt(n)) / config.alpha + config.l2))

    def bias():
        return -bias_z * config.alpha / (config.beta + np.sqrt(bias_n))

    for _ in range(config.epochs):
        for k in rng.permutation(len(data)):
            at, y = data[k]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            b = bias()
            g = _sigmoid(w.sum() + b) - y
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / config.alpha
            z[at] = zi + g - step * w
            n[at] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / config.alpha * b
            bias_n += g * g
    w = weights(z, n)
    on = np.flatnonzero(w)
    return on, w[on], float(bias())


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", config: Config = Config()) -> dict:  # noqa: B008
    """Learn from at most config.rows labelled documents, the first by a hash of their ids.

    Labels that are null or not 0 or 1 are left out, a repeated id counts once (a 1 before a 0, its smallest text),
    and labels without a document do not matter. The ids chosen are broadcast, config.rows at most, so no text is
    shuffled but the sample's, which one task learns from; the driver receives the weights that are not zero. No label, or an empty table, gives weights of zero.
    """
    spark = docs.sparkSession
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    chosen = chosen.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(config.rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    rows = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__y").agg(F.min("__t").alias("__t")).select(F.xxhash64("__id").alias("o"), "__y", "__t")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = train((r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), config)
        yield pa.RecordBatch.from_pydict({"at": [at.astype(np.int64).tobytes()], "w": [w.tobytes()], "bias": [bias]})

    found = rows.repartition(1).sortWithinPartitions("o", "__y", "__t").select("__y", "__t").mapInArrow(learn, "at binary, w binary, bias double").collect()
    weights = np.zeros(1 << config.bits, np.float32)
    if not found:
        return {"w": weights, "bias": 0.0}
    weights[np.frombuffer(found[0]["at"], np.int64)] = np.frombuffer(found[0]["w"], np.float64)
    return {"w": weights, "bias": found[0]["bias"]}


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:  # noqa: B008
    """(id, score, predicted) of each row from its whole text; null and empty texts get the score of the bias alone.

    Ids are passed through, nulls and repeats too; extra columns are ignored.
    """
    at = np.flatnonzero(model["w"])
    sparse = docs.sparkSession.sparkContext.broadcast((at, model["w"][at], model["bias"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sparse.value
        weights = np.zeros(1 << config.bits)
        weights[at] = w
        known = Hashes()
        for b in batches:
            out = []
            for t in b.column(1):
                f = features(split_words(t.as_py()), known, config.bits)
                hit = np.unique(f[weights[f] != 0])
                out.append(_sigmoid(weights[hit].sum() + bias))
            s = np.array(out, np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
