"""Language identification by averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed
from .words import split_words

UNDETERMINED = "und"
#: The sampling rates of at most so many languages are broadcast.
BROADCAST_LABELS = 1 << 16


def has_letter(text: str | None) -> bool:
    """Whether any character is of a letter category; digits, fractions and numerals in circles are none."""
    return any(map(str.isalpha, text or ""))


@dataclass(frozen=True)
class Config:
    bits: int = 15  # 2**bits embeddings
    dim: int = 16
    longest: int = 3  # subwords are the characters' 1- to 3-grams of a word between < and >, and the word
    epochs: int = 6
    rate: float = 0.5
    per_language: int = 1500  # bound of the labelled rows learnt from for each language
    rows: int = 300_000  # bound of all of them: with very many languages each has fewer, one at least
    held: float = 0.2  # of those rows, for calibration
    lost: float = 0.001  # of the calibration rows that may score below the threshold
    highest: float = 0.4  # of the threshold: a text half in each of two languages stays
    seed: int = 42


class _Buckets(dict):
    """subword -> its embedding; remembers at most `limit` subwords."""

    def __init__(self, bits: int, limit: int = 1 << 16):
        super().__init__()
        self.shift, self.limit = 64 - bits, limit

    def __missing__(self, gram: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[gram] = h = xxhash.xxh64_intdigest(gram) >> self.shift
        return h


@functools.lru_cache(maxsize=4)
def _buckets(bits: int) -> _Buckets:
    return _Buckets(bits)


def subwords(word: bytes, config: Config) -> np.ndarray:
    """The embeddings that make up a word."""
    said = f"<{word.decode('utf-8', 'replace')}>"
    known = _buckets(config.bits)
    grams = [known[said[i : i + n]] for n in range(1, config.longest + 1) for i in range(len(said) - n + 1)]
    grams.append(xxhash.xxh64_intdigest("=" + said) >> known.shift)
    return np.array(grams, np.int64)


def _vector(words: list[bytes], known: dict, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """The embeddings of a text and how often it has each, in few bytes, as a task holds those of all its texts."""
    parts = []
    for w in words:
        if w not in known:
            if len(known) > 1 << 16:
                known.clear()
            known[w] = subwords(w, config).astype(np.uint16 if config.bits <= 16 else np.uint32)
        parts.append(known[w])
    at, n = np.unique(np.concatenate(parts), return_counts=True)
    return at, n.astype(np.uint16 if n.max() < 1 << 16 else np.uint32)


def train(rows: Iterable[tuple[str, str]], config: Config) -> dict:
    """Stochastic gradient descent over (label, text) rows; each text is learnt whole and by a short window of it.

    The rows come in the order of a hash; texts are read one by one, whole, and only their features are held. A text
    without words teaches nothing; if there is no other, the model knows no language.
    """
    rng = np.random.default_rng(config.seed)
    known, learn, held = {}, [], []
    for label, text in rows:
        if not (words := split_words(text, digits=False)):
            continue
        at = int(rng.integers(len(words)))
        short = words[at : at + int(rng.integers(1, 21))]
        (held if rng.random() < config.held else learn).extend((_vector(w, known, config), label) for w in (words, short))
    names = sorted({label for _, label in learn + held})
    if not names:
        return {"names": [], "m": np.zeros((1 << config.bits, 0), np.float32), "b": np.zeros(0), "threshold": 0.0}
    number = {label: k for k, label in enumerate(names)}
    learn, held = ([(x, number[label]) for x, label in part] for part in (learn, held))
    e = rng.normal(0, 0.1, (1 << config.bits, config.dim))
    w, b = np.zeros((config.dim, len(names))), np.zeros(len(names))
    steps, done = max(1, config.epochs * len(learn)), 0
    for _ in range(config.epochs):
        for k in rng.permutation(len(learn)):
            (at, n), y = learn[k]
            at, x = at.astype(np.intp), n / n.sum()
            rate = config.rate * (1 - done / steps)
            done += 1
            h = x @ e[at]
            g = _softmax(h @ w + b)
            g[y] -= 1
            back = w @ g
            w -= rate * np.outer(h, g)
            b -= rate * 0.1 * g
            e[at] -= rate * 10 * x[:, None] * back
    logits = np.array([n / n.sum() @ e[at] @ w + b for (at, n), _ in held or learn]).reshape(-1, len(names))
    truth = np.array([y for _, y in held or learn], int)
    heat, threshold = _calibrate(logits, truth, config)
    return {"names": names, "m": ((e @ w) / heat).astype(np.float32), "b": b / heat, "threshold": threshold}


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _calibrate(logits: np.ndarray, truth: np.ndarray, config: Config) -> tuple[float, float]:
    """The temperature of least loss, and the score that `lost` of the rows stay below, at most `highest`."""
    if not len(truth):
        return 1.0, 0.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    heat = min(np.geomspace(0.1, 10, 81), key=loss)
    return float(heat), float(min(config.highest, np.quantile(_softmax(logits / heat).max(axis=1), config.lost)))


def fit(docs: DataFrame, *, label_col: str = "lang", text_col: str = "text", order: Column, config: Config = Config()) -> dict:  # noqa: B008
    """Learn from a bounded sample of the labelled rows of `docs`: at most config.per_language of each label, config.rows of all.

    The sample are the rows with the smallest hashes of `order` and the text, equal rows once: so rows whose `order` is
    null or repeated are sampled like others. Of all rows only those below a threshold are shuffled, which each
    label's number of distinct rows gives. One task learns from the sample, in the order of the hash. Rows with a null
    label or text are left out, and texts without words teach nothing. Without rows, as of an empty table, or
    without words the model knows no language and predicts `und`.
    """
    labelled = docs.select(F.col(label_col).cast("string").alias("label"), F.xxhash64(order, F.col(text_col).cast("string")).alias("o"), F.col(text_col).cast("string").alias("t"))
    labelled = labelled.where("label is not null and t is not null")
    sizes = checkpointed(labelled.groupBy("label").agg(F.approx_count_distinct("o").alias("n")))
    labels = sizes.count()
    most = max(1, min(config.per_language, config.rows // max(1, labels)))
    shares = sizes.select("label", F.least(F.lit(1.0), F.lit(1.25 * most + 20) / F.greatest("n", F.lit(1))).alias("share"))
    near = labelled.join(F.broadcast(shares) if labels <= BROADCAST_LABELS else shares, "label")
    near = near.where(F.shiftrightunsigned("o", 1) < F.col("share") * F.lit(2.0**63)).groupBy("label", "o").agg(F.min("t").alias("t"))
    some = near.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("o"))).where(F.col("k") <= most).drop("k")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = train((r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), config)
        yield pa.RecordBatch.from_pydict(
            {
                "names": pa.array([m["names"]], pa.list_(pa.string())),
                "m": [m["m"].tobytes()],
                "b": pa.array([m["b"].tolist()], pa.list_(pa.float64())),
                "threshold": [m["threshold"]],
            }
        )

    found = some.repartition(1).sortWithinPartitions("o", "label", "t").select("label", "t").mapInArrow(learn, "names array<string>, m binary, b array<double>, threshold double").collect()
    r = found[0] if found else {"names": [], "m": b"", "b": [], "threshold": 0.0}
    m = np.frombuffer(r["m"], np.float32).reshape(-1, len(r["names"])) if r["names"] else np.zeros((1 << config.bits, 0), np.float32)
    return {"names": list(r["names"]), "m": m, "b": np.array(r["b"]), "threshold": r["threshold"]}


class _Scores(dict):
    """word -> its row of the sums of its subwords' weights and their number."""

    def __init__(self, model: dict, config: Config, limit: int = 1 << 18):
        super().__init__()
        self.model, self.config, self.limit = model, config, limit
        self.rows = np.zeros((1 << 10, len(model["names"]) + 1))

    def __missing__(self, word: bytes) -> int:
        at = subwords(word, self.config)
        k = len(self)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k, :-1], self.rows[k, -1] = self.model["m"][at].sum(0), len(at)
        self[word] = k
        return k

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        s = self.rows[at].sum(0)
        return _softmax(s[:-1] / s[-1] + self.model["b"])


def predictor(spark: SparkSession, model: dict, config: Config = Config()) -> Callable[[Column], Column]:  # noqa: B008
    """A function from a text column to struct<lang_pred string, score double, rejected boolean>.

    `und` with score 0 and rejected, if the text is null or has no letter; else the likeliest language of the
    whole text, its calibrated probability, and rejected if that is below the model's threshold. A model that
    knows no language says `und` with score 0 too, but rejects only what has no letter, as it can doubt nothing.
    """
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        scores = _Scores(m, config)
        for texts in batches:
            out = []
            for t in texts:
                letters = has_letter(t)
                words = split_words(t, digits=False) if letters and m["names"] else []
                p = scores.probabilities(words) if words else None
                out.append((UNDETERMINED, 0.0, not letters) if p is None else (m["names"][int(p.argmax())], float(p.max()), bool(p.max() < m["threshold"])))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return judge


def predict(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:  # noqa: B008
    """(id, lang_pred, score, rejected) of each row by its whole text; see `predictor` for null and letterless texts.

    Ids are passed through, nulls and repeats too; extra columns are ignored; an empty table gives an empty result.
    """
    judge = predictor(docs.sparkSession, model, config)
    return docs.select(F.col(id_col), judge(F.col(text_col).cast("string")).alias("__p")).select(id_col, "__p.*")


def keep_identified(docs: DataFrame, model: dict, *, text_col: str = "text", config: Config = Config()) -> DataFrame:  # noqa: B008
    """The rows of `docs` that are not rejected (see `predictor`), with all their columns; repeated rows are judged alike, an empty table gives an empty result."""
    judge = predictor(docs.sparkSession, model, config)
    return docs.where(~judge(F.col(text_col).cast("string"))["rejected"])
