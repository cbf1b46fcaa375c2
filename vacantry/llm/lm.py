"""Scoring documents by the cross-entropy difference of two n-gram models."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions
from .words import Hashes, pairs, split_words

#: What stands before a text's first word, and an entry of its own: words' are negative, pairs' 2**62 or more.
START, START_ENTRY = np.uint64(0x51ED270B), 0
#: What a row is for: counted in the target or the background, scored, or only the id of a row of the target.
TARGET, BACKGROUND, SCORED, MARK = 1, 2, 4, 8


@dataclass(frozen=True)
class Shape:
    """What both models share: the vocabulary, of 2**word_bits words or of all in the corpus, if they are more, and the weights of their parts.

    A word's probability after another is `weight` times its share of what followed that one, a text's end included,
    and for the rest its probability as a single word; that is `spread` times an equal share of the vocabulary, and
    for the rest its share of all words. After a word that was never seen, or with no words at all, the simpler
    part has the whole weight. So probabilities of all words and the end sum to one, and both models smooth alike,
    whatever their sizes. Every word and every bigram has an entry of its own, a hash of 62 bits or more, so the
    models grow with the corpus; that two entries share a hash is to be expected from some 2**31 entries on.
    """

    word_bits: int = 17
    weight: float = 0.7  # of the bigram estimate; the rest is for the unigram estimate
    spread: float = 0.05  # of the unigram estimate that the whole vocabulary shares

    def entries(self, hashes: np.ndarray, first: np.ndarray | tuple = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, context, bigram) entry of each token; words are negative. Texts begin at 0 and at `first`."""
        before = np.roll(hashes, 1)
        word = lambda h: (h | np.uint64(1 << 63)).view(np.int64)
        begins = np.unique(np.concatenate([np.zeros(min(1, len(hashes)), np.int64), np.asarray(first, np.int64)]))
        before[begins] = START
        context = word(before)
        context[begins] = START_ENTRY
        return word(hashes), context, (pairs(before, hashes, 1) >> np.uint64(2) | np.uint64(1 << 62)).view(np.int64)

    def log_prob(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
        """From counts of the pair, of its first word and of its second, and of all words."""
        single = np.where(total > 0, (1 - self.spread) * word / np.maximum(total, 1) + self.spread / vocabulary, 1 / vocabulary)
        return np.log(np.where(context > 0, self.weight * pair / np.maximum(context, 1) + (1 - self.weight) * single, single))


@dataclass(frozen=True)
class Model:
    """The texts (column `t`) whose words and bigrams are counted where documents are scored."""

    shape: Shape
    texts: DataFrame


def fit(target: DataFrame, background: DataFrame, *, text_col: str = "text", shape: Shape = Shape()) -> tuple[Model, Model]:  # noqa: B008
    """The two models, of all rows of both tables."""
    return tuple(Model(shape, df.select(F.col(text_col).cast("string").alias("t"))) for df in (target, background))


def cross_entropy_difference(docs: DataFrame, target: Model, background: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of each row of `docs`.

    Losses are in nats a token over the whole text (see Shape); score is target_loss - background_loss, lower for
    texts more like the target. `docs` are taken for texts that the models have not seen. A null text or one without
    words has no tokens, and null losses and score. Ids are passed through, nulls and repeats too; extra columns are
    ignored; an empty table gives an empty result.
    """
    rows = _rows(docs, SCORED, F.col(id_col), F.col(text_col))
    none = F.lit(None).cast(docs.schema[id_col].dataType)
    for model, use in ((target, TARGET), (background, BACKGROUND)):
        rows = rows.unionAll(_rows(model.texts, use, none, F.col("t")))
    return _scored(rows, target.shape, id_col)


def difference_from_marked(docs: DataFrame, marked: DataFrame, *, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """The same with `docs` as background and, as target, the rows whose id `marked` has in its column `id_col`.

    Every row is scored by what the other rows say: its own words and bigrams are taken off the counts of each
    model that it is part of, so a text does not do well by being remembered.
    """
    rows = _rows(docs, BACKGROUND | SCORED, F.col(id_col), F.col(text_col))
    ids = marked.select(F.col(id_col).cast(docs.schema[id_col].dataType).alias("id")).where("id is not null").distinct()
    return _scored(rows.unionAll(_rows(ids, MARK, F.col("id"), F.lit(None))), shape, id_col)


def _rows(df: DataFrame, use: int, of: Column, text: Column) -> DataFrame:
    return df.select(of.alias("id"), text.cast("string").alias("text"), F.lit(use).alias("use"))


def _slots(spark: SparkSession) -> list[int]:
    """Numbers that a shuffle by them deals to one partition each, about as many as it has partitions."""
    n = shuffle_partitions(spark)
    number = F.col("id").cast("int")
    found = spark.range(40 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("p")).agg(F.min(number).alias("slot"))
    return sorted(r["slot"] for r in found.collect())


def _scored(rows: DataFrame, shape: Shape, id_col: str) -> DataFrame:
    """Rows are dealt to groups. A group asks, for each of its entries once, the bucket of that entry, telling its
    own counts; a bucket adds up what all groups tell and answers each in its order. What a group asks depends only
    on which rows it has, so it is found again when the answers come. Groups and buckets grow in number with the
    shuffle's partitions; only totals come to the driver.
    """
    slots = _slots(rows.sparkSession)
    spread = F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text")))  # an id that is null counts for nothing
    at = F.pmod(spread, F.lit(len(slots)))
    rows = rows.withColumn("group", F.element_at(F.array(*map(F.lit, slots)), (at + 1).cast("int")))

    def parts(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[np.ndarray]]:
        """The rows with texts, what they are for, and which are part of the target and of the background."""
        use = table["use"].to_numpy()
        marked = set(table["id"].filter(pa.array(use == MARK)).to_pylist())
        table, use = table.filter(pa.array(use != MARK)), use[use != MARK]
        told = use & TARGET != 0
        if marked:
            told |= np.fromiter((x in marked for x in table["id"].to_pylist()), bool, len(use))
        return table, use, [told, use & BACKGROUND != 0]

    def ask(table: pa.Table) -> pa.Table:
        table, use, member = parts(table)
        seen = _Entries(table["text"], shape)
        counts = [seen.counts(x) for x in member]
        out = [(slots[k], table["group"][0].as_py(), _packed(np.diff(seen.keys[i], prepend=0)), *(_packed(c[i]) for c in counts)) for k, i in seen.buckets(len(slots))] if len(use) else []
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, ASKED.types, strict=True)], schema=ASKED)

    def answer(table: pa.Table) -> pa.Table:
        asked = [np.cumsum(_unpacked(x.as_py())) for x in table["keys"]]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        ends = np.cumsum([len(x) for x in asked])[:-1]
        sums = [np.bincount(at, np.concatenate([_unpacked(x.as_py()) for x in table[n]]), len(keys)).astype(np.int64) for n in ("t", "b")]
        back = [[_packed(x) for x in np.split(s[at], ends)] for s in sums]
        words = keys < 0
        known = [int((words & (sums[0] + sums[1] > 0)).sum()), *(int(s[words].sum()) for s in sums)]
        rest = [[x] + [0] * (len(asked) - 1) for x in known]
        return pa.table([table["group"], table["bucket"], *map(pa.array, back), *(pa.array(x, pa.int64()) for x in rest)], names=["group", "bucket", "t", "b", "words", "n_t", "n_b"])

    asked = rows.groupBy("group").applyInArrow(ask, "bucket int, group int, keys binary, t binary, b binary")
    answers = checkpointed(asked.groupBy("bucket").applyInArrow(answer, "group int, bucket int, t binary, b binary, words long, n_t long, n_b long"))
    words, *totals = (x or 0 for x in answers.agg(F.sum("words"), F.sum("n_t"), F.sum("n_b")).first())
    vocabulary = max(1 << shape.word_bits, words)

    def losses(table: pa.Table, found: pa.Table) -> pa.Table:
        table, use, member = parts(table)
        seen = _Entries(table["text"], shape)
        own = seen.own() if any(m.any() for m in member) else None
        place = dict(seen.buckets(len(slots)))
        number = {s: k for k, s in enumerate(slots)}
        out = []
        for name, total, part in zip(("t", "b"), totals, member, strict=True):
            c = np.zeros(len(seen.keys))
            for bucket, x in zip(found["bucket"].to_pylist(), found[name], strict=True):
                c[place[number[bucket]]] = _unpacked(x.as_py())
            pair, context, word, size = c[seen.pair], c[seen.context], c[seen.word], np.full(len(seen.word), float(total))
            if own and part.any():
                of = part[seen.text]
                pair, context, word, size = (x - of * y for x, y in zip((pair, context, word, size), own, strict=True))
            log_prob = shape.log_prob(pair, context, word, size, vocabulary)
            out.append(-np.bincount(seen.text, log_prob, len(seen.sizes)) / np.maximum(seen.sizes, 1))
        wanted = use & SCORED != 0
        none = (seen.sizes == 0)[wanted]
        values = [pa.array(x[wanted], mask=none) for x in (*out, out[0] - out[1])]
        return pa.table([table["id"].filter(pa.array(wanted)), pa.array(seen.sizes[wanted]), *values], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    names = [id_col, "n_tokens", "target_loss", "background_loss", "score"]
    schema = f"`{id_col}` {kind}, n_tokens long, target_loss double, background_loss double, score double"
    return rows.groupBy("group").cogroup(answers.select("group", "bucket", "t", "b").groupBy("group")).applyInArrow(losses, schema)


ASKED = pa.schema([("bucket", pa.int32()), ("group", pa.int32()), ("keys", pa.binary()), ("t", pa.binary()), ("b", pa.binary())])


class _Entries:
    """The different entries of some texts in order (`keys`), and for each token its text and where its entries are in `keys`."""

    def __init__(self, texts: pa.ChunkedArray, shape: Shape):
        known = Hashes()
        each = [known.of(split_words(t.as_py())) for t in texts]
        self.sizes = np.array([len(x) for x in each], np.int64)
        self.text = np.repeat(np.arange(len(each)), self.sizes)
        hashes = np.concatenate([np.zeros(0, np.uint64), *each])
        first = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        word, context, pair = shape.entries(hashes, first)
        self.keys, at = np.unique(np.concatenate([word, context[:1], pair]), return_inverse=True)
        n = len(word)
        self.word, start, self.pair = at[:n], at[n : n + len(context[:1])], at[n + len(context[:1]) :]
        self.context = np.roll(self.word, 1)
        self.context[first] = start
        self.start = start

    def counts(self, wanted: np.ndarray) -> np.ndarray:
        """How often each entry occurs in the wanted texts; START once for each text that has words."""
        on = wanted[self.text]
        out = np.bincount(self.word[on], minlength=len(self.keys)) + np.bincount(self.pair[on], minlength=len(self.keys))
        out[self.start] += np.count_nonzero(wanted & (self.sizes > 0))
        return out.astype(np.int64)

    def own(self) -> tuple[np.ndarray, ...]:
        """How often its pair, its context and its word, and how many words at all, the text of each token has."""
        per_text = self.text * len(self.keys)
        words, at, n = np.unique(per_text + self.word, return_inverse=True, return_counts=True)
        word = n[at].astype(np.float64)
        context = np.roll(word, 1)  # a word stands before another as often as it is there, the end included
        context[np.flatnonzero(np.diff(self.text, prepend=-1))] = 1
        _, at, n = np.unique(per_text + self.pair, return_inverse=True, return_counts=True)
        return n[at].astype(np.float64), context, word, self.sizes[self.text].astype(np.float64)

    def buckets(self, n: int) -> list[tuple[int, np.ndarray]]:
        """(bucket, places in `keys`) of each bucket that has some."""
        part = (self.keys.view(np.uint64) & np.uint64((1 << 62) - 1)) >> np.uint64(30)
        of = (part * np.uint64(n)) >> np.uint64(32)  # by ranges, so that the numbers between a bucket's entries are small
        places = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of.astype(np.int64), minlength=n))[:-1])
        return [(k, x) for k, x in enumerate(places) if len(x)]


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers with their bytes by significance, as most are small."""
    return zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
