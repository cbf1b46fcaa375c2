"""Phrase collocation mining by stripes: each prefix keys an associative counter of what follows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remove_table, shuffle_partitions, stored

#: A block holds the words of about so many bytes of text, or of one longer row.
BLOCK_BYTES = 4 << 20
#: The stripe of a word of more occurrences is split so that a part counts about so many.
PART_OCCURRENCES = 1 << 18
#: Entries of a stripe in a row, and entries that are merged at a time.
ROW_ENTRIES, MERGED_ENTRIES = 1 << 10, 1 << 18
#: Salts by which a language's phrases are ranked before its best are put together.
SALTS = 64
UNDETERMINED = "und"

#: Bytes as they are read: A-Z in lower case, tabs as spaces, the marks that end a piece as line feeds.
_READ = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    """Word -> its number among all words of a block's languages."""

    def __init__(self, owner: list):
        super().__init__({b"": -2, b"\n": -1})
        self.owner = owner

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.owner)
        self.owner.append(word)
        return n


def _word_blocks(block_bytes: int):
    """Rows of (lang, text) to blocks: the words' numbers with -1 between pieces, and the words with their language and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        words: list[bytes] = []
        known: dict[str, _Words] = {}
        texts: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(texts)
            n = np.bincount(ids[ids >= 0], minlength=len(words))
            of = np.empty(len(words), object)
            for lang, d in known.items():
                of[[k for w, k in d.items() if k >= 0]] = lang
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 33) + made]),
                    pa.array([_packed(_shrunk(ids))], pa.binary()),
                    pa.array([of.tolist()], pa.list_(pa.string())),
                    pa.array([[w.decode("utf-8", "replace") for w in words]], pa.list_(pa.string())),
                    pa.array([n], pa.list_(pa.int64())),
                ],
                ["block", "ids", "langs", "words", "times"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                said = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_READ).replace(b"\n", b" \n ").split(b" ")
                if lang not in known:
                    known[lang] = _Words(words)
                ids = np.fromiter(map(known[lang].__getitem__, said), np.int64, len(said))
                texts += [ids[ids > -2], np.array([-1])]
                size += sum(map(len, said)) + 8
                if size >= block_bytes:
                    yield block()
                    made += 1
                    words.clear()
                    known.clear()
                    texts, size = [], 0
        if texts:
            yield block()

    return run


def _shrunk(ids: np.ndarray) -> np.ndarray:
    """Each run of -1 as one."""
    return ids[(ids >= 0) | np.concatenate([[True], ids[:-1] >= 0])].astype(np.int64)


def _packed(ids: np.ndarray) -> bytes:
    return len(ids).to_bytes(8, "little") + pa.compress(ids.tobytes(), "zstd", asbytes=True)


def _unpacked(state: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(state[8:], 8 * int.from_bytes(state[:8], "little"), "zstd", asbytes=True), np.int64)


def _sorted_sums(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of whole numbers from 0 to 2**31 - 1, sorted, equal ones made one with the sum of n."""
    wide = lambda k: columns[k].astype(np.int64) << 32 | columns[k + 1] if k + 1 < len(columns) else columns[k]
    order = np.lexsort([wide(k) for k in range(0, len(columns), 2)][::-1])
    new = np.zeros(len(n), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.add.reduceat(n[order], first) if len(first) else n


def _stripes(longest: int, part_size: int):
    """A block and the ids of its frequent words, from 1, to its stripes: each word keys the counter of the words that follow it, up to an infrequent one or a piece's end."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("prefix", pa.int32()), ("part", pa.int32()), ("parts", pa.int32()), ("follows", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
        if not block.num_rows or not answers.num_rows:
            return schema.empty_table()
        ids = _unpacked(block["ids"][0].as_py())
        at, got, n = (answers[c].to_numpy() for c in ("at", "id", "n"))
        to = np.zeros(max(int(ids.max(initial=-1)), int(at.max())) + 2, np.int32)
        to[at] = got
        ids = np.append(to[ids], np.zeros(longest, np.int32))
        here = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        if not len(here):
            return schema.empty_table()
        columns = [ids[here]]
        for k in range(1, longest):
            columns.append(np.where(columns[-1] > 0, ids[here + k], np.int32(0)))
        columns, times = _sorted_sums(columns, np.ones(len(here), np.int32))
        order = np.argsort(got)
        total = n[order][np.searchsorted(got[order], columns[0])]
        parts = 1 + total // part_size
        mixed = ((columns[1].astype(np.int64) << 32 | (columns[2] if longest > 2 else 0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        part = (mixed % parts.astype(np.uint64)).astype(np.int64)
        key = columns[0].astype(np.int64) << 32 | part
        if (parts > 1).any():
            order = np.argsort(key, kind="stable")
            columns, times, part, parts, key = [c[order] for c in columns], times[order], part[order], parts[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        new = np.flatnonzero(place % ROW_ENTRIES == 0)
        cuts = np.append(new, len(key))
        follows = np.stack(columns[1:], axis=1).astype(np.int32).ravel()
        return pa.table(
            [
                pa.array(columns[0][new].astype(np.int32)),
                pa.array(part[new].astype(np.int32)),
                pa.array(parts[new].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array((cuts * (longest - 1)).astype(np.int32)), pa.array(follows)),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(times.astype(np.int32))),
            ],
            schema=schema,
        )

    return run


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of stripes in slices of about MERGED_ENTRIES entries."""
    number = np.cumsum(batch.column(4).value_lengths().to_numpy()) // MERGED_ENTRIES
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def _merge_stripes(longest: int, least: int):
    """Stripes sorted by (prefix, part), merged elementwise, to the phrases counted in them: (size, words, n).

    Phrases below `least` go, but for pairs of a prefix in several parts, whose counts are still to be added up.
    What the last key has is carried on to the next batch.
    """
    names = ["size", *(f"w{k}" for k in range(1, longest + 1)), "n"]

    def counted(columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        prefix, part, parts, *follows = columns
        words = [prefix, *follows]
        new = np.ones(len(n), bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])
        for size in range(2, longest + 1):
            column = words[size - 1]
            new[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(new)
            if not len(first):
                return
            sums = np.add.reduceat(n, first)
            good = (column[first] > 0) & ((sums >= least) | ((parts[first] > 1) if size == 2 else False))
            at = first[good]
            out = [np.full(len(at), size), *(w[at] if k < size else np.zeros(len(at), np.int64) for k, w in enumerate(words)), sums[good]]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in out[:-1]] + [pa.array(out[-1])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n = [np.zeros(0, np.int64)] * (longest + 2), np.zeros(0, np.int64)
        for b in (part for batch in batches for part in _slices(batch)):
            lengths = b.column(4).value_lengths().to_numpy()
            follows = b.column(3).flatten().to_numpy().reshape(-1, longest - 1).astype(np.int64)
            columns = [np.repeat(b.column(k).to_numpy().astype(np.int64), lengths) for k in range(3)] + list(follows.T)
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            columns, n = _sorted_sums(columns, np.concatenate([held_n, b.column(4).flatten().to_numpy().astype(np.int64)]))
            if len(n):
                last = np.searchsorted(columns[0] << 32 | columns[1], columns[0][-1] << 32 | columns[1][-1])
                held, held_n = [c[last:] for c in columns], n[last:]
                yield from counted([c[:last] for c in columns], n[:last])
        yield from counted(held, held_n)

    return run


def _numbered(found: DataFrame) -> DataFrame:
    """Stored rows with `id`, gapless from 1: rows are numbered within partitions, whose sizes go through the driver."""
    rows = stored(found.withColumn("__row", F.monotonically_increasing_id()))
    part, bits = F.shiftright("__row", 33), (1 << 33) - 1
    total, starts = 1, []
    for r in rows.groupBy(part.alias("p")).count().orderBy("p").collect():
        starts.append((r["p"], total))
        total += r["count"]
    if total >= 1 << 31:
        raise ValueError("more than 2**31 frequent words")
    start = found.sparkSession.createDataFrame(starts, "__part long, __start long")
    of = rows.withColumn("__part", part).join(F.broadcast(start), "__part")
    return of.withColumn("id", (F.col("__start") + F.col("__row").bitwiseAND(bits)).cast("int")).drop("__row", "__part", "__start")


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def phrases(
    docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4, block_bytes: int = BLOCK_BYTES, part_size: int = PART_OCCURRENCES
) -> tuple[DataFrame, DataFrame]:
    """(frequent phrases, words of each language): (size, lang, words, a, lefts, rights, extension) and (lang, n).

    a is the number of occurrences, lefts and rights those of the first and the last 1, 2, ... words, extension the
    largest count of a frequent phrase that is one word longer and contains this one, or null. Words of at least
    `least` occurrences are phrases of size 1. Languages are apart, null is `und`.

    Each block of texts makes one structure, its stripes: a word keys the counter of what follows it, up to
    `longest` - 1 words, cut before an infrequent word, as no frequent phrase has one. Stripes are merged
    elementwise by word, that of a frequent word in parts by a hash of the next two words. A merged stripe gives
    the counts of all phrases that begin with its word; a pair of a word in parts is added up. Extensions,
    totals at either end and subsumption maxima all come from these. Null and empty texts have no words; an
    empty table gives empty results.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(rows.mapInArrow(_word_blocks(block_bytes), "block long, ids binary, langs array<string>, words array<string>, times array<long>"))
    words = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words", "times")).alias("at", "w")).select("block", "at", "w.langs", "w.words", "w.times")
    counts = stored(words.groupBy("langs", "words").agg(F.sum("times").alias("n")))
    totals = counts.groupBy(F.col("langs").alias("lang")).agg(F.sum("n").alias("n"))
    found = stored(_numbered(counts.where(F.col("n") >= least)))
    answers = words.drop("times").join(found, ["langs", "words"]).select(F.col("block").alias("asker"), "at", "id", "n")
    made = blocks.select("block", "ids").groupBy("block").cogroup(answers.groupBy("asker"))
    stripes = made.applyInArrow(_stripes(longest, part_size), "prefix int, part int, parts int, follows array<int>, times array<int>")
    merged = stripes.repartition(shuffle_partitions(spark), "prefix", "part").sortWithinPartitions("prefix", "part")
    names = [f"w{k}" for k in range(1, longest + 1)]
    merged = stored(merged.mapInArrow(_merge_stripes(longest, least), f"size int, {' int, '.join(names)} int, n long"))
    remove_table(blocks)
    level = found.select(F.col("id").alias("w1"), F.col("langs").alias("lang"), F.array("words").alias("words"), F.col("n").alias("a"), F.array("n").alias("lefts"), F.array("n").alias("rights"))
    out = []
    for size in range(2, longest + 2):
        longer = merged.where(F.col("size") == size).select(*names[:size], "n") if size <= longest else None
        if size == 2:
            longer = longer.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        own, whole = names[: size - 1], level.withColumn("extension", F.lit(None).cast("long"))
        if longer is not None:
            longer = stored(longer)
            shifted = [F.col(c).alias(o) for c, o in zip(names[1:size], own, strict=True)]
            offered = longer.select(*own, "n").unionAll(longer.select(*shifted, "n"))
            whole = level.join(offered.groupBy(*own).agg(F.max("n").alias("extension")), own, "left")
        out.append(whole.select(F.lit(size - 1).alias("size"), "lang", "words", "a", "lefts", "rights", "extension"))
        if longer is not None:
            right = level.select(*[F.col(o).alias(c) for c, o in zip(names[1:size], own, strict=True)], F.element_at("words", -1).alias("last"), "rights")
            of = longer.join(level.select(*own, "lang", "words", "lefts"), own).join(right, names[1:size])
            grown = [F.array_append("words", F.col("last")).alias("words"), F.col("n").alias("a"), F.array_append("lefts", F.col("n")).alias("lefts"), F.array_append("rights", F.col("n")).alias("rights")]
            level = stored(of.select(*names[:size], "lang", *grown))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole, totals


def collocations(
    docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4, best: int = 2000, subsumed: int = 80, block_bytes: int = BLOCK_BYTES, part_size: int = PART_OCCURRENCES
) -> DataFrame:
    """The `best` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the occurrences of the phrase and of both sides of the cut with the lowest score
    floor(2000000 a / (l + r)), the first of equal ones; n is the number of the language's words. Phrases that a
    longer frequent one contains, with at least `subsumed` percent of their occurrences, are dropped. Ties by a
    descending, then by phrase in UTF-8 order. All arithmetic is in whole numbers of 38 digits. See `phrases` for
    nulls, empty texts and tables; repeated rows count each; extra columns are ignored.
    """
    found, totals = phrases(docs, lang_col=lang_col, text_col=text_col, least=least, longest=longest, block_bytes=block_bytes, part_size=part_size)
    kept = found.where(F.col("size") >= 2).where(F.col("extension").isNull() | (100 * _exact("extension") < subsumed * _exact("a")))
    whole = lambda c: c.cast("decimal(20,0)")

    def cut(k: Column) -> Column:
        l, r = F.element_at("lefts", k), F.element_at("rights", F.col("size") - k)  # noqa: E741
        return F.struct(F.call_function("div", 2000000 * _exact("a"), whole(l) + whole(r)).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    lowest = kept.withColumn("c", F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)))
    lowest = lowest.select("lang", F.array_join("words", " ").alias("phrase"), "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= best)
    salted = first(lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), "lang", "salt").drop("salt", "rank")
    ranked = first(salted, "lang").join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
