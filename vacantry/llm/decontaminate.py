"""Benchmark decontamination with an FM-index of every shard of the training texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, remove_table, stored

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: A shard holds about so many words, or one longer text.
SHARD_WORDS = 1 << 20
#: Test phrases are searched in blocks of about so many windows, which are broadcast.
BLOCK_WINDOWS = 1 << 17
#: Every so many words a suffix's position is kept in the index.
SAMPLE = 16
#: Occurrences located at a time.
LOCATED = 1 << 20

#: Bytes as they are read: A-Z in lower case, what is no word as a space.
_READ = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SHARD = "shard long, ids array<long>, sizes array<long>, vocabulary array<string>, counts array<long>, bits array<binary>, sampled binary, positions array<int>"


def split_words(text: str | None) -> list[bytes]:
    """A text's words: ASCII letters in lower case, digits and all characters beyond ASCII; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_READ).split()


# --- the index --------------------------------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes, where symbol 0 ends a text; an end sorts by its place, so no comparison goes beyond it.

    Suffixes are sorted by three symbols, then those still tied by twice as many at a time.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    ends = symbols == 0
    first = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum()) - 1).astype(np.int64)
    padded = np.concatenate([first, np.zeros(2, np.int64)])
    # beyond an end nothing counts: an end is unique
    second = np.where(ends, 0, padded[1:-1])
    third = np.where(ends | (np.append(ends[1:], True)), 0, padded[2:])
    size = int(first.max()) + 1
    wide = size.bit_length() * 3 <= 62
    key = (first * size + second) * size + third if wide else first * size + second
    width = 3 if wide else 2
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = starts
    alone = new & np.append(new[1:], True)
    tied = order[~alone]
    while len(tied):
        key = (rank[tied] << 32) | rank[tied + width]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        place = np.arange(len(tied))
        old = np.concatenate([[True], (key[1:] >> 32) != (key[:-1] >> 32)])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
        rank[tied] += at
        tied = tied[~(new & np.append(new[1:], True))]
        width *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Ranks:
    """Numbers of set bits before any place of a bit vector."""

    def __init__(self, packed: bytes, n: int):
        raw = np.zeros((n // 64 + 1) * 8, np.uint8)
        raw[: len(packed)] = np.frombuffer(packed, np.uint8)
        self.words = raw.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)


def wavelet_bits(symbols: np.ndarray, levels: int) -> list[bytes]:
    """A wavelet tree by levels: each has one bit of every symbol, from the highest, zeros going before ones to the next level."""
    out = []
    for level in range(levels - 1, -1, -1):
        bit = ((symbols >> level) & 1).astype(bool)
        out.append(np.packbits(bit, bitorder="little").tobytes())
        symbols = np.concatenate([symbols[~bit], symbols[bit]])
    return out


@dataclass
class FMIndex:
    """Burrows-Wheeler transform of a shard's words as a wavelet tree, with sampled suffix positions."""

    counts: np.ndarray  # of each symbol, 0 being the ends of texts
    levels: list[Ranks]
    sampled: Ranks
    positions: np.ndarray

    @classmethod
    def load(cls, counts: np.ndarray, bits: list[bytes], sampled: bytes, positions: np.ndarray) -> FMIndex:
        n = int(counts.sum())
        return cls(counts, [Ranks(b, n) for b in bits], Ranks(sampled, n), positions)

    def __post_init__(self) -> None:
        self.n = int(self.counts.sum())
        self.first = np.cumsum(self.counts) - self.counts
        self.zeros = [self.n - int(r.before[-1]) for r in self.levels]

    def ranks(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How often each symbol comes before each place of the transform."""
        places = [np.zeros(len(symbol), np.int64), *at]
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (len(self.levels) - 1 - level)) & 1 == 1
            ranked = [bits.rank(p) for p in places]
            places = [np.where(one, zeros + r, p - r) for p, r in zip(places, ranked, strict=True)]
        return [p - places[0] for p in places[1:]]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern, a row of symbols above 0, found from its last symbol backward."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = patterns[live, lengths[live] - back]
            a, b = self.ranks(symbol, low[live], high[live])
            low[live], high[live] = self.first[symbol] + a, self.first[symbol] + b
        return low, np.maximum(low, high)

    def step_back(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins a word earlier; no row may be of a text's first word."""
        place, start, symbol = rows, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(place) == 1
            ranked, before = bits.rank(place), bits.rank(start)
            place = np.where(one, zeros + ranked, place - ranked)
            start = np.where(one, zeros + before, start - before)
            symbol = symbol * 2 + one
        return self.first[symbol] + place - start

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by steps back to the next one whose position is kept."""
        out, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            kept = self.sampled.get(rows) == 1
            out[open_[kept]] = self.positions[self.sampled.rank(rows[kept])] + steps
            open_, rows = open_[~kept], rows[~kept]
            if len(open_):
                rows = self.step_back(rows)
            steps += 1
        return out


def build(words: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, list[bytes], bytes, np.ndarray]:
    """(counts, bits, sampled, positions) of texts as arrays of word numbers from 1 to `vocabulary`."""
    symbols = np.concatenate([x for w in words for x in (w, [0])]).astype(np.int64)
    order = suffix_array(symbols)
    ends = symbols == 0
    keep = (np.arange(len(symbols)) % SAMPLE == 0) | np.concatenate([[True], ends[:-1]])
    transform = symbols[order - 1]
    sampled = keep[order]
    bits = wavelet_bits(transform, max(1, int(vocabulary).bit_length()))
    return np.bincount(symbols, minlength=vocabulary + 1), bits, np.packbits(sampled, bitorder="little").tobytes(), order[sampled].astype(np.int32)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The FM-indexes of all texts, stored: a row for each shard, a stretch of one partition's rows of about `shard_words` words or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, known, texts, ids, size = TaskContext.get().partitionId(), 0, {}, [], [], 0

        def shard() -> pa.RecordBatch:
            counts, bits, sampled, positions = build(texts, len(known))
            row = [(part << 33) + made, ids, [len(t) for t in texts], [w.decode("utf-8", "replace") for w in known], counts, bits, sampled, positions]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [f.split()[0] for f in _SHARD.split(", ")])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                words = split_words(t.as_py())
                for w in words:
                    if w not in known:
                        known[w] = len(known) + 1
                texts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                ids.append(i.as_py())
                size += len(words) + 1
                if size >= shard_words:
                    yield shard()
                    made, known, texts, ids, size = made + 1, {}, [], [], 0
        if ids:
            yield shard()

    return stored(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, _SHARD))


# --- test phrases -----------------------------------------------------------------------------------------------

_PHRASES = "item string, words array<string>, windows long"


def window_pieces(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(item, words, windows, block): the items' words in pieces that have all windows between them, dealt to blocks of about `block_windows` windows.

    A long item is cut so that pieces overlap in all but a word of a window. A null item_id is the item ''. Items
    without words have no piece.
    """
    most = max(1, block_windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w.decode("utf-8", "replace") for w in split_words(t)]
                n = max(1, len(words) - window + 1) if words else 0
                out += [(i, words[at : at + min(most, n - at) + window - 1], min(most, n - at)) for at in range(0, n, most)]
            columns = [list(c) for c in zip(*out, strict=True)] or [[], [], []]
            kinds = [pa.string(), pa.list_(pa.string()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _PHRASES.split(", ")])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t"))
    pieces = checkpointed(rows.mapInArrow(run, _PHRASES).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    # running sums by partition and then over the partitions' sums: no window goes over all rows
    own = pieces.groupBy("__part").agg(F.sum("windows").alias("w")).orderBy("__part").collect()
    starts, total = [], 0
    for r in own:
        starts.append((r["__part"], total))
        total += r["w"]
    before = pieces.sparkSession.createDataFrame(starts, "__part int, __start long")
    within = F.sum("windows").over(Window.partitionBy("__part").orderBy("__row")) - F.col("windows")
    return pieces.join(F.broadcast(before), "__part").withColumn("block", F.floor((within + F.col("__start")) / most).cast("long")).drop("__part", "__row", "__start")


@dataclass
class Phrases:
    """A block's distinct windows as rows of word numbers (-1 beyond their length), and the items of each."""

    vocabulary: pa.Array
    windows: np.ndarray
    lengths: np.ndarray
    items: list[str]
    of_window: np.ndarray  # pairs (window, item), sorted
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list, window: int) -> Phrases:
        known: dict[str, int] = {}
        names: dict[str, int] = {}
        seen: dict[bytes, int] = {}
        windows, pairs = [], set()
        for r in rows:
            ids = [known.setdefault(w, len(known)) for w in r["words"]]
            item = names.setdefault(r["item"], len(names))
            for at in range(max(1, len(ids) - window + 1)):
                w = np.full(window, -1, np.int32)
                part = ids[at : at + window]
                w[: len(part)] = part
                k = seen.setdefault(w.tobytes(), len(seen))
                if k == len(windows):
                    windows.append(w)
                pairs.add((k, item))
        table = np.array(windows, np.int64).reshape(-1, window)
        of_window = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        starts = np.searchsorted(of_window[:, 0], np.arange(len(table) + 1))
        return cls(pa.array(list(known), pa.string()), table, (table >= 0).sum(axis=1), list(names), of_window, starts)


def _hits(row: dict, phrases: Phrases) -> Iterator[tuple[int, list, list]]:
    """(text, spans of hit words, items) of a shard's texts with an occurrence of any window."""
    at = pc.index_in(phrases.vocabulary, value_set=row["vocabulary"].values).fill_null(-1).to_numpy(zero_copy_only=False)
    to = np.append(at + 1, -1).astype(np.int64)  # the word's symbol in the shard, 0 if it has none; -1 fills up short windows
    symbols = to[phrases.windows]
    whole = np.flatnonzero((symbols != 0).all(axis=1))
    if not len(whole):
        return
    index = FMIndex.load(row["counts"].values.to_numpy(), [b.as_py() for b in row["bits"].values], row["sampled"].as_py(), row["positions"].values.to_numpy())
    low, high = index.search(symbols[whole], phrases.lengths[whole])
    whole, low, n = whole[high > low], low[high > low], (high - low)[high > low]
    if not len(whole):
        return
    ends = np.cumsum(row["sizes"].values.to_numpy() + 1)
    change = np.zeros(int(ends[-1]) + 1, np.int32)
    met = []
    starts = np.cumsum(n) - n
    for begin in range(0, int(n.sum()), LOCATED):
        k = np.arange(begin, min(begin + LOCATED, int(n.sum())))
        w = np.searchsorted(starts, k, side="right") - 1
        places = index.locate(low[w] + k - starts[w])
        np.add.at(change, places, 1)
        np.add.at(change, places + phrases.lengths[whole[w]], -1)
        met.append(np.unique(np.searchsorted(ends, places, side="right") * len(phrases.windows) + whole[w]))
    met = np.unique(np.concatenate(met))
    edges = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0)
    spans = np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)
    texts = met // len(phrases.windows)
    span_text = np.searchsorted(ends, spans[:, 0], side="right")
    begins = np.concatenate([[0], ends])
    for t in np.unique(texts):
        mine = met[np.searchsorted(texts, t) : np.searchsorted(texts, t, side="right")] % len(phrases.windows)
        items = np.unique(np.concatenate([phrases.of_window[phrases.starts[w] : phrases.starts[w + 1], 1] for w in mine]))
        own = spans[np.searchsorted(span_text, t) : np.searchsorted(span_text, t, side="right")] - begins[t]
        yield int(t), own, [phrases.items[i] for i in items]


_HITS = "shard long, at int, spans array<struct<start: long, end: long>>, items array<string>"


def search(index: DataFrame, phrases: list, *, window: int = WINDOW) -> DataFrame:
    """(shard, at, spans, items) of the texts with an occurrence of a window of one block of phrases; spans are merged and in words."""
    held = index.sparkSession.sparkContext.broadcast(Phrases.of(phrases, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                out = [(row["shard"].as_py(), t, spans, items) for t, spans, items in _hits(row, held.value)]
                if out:
                    shard, at, spans, items = zip(*out, strict=True)
                    flat = np.concatenate(spans)
                    cuts = pa.array(np.cumsum([0, *map(len, spans)]).astype(np.int32))
                    each = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
                    columns = [pa.array(shard, pa.int64()), pa.array(at, pa.int32()), pa.ListArray.from_arrays(cuts, each), pa.array(list(items), pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "at", "spans", "items"])

    return index.mapInArrow(run, _HITS)


def contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """One row for each row of `docs`: id, n_words, n_hit, spans, items.

    A window is `window` consecutive words of an item, or all words of a shorter one. spans are the removal spans,
    merged and in order, as (start, end) in words; n_hit counts their words; items are the ids, as text, of the
    items with an occurring window, sorted, each once. Texts are indexed in shards, once; the test phrases are
    searched in blocks of bounded size, each broadcast, and what a text has from several blocks is put together.
    Null and empty texts have no words, nor hits. Ids are passed through, nulls and repeats too; of items, equal
    ids are one, null is ''. Extra columns are ignored; an empty table of either gives no rows, or no hits.
    """
    index = build_index(docs, id_col=id_col, text_col=text_col, shard_words=shard_words)
    phrases = stored(window_pieces(items, id_col=item_col, text_col=item_text_col, window=window, block_windows=block_windows))
    found = []
    for r in phrases.select("block").distinct().orderBy("block").toLocalIterator():
        found.append(stored(search(index, phrases.where(F.col("block") == r["block"]).collect(), window=window)))
    remove_table(phrases)
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "sizes")).alias("at", "d")).select("shard", "at", F.col("d.ids").alias(id_col), F.col("d.sizes").alias("n_words"))
    if not found:
        nothing = index.sparkSession.createDataFrame([], _HITS)
    else:
        nothing = found[0]
        for more in found[1:]:
            nothing = nothing.unionByName(more)
    hits = nothing.groupBy("shard", "at").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = hits.select("shard", "at", merged_spans("s").alias("spans"), "items")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    out = rows.join(hits, ["shard", "at"], "left").withColumn("spans", none("spans", "array<struct<start: bigint, end: bigint>>"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(id_col, "n_words", n_hit.alias("n_hit"), "spans", none("items", "array<string>").alias("items"))


def merged_spans(spans: str) -> Column:
    """Sorted spans, those that overlap or touch made one."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        apart = F.array_append(done, s)
        return F.when(F.size(done) == 0, apart).when(last["end"] < s["start"], apart).otherwise(F.array_append(F.slice(done, 1, F.size(done) - 1), joined))

    return F.aggregate(spans, F.array().cast("array<struct<start: bigint, end: bigint>>"), add)


def remove_hits(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the words of its removal spans and what stands between them; a helper for those who cut rather than drop."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    read = raw.translate(_READ)
    at, k, places = 0, 0, []
    for w in read.split():
        at = read.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
        k += 1
    out, last = [], 0
    for start, end in spans:
        out.append(raw[last : places[start][0]])
        last = places[end - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")
