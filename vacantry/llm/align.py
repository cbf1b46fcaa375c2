"""Cross-tokenizer alignment by diagonal run skipping."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, stored

#: Fixed value: how the byte-level vocabulary's tokenizer cuts a text before it merges bytes.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A block's documents have about so many bytes of text, or it is one document.
BLOCK_BYTES = 2 << 20


# --- tokenizers -------------------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """A tokenizer: `encode` gives a text's ids, `pieces` the bytes of each id."""

    encode: Callable[[str], np.ndarray]
    pieces: list[bytes]
    sizes: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


def byte_level(vocabulary: bytes) -> Tokens:
    """Tokenizer A from a byte-level BPE's JSON, whose ids are its merges' order; special tokens are ordinary text.

    tiktoken merges by these ranks and gives the same ids as the tokenizers library, in a third of its time.
    """
    import tiktoken

    letters = _byte_letters()
    model = json.loads(vocabulary)
    special = {t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
    engine = tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        pieces[i] = token
    return Tokens(lambda text: engine.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64), pieces)


def piece_level(model: bytes) -> Tokens:
    """Tokenizer B from a sentencepiece model, which puts a space before the text itself."""
    import sentencepiece

    engine = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [
        bytes([int(engine.id_to_piece(i)[3:5], 16)]) if engine.is_byte(i) else engine.id_to_piece(i).replace("▁", " ").encode()
        for i in range(engine.get_piece_size())
    ]
    return Tokens(lambda text: np.array(engine.encode(text, num_threads=1), np.int64), pieces)


# --- one text ---------------------------------------------------------------------------------------------------


def skip_diagonal(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group ends in A, group ends in B, linked A tokens, linked B tokens) of two tokenizations of the same bytes.

    The arguments are the byte offsets at which tokens end, the last of each the same. While tokens end together,
    at the present index shift between both, stretches of doubling length are compared at once and then halved to
    the first difference: a stretch of one-to-one groups is jumped over. Where ends differ, the group is resolved
    token by token up to the next end in common, which sets the new shift.
    """
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = ends_a.astype(np.int64).tobytes(), ends_b.astype(np.int64).tobytes()
    n, m = len(a), len(b)
    #: Jumps as (first A token, first B token, length), irregular groups as ends, and links of the latter.
    jumps: list[int] = []
    ends: list[int] = []
    links: list[int] = []
    i = j = 0
    while i < n and j < m:
        x, y = a[i], b[j]
        if x == y:
            most, run, step = min(n - i, m - j), 1, 1
            while run < most:
                if step == 1:
                    if a[i + run] != b[j + run]:
                        break
                    run += 1
                    step = 2
                else:
                    step = min(step, most - run)
                    if raw_a[8 * (i + run) : 8 * (i + run + step)] == raw_b[8 * (j + run) : 8 * (j + run + step)]:
                        run += step
                        step *= 2
                    else:
                        most, step = run + step - 1, step // 2
            jumps += (i, j, run)
            i += run
            j += run
        else:
            links += (i, j)
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
                links += (i, j)
            i += 1
            j += 1
            ends += (i, j)
    jumped = np.array(jumps, np.int64).reshape(-1, 3)
    within = np.arange(jumped[:, 2].sum()) - np.repeat(np.cumsum(jumped[:, 2]) - jumped[:, 2], jumped[:, 2])
    even = np.repeat(jumped[:, :2], jumped[:, 2], axis=0) + within[:, None]
    group = np.sort(np.concatenate([even + 1, np.array(ends, np.int64).reshape(-1, 2)]), axis=0)
    link = np.sort(np.concatenate([even, np.array(links, np.int64).reshape(-1, 2)]), axis=0)
    return group[:, 0], group[:, 1], link[:, 0], link[:, 1]


class Writer:
    """Writes groups as `a1,a2|b1;a3|b2,b3`: every id's text with each mark that can follow it is a row of a table, filled up with zeros."""

    def __init__(self, size_a: int, size_b: int):
        texts = [f"{i}{mark}".encode() for size, marks in ((size_a, ",|"), (size_b, ",;")) for mark in marks for i in range(size)]
        self.table = np.array(texts).view(np.uint8).reshape(len(texts), -1)
        self.size_a, self.size_b = size_a, size_b

    def write(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> bytes:
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[group_a - 1] = 1
        last_b[group_b - 1] = 1
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], group_b])[of_a]] = a + last_a * self.size_a
        order[np.arange(len(b)) + group_a[of_b]] = b + last_b * self.size_b + 2 * self.size_a
        said = self.table[order].ravel()
        return said[said != 0].tobytes()[:-1]


@dataclass
class Alignment:
    """Ids of both tokenizers, ends of groups in both (token indices), and links as pairs of token indices."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


_NONE = np.zeros(0, np.int64)


def align_text(text: str | None, first: Tokens, second: Tokens) -> Alignment:
    """The alignment of a whole text; empty if it is null or empty, or if the tokens of either do not add up to a space and the text."""
    if text:
        said = b" " + text.encode("utf-8", "surrogatepass")
        a, b = first.encode(text), second.encode(text)
        if first.joined(a.tolist()) == said and second.joined(b.tolist()) == said:
            return Alignment(a, b, *skip_diagonal(np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b])))
    return Alignment(*[_NONE] * 6)


# --- documents in blocks ----------------------------------------------------------------------------------------

_BLOCK = "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, link_ends array<long>, links binary, pairs array<long>, times array<long>"
#: An id pair as one number: A's id above these bits, B's id in them.
_B_BITS = 32


def _packed(codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(indices of each code's pair, compressed; the pairs; how often each occurs)."""
    coded = pc.dictionary_encode(pa.array(codes, pa.int64()))
    at, pairs = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    kind = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
    return pa.compress(at.astype(kind).tobytes(), "zstd", asbytes=True), pairs, np.bincount(at, minlength=len(pairs))


def _unpacked(links: bytes, n: int, pairs: int) -> np.ndarray:
    kind = np.dtype(np.uint16 if pairs <= 1 << 16 else np.uint32)
    return np.frombuffer(pa.decompress(links, n * kind.itemsize, "zstd", asbytes=True), kind)


def align(docs: DataFrame, a_vocabulary: bytes, b_model: bytes, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of aligned documents, stored: for each row its counts, the digest of its groups, and its links as indices of id pairs.

    A block is a stretch of one partition's rows, of about `block_bytes` of text or of one longer row. Both
    vocabularies travel to the workers, so their files need to be on the driver only.
    """
    files = docs.sparkSession.sparkContext.broadcast((a_vocabulary, b_model))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = byte_level(files.value[0]), piece_level(files.value[1])
        writer = Writer(len(first.pieces), len(second.pieces))
        part, made, rows, codes, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            links, pairs, times = _packed(np.concatenate(codes))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()]
            out = [pa.array([(part << 33) + made])]
            out += [pa.array([c], pa.list_(k)) for c, k in zip(columns[:5], kinds, strict=True)]
            out += [pa.array([np.cumsum(columns[5])], pa.list_(pa.int64())), pa.array([links], pa.binary())]
            out += [pa.array([pairs], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(out, [f.split()[0] for f in _BLOCK.split(", ")])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                text = t.as_py()
                x = align_text(text, first, second)
                said = hashlib.sha256(writer.write(x.a, x.b, x.group_a, x.group_b)).hexdigest() if len(x.a) else ""
                rows.append((i.as_py(), len(x.a), len(x.b), len(x.group_a), said, len(x.link_a)))
                codes.append((x.a[x.link_a] << _B_BITS) + x.b[x.link_b])
                size += len(text or "") + 64
                if size >= block_bytes:
                    yield block()
                    made, rows, codes, size = made + 1, [], [], 0
        if rows:
            yield block()

    return stored(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(blocks, _BLOCK))


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what blocks ask: block, at, pair; pair, n, best): each id pair's links in the corpus, and whether no pair of its B id has more."""
    asked = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = checkpointed(asked.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << _B_BITS) - 1)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return asked.drop("times"), counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, a_vocabulary: bytes, b_model: bytes, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of `docs`: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose id pair no other pair of the same B id exceeds in the corpus, count_sum adds up
    the corpus-wide counts of all links' pairs. Every text is encoded once; a block then asks for the counts of its
    distinct pairs, so that a pair which is everywhere comes once from each block, and its documents are summed
    where its answers meet. Null and empty texts, and texts that either tokenizer does not give back byte by byte,
    have zeros and the digest ''. Ids are passed through, nulls and repeats too: rows are never joined by them. Extra
    columns are ignored; an empty table gives an empty result.
    """
    blocks = align(docs, a_vocabulary, b_model, id_col=id_col, text_col=text_col, block_bytes=block_bytes)
    asked, counts = pair_counts(blocks)
    answers = asked.join(counts, "pair").select("block", "at", "n", "best")
    name = free_name(docs, "rows") if id_col == "rows" else id_col
    schema = f"`{name}` long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def summed(block: pa.Table, said: pa.Table) -> pa.Table:
        row = block.slice(0, 1)
        value = lambda c: row[c].combine_chunks()[0].values
        ends = value("link_ends").to_numpy()
        count, best = np.zeros(said.num_rows, np.int64), np.zeros(said.num_rows, np.int64)
        at = said["at"].to_numpy()
        count[at] = said["n"].to_numpy()
        best[at] = said["best"].to_numpy().astype(np.int64)
        links = _unpacked(row["links"][0].as_py(), int(ends[-1]), len(count))
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[links])])[np.concatenate([[0], ends])])
        out = [value("ids"), value("n_a"), value("n_b"), value("n_groups"), np.diff(ends, prepend=0), total(best), total(count), value("digests")]
        return pa.table([pa.array(x) for x in out], [name, *(f.split()[0] for f in schema.split(", ")[1:])])

    slim = blocks.select("block", "ids", "n_a", "n_b", "n_groups", "digests", "link_ends", "links")
    out = slim.groupBy("block").cogroup(answers.withColumnRenamed("block", "asker").groupBy("asker")).applyInArrow(summed, schema)
    return out.withColumnRenamed(name, id_col) if name != id_col else out


def groups(docs: DataFrame, a_vocabulary: bytes, b_model: bytes, *, text_col: str = "text", groups_col: str = "groups") -> DataFrame:
    """`docs` with the aligned groups of each text, array<struct<a array<int>, b array<int>, start int, end int>>: ids of both and the UTF-8 bytes covered.

    Offsets count the space before the text as byte 0. Texts without tokens (see `link_counts`) have an empty array;
    a column of the same name, whatever its case, is an error.
    """
    if groups_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"a column {groups_col} is there already")
    files = docs.sparkSession.sparkContext.broadcast((a_vocabulary, b_model))
    kind = "array<struct<a: array<int>, b: array<int>, start: int, end: int>>"

    @F.pandas_udf(kind)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first, second = byte_level(files.value[0]), piece_level(files.value[1])
        for texts in batches:
            out = []
            for t in texts:
                x = align_text(t, first, second)
                ends = np.cumsum(first.sizes[x.a])[x.group_a - 1] if len(x.a) else _NONE
                at_a, at_b = np.concatenate([[0], x.group_a]), np.concatenate([[0], x.group_b])
                out.append([{"a": x.a[at_a[k] : at_a[k + 1]].tolist(), "b": x.b[at_b[k] : at_b[k + 1]].tolist(), "start": int(ends[k - 1]) if k else 0, "end": int(ends[k])} for k in range(len(ends))])
            yield pd.Series(out)

    return docs.withColumn(groups_col, cut(F.col(text_col).cast("string")))
