"""Near-duplicate texts by SimHash fingerprints and vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, free_name, join_groups, stored

SHINGLE_WORDS = 3
HASH_SEED = 42
BITS = 64
#: Fingerprints at home in one leaf that are compared in one task, at most, with WIDER times as many of all it holds; larger leaves are compared in tiles.
TILE, WIDER = 8192, 8


def fingerprint(text: str | None) -> int:
    """SimHash of a text: a bit is 1 if set in over half of the shingles' XXH64 values.

    A-Z are lower-cased, words are what ASCII white space separates, shingles are three words joined by a space,
    repeats included; fewer words make one shingle, none (or null) the fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)]
    else:
        digest, join, seed = xxhash.xxh64_intdigest, b" ".join, HASH_SEED
        hashes = [digest(join(s), seed) for s in zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)]
    h = np.array(hashes, "<u8")
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[part : part + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint's 64 bits as a signed long."""
    return _with_fingerprint(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")), "t", "fp").drop("t")


def _with_fingerprint(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """`docs` and a column `name`, the fingerprint of the whole text."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, of(F.col(text_col).cast("string")))


@dataclass(frozen=True)
class Tree:
    """A vantage-point tree over the bits of `mask`: inner node i parts values by their distance to vantage[i].

    Distance within a mask never exceeds the whole distance, so the triangle inequality holds for it: values at
    most `radius` apart within the mask have distances to a vantage point that differ by at most `radius`.
    """

    mask: int
    radius: int
    vantage: np.ndarray
    limit: np.ndarray
    near: np.ndarray  # a child's number; leaves are -1 - number
    far: np.ndarray

    def cells(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): each value's own leaf, and all leaves beyond a boundary that its ball reaches."""
        row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        if not len(self.vantage):
            node -= 1
        done = []
        while len(row):
            leaf = node < 0
            done.append((row[leaf], -1 - node[leaf], home[leaf]))
            row, node, home = row[~leaf], node[~leaf], home[~leaf]
            d = np.bitwise_count((fps[row] ^ self.vantage[node]) & np.uint64(self.mask)).astype(np.int64)
            m, own = self.limit[node], d <= self.limit[node]
            near, far = d <= m + self.radius, d > m - self.radius
            row, node, home = (
                np.concatenate([row[near], row[far]]),
                np.concatenate([self.near[node][near], self.far[node][far]]),
                np.concatenate([(home & own)[near], (home & ~own)[far]]),
            )
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (row, node, home)


def build_tree(sample: np.ndarray, mask: int, radius: int, leaf: int) -> Tree:
    """Split the sample at vantage points from within it until a leaf has at most `leaf` values or nothing parts them."""
    vantage, limit, kids, leaves = [], [], [], 0
    todo = [(sample, -1, 0)]
    while todo:
        values, parent, side = todo.pop()
        split = _split(values, mask, radius) if len(values) > leaf else None
        if split is None:
            number, leaves = -1 - leaves, leaves + 1
        else:
            number = len(vantage)
            v, m, d = split
            vantage.append(v)
            limit.append(m)
            kids.append([0, 0])
            todo += [(values[d <= m], number, 0), (values[d > m], number, 1)]
        if parent >= 0:
            kids[parent][side] = number
    kids = np.array(kids, np.int64).reshape(-1, 2)
    return Tree(mask, radius, np.array(vantage, np.uint64), np.array(limit, np.int64), kids[:, 0], kids[:, 1])


def _split(values: np.ndarray, mask: int, radius: int):
    """The vantage point and limit, among a few, whose boundary fewest values are near to, with a fifth on each side if possible."""
    best, n = None, len(values)
    for v in values[np.linspace(0, n - 1, min(n, 8)).astype(int)]:
        d = np.bitwise_count((values ^ v) & np.uint64(mask)).astype(np.int64)
        below = np.cumsum(np.bincount(d, minlength=BITS + 1))
        for m in range(int(d.min()), int(d.max())):
            left = below[m]
            twice = below[min(BITS, m + radius)] - (below[m - radius] if m >= radius else 0)
            cost = (min(left, n - left) * 5 < n, twice / n - min(left, n - left) / n)
            if best is None or cost < best[0]:
                best = (cost, v, m, d)
    return best and best[1:]


def forest(distance: int, trees: int, sample: np.ndarray, leaf: int) -> list[Tree]:
    """One tree for each of `trees` equal parts of the bits; values within `distance` are within distance // trees in one part."""
    edges = [round(i * BITS / trees) for i in range(trees + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [build_tree(sample, m, distance // trees, leaf) for m in masks]


def find_roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; a set's root is its smallest member."""
    while True:
        parent = find_roots(parent)
        x, y = parent[a], parent[b]
        on = x != y
        if not on.any():
            return parent
        a, b = a[on], b[on]
        np.minimum.at(parent, np.maximum(x[on], y[on]), np.minimum(x[on], y[on]))


def _leaf_links(fps: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Each value that has a link, with the root of its set, from comparing those at home with all."""
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order].view(np.uint64), np.flatnonzero(home[order])
    parent = np.arange(len(fps))
    block = max(1, (1 << 22) // max(1, len(fps)))
    for at in range(0, len(home), block):
        own = home[at : at + block]
        i, j = np.nonzero(np.bitwise_count(fps[own, None] ^ fps[None, :]) <= distance)
        parent = union(parent, own[i], j)
    linked = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[linked].view(np.int64), fps[parent[linked]].view(np.int64)


def links(distinct: DataFrame, *, distance: int = 2, trees: int = 1, leaf: int = 2048, sample: int = 32768) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints of column fp just as all pairs within `distance` do.

    The trees are built on the driver from at most `sample` fingerprints, an eighth of them at most, chosen by
    hash. One tree over all bits is asked with radius `distance`: every fingerprint goes to its own leaf and, as a
    visitor, to those leaves beyond a boundary that the triangle bound leaves open, a number that grows with about
    the square root of the number of leaves. Two that are near each other would visit each other's leaf, so only
    the leaves after one's own are visited. More trees have a part of the bits each and a smaller radius, as of two
    near values' parts one differs by no more than its share. Each leaf compares its own fingerprints with all it
    holds and returns a spanning forest of the pairs found, not the pairs. A leaf of more than TILE values at
    home, or WIDER times as many in all, is compared in tiles.
    """
    spark = distinct.sparkSession
    some = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(8)) == 0).orderBy(F.xxhash64("fp")).limit(sample)
    values = np.array([r[0] for r in some.collect()], np.int64).view(np.uint64)
    whole = distinct.count()
    small = max(8, int(leaf * len(values) / max(1, whole)))
    grown = spark.sparkContext.broadcast(forest(distance, trees, values, small))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for k, tree in enumerate(grown.value):
                row, cell, home = tree.cells(fps)
                own = np.zeros(len(fps), np.int64)
                own[row[home]] = cell[home]
                on = cell >= own[row]
                row, cell, home = row[on], cell[on], home[on]
                out = [pa.array(np.full(len(row), k, np.int32)), pa.array(cell.astype(np.int32)), pa.array(fps[row].view(np.int64)), pa.array(home)]
                yield pa.RecordBatch.from_arrays(out, ["tree", "cell", "fp", "home"])

    placed = checkpointed(distinct.select("fp").mapInArrow(place, "tree int, cell int, fp long, home boolean"))
    # at most one row for each leaf of the trees, whose number the sample bounds
    sizes = placed.groupBy("tree", "cell").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.count(F.lit(1)).alias("n"))
    many = lambda c, most: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(most))).cast("int")
    sizes = sizes.select("tree", "cell", many("homes", TILE).alias("h"), many("n", WIDER * TILE).alias("w"))
    part = lambda of: F.pmod(F.xxhash64("fp"), F.col(of)).cast("int")
    tiled = placed.join(F.broadcast(sizes), ["tree", "cell"]).withColumns({"own_h": part("h"), "own_w": part("w")})
    tile = lambda a, b, home: F.struct(a.alias("a"), b.alias("b"), home.alias("home"))
    held = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda a: tile(a, F.col("own_w"), F.col("home") & (a == F.col("own_h"))))
    others = F.filter(F.sequence(F.lit(0), F.col("w") - 1), lambda b: F.col("home") & (b != F.col("own_w")))
    asks = F.transform(others, lambda b: tile(F.col("own_h"), b, F.lit(True)))
    cells = tiled.select("tree", "cell", "fp", F.explode(F.concat(held, asks)).alias("to")).select("tree", "cell", "fp", "to.*")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        u, v = _leaf_links(group["fp"].to_numpy(np.int64), group["home"].to_numpy(bool), distance)
        return pd.DataFrame({"u": u, "v": v})

    return cells.groupBy("tree", "cell", "a", "b").applyInPandas(compare, "u long, v long")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, trees: int = 1) -> DataFrame:
    """One row for each row of `docs`: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Fingerprints link at `distance` or fewer differing bits; links are followed through, so a component may hold
    texts further apart. Equal texts have equal fingerprints and are compared once. Null and empty texts have the
    fingerprint zero, which links like any other. Null ids count for no component's smallest id. Extra columns are
    ignored; an empty table gives an empty result.
    """
    rows = checkpointed(fingerprints(docs, id_col=id_col, text_col=text_col).withColumn("row", F.lit(0).cast("long")))
    grouped = join_groups(rows.drop("row"), _components(rows, distance, trees), ["fp"], "n")
    return grouped.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def _components(rows: DataFrame, distance: int, trees: int) -> DataFrame:
    """(fp, n, first) of (id, row, fp) rows: how many rows have a fingerprint, and the first (no_id, id, row) of its component, a null id last."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    distinct = checkpointed(rows.groupBy("fp").agg(first, F.count(F.lit(1)).alias("n")))
    parts = connected_components(links(distinct, distance=distance, trees=trees))
    named = distinct.join(parts, distinct["fp"] == parts["node"])
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    linked = named.join(smallest, "component").select("fp", "smallest")
    return checkpointed(distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("smallest", "first").alias("first")))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, trees: int = 1) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, null ids last, and of equal ids the first as stored.

    Rows are decided on one by one, so every component keeps exactly one row even where ids are repeated or null.
    """
    row, fp = free_name(docs, "__row"), free_name(docs, "__fp")
    numbered = stored(_with_fingerprint(docs, text_col, fp).withColumn(row, F.monotonically_increasing_id()))
    rows = numbered.select(F.col(id_col).cast("long").alias("id"), F.col(row).alias("row"), F.col(fp).alias("fp"))
    kept = _components(rows, distance, trees).select(F.col("first.row").alias("__kept")).distinct()
    return numbered.join(kept, numbered[row] == kept["__kept"], "left_semi").drop(row, fp)
