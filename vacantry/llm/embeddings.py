"""Near-duplicate vectors by an exact metric range join over pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, join_groups
from .simhash import union

#: Vectors of one side of a comparison in one task, at most.
TILE = 2048
#: Rounding of distances that the triangle bounds allow for.
SLACK = 1e-9


def unit(batch: list) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = np.array([np.asarray(v, np.float64) for v in batch]).reshape(len(batch), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of huge or tiny components leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before it."""
    if not len(sample):
        return sample
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < most and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def usable(vector: str, label: str) -> Column:
    """Not null, not empty, not all zero, all components finite, and a label."""
    x = F.col(vector)
    return F.coalesce(
        F.col(label).isNotNull()
        & F.forall(x, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce(c, F.lit(0.0))))
        & F.exists(x, lambda c: c != 0),
        F.lit(False),
    )


def _tables(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows; and the distinct usable vectors of each label and length, with smallest id and number of rows."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable("x", "label"))
    distinct = rows.where("ok").groupBy("label", "x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return rows, checkpointed(distinct.withColumn("row", F.monotonically_increasing_id()))


def _pair_cells(distinct: DataFrame, radius: float, pivots: int, sample: int) -> DataFrame:
    """Each vector at home in the cell of its nearest pivot, and as a visitor in the later cells that may hold a partner.

    A label (and length) with more than TILE vectors has pivots of its own, one for each TILE of them, `pivots` at
    most; of such labels the sample // pivots largest, so that there are no more than `sample` pivots in all. The
    others are one cell each. A partner y at home with pivot j has d(x, p_j) <= d(x, p_i) + 2 r, as p_j is its
    nearest, and d(x, p_j) <= R_j + r, where R_j is the largest distance of a vector at home there.
    """
    spark = distinct.sparkSession
    sized = distinct.groupBy("label", F.size("x").alias("k")).agg(F.count(F.lit(1)).alias("in_label")).where(F.col("in_label") > TILE)
    large = checkpointed(sized.orderBy(F.desc("in_label"), F.xxhash64("label", "k")).limit(max(1, sample // pivots)).withColumn("g", F.monotonically_increasing_id()))
    marked = distinct.withColumn("k", F.size("x")).join(F.broadcast(large), ["label", "k"], "left")
    each = sample // max(1, large.count())
    some = marked.where("g is not null").where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(float(each << 20)) / F.col("in_label"))
    drawn: dict[int, list] = {}
    for r in some.select("g", "x", "in_label", F.xxhash64("row").alias("o")).orderBy("o").limit(2 * sample).collect():
        drawn.setdefault(r["g"], []).append((r["x"], r["in_label"]))
    chosen = spark.sparkContext.broadcast({g: choose_pivots(unit([x for x, _ in v]), min(pivots, -(-v[0][1] // TILE))) for g, v in drawn.items()})

    def distances(xs: list, gs: list) -> list[np.ndarray]:
        """For each vector its distances to the pivots of its label; one cell, at distance 0, where there are none."""
        out: list = [np.zeros(1)] * len(xs)
        of = np.array([-1 if g is None else g for g in gs], np.int64)
        for g in np.unique(of):
            if (p := chosen.value.get(int(g))) is not None:
                at = np.flatnonzero(of == g)
                for i, row in zip(at, np.sqrt(np.maximum(0, 2 - 2 * unit([xs[i] for i in at]) @ p.T)), strict=True):
                    out[i] = row
        return out

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ds = distances(list(b.column(0).to_numpy(zero_copy_only=False)), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([int(d.argmin()) for d in ds], pa.int32()), pa.array([float(d.min()) for d in ds])], ["g", "cell", "d"])

    reach = marked.where("g is not null").select("x", "g").mapInArrow(nearest, "g long, cell int, d double").groupBy("g", "cell").agg(F.max("d").alias("d"))
    radii = spark.sparkContext.broadcast({(r["g"], r["cell"]): r["d"] for r in reach.collect()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gs = b.column(2).to_pylist()
            row, cell, home = [], [], []
            for i, d in enumerate(distances(list(b.column(1).to_numpy(zero_copy_only=False)), gs)):
                own = int(d.argmin())
                for j in range(own, len(d)):
                    if j == own or d[j] <= d[own] + 2 * radius + SLACK and d[j] <= radii.value.get((gs[i], j), -math.inf) + radius + SLACK:
                        row.append(i), cell.append(j), home.append(j == own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(cell, pa.int32()), pa.array(home, pa.bool_())], ["row", "cell", "home"])

    return marked.select("row", "x", "g").mapInArrow(place, "row long, cell int, home boolean")


def near_vectors(
    df: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.93,
    pivots: int = 16,
    sample: int = 4096,
) -> DataFrame:
    """One row for each row of `df`: id, n_links, component_id, kept.

    Vectors of equal, non-null labels link if their cosine, in double precision, is at least `cosine`; for unit
    vectors that is a distance of at most r = sqrt(2 - 2 cosine). Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, nor do vectors of different lengths. Equal vectors of a label
    are compared once, with their number. n_links counts the other rows linked directly, component_id is the
    smallest id reachable, kept tells whether that is the row itself. A null id counts for no smallest id, and a
    row of a null id is kept only if it has no link to a row with an id. Extra columns are ignored; an empty table
    gives an empty result.

    Large labels have pivots of their own (see _pair_cells), chosen from about `sample` vectors in all. Each label's
    cell is compared in tiles of at most TILE vectors a side; a tile returns numbers of links and a spanning forest,
    never its pairs.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows, distinct = _tables(df, id_col, vector_col, label_col)
    placed = checkpointed(_pair_cells(distinct, radius, pivots, sample).join(distinct.select("row", "label", "x", "n"), "row").withColumn("k", F.size("x")))
    sizes = placed.groupBy("label", "k", "cell").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.sum((~F.col("home")).cast("int")).alias("visits"))
    tiles = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(TILE))).cast("int")
    sized = placed.join(sizes.select("label", "k", "cell", tiles("homes").alias("h"), tiles("visits").alias("v"), "visits"), ["label", "k", "cell"])
    sized = sized.withColumn("own", F.pmod(F.xxhash64("row"), F.when(F.col("home"), F.col("h")).otherwise(F.col("v"))).cast("int"))
    own, homes = F.col("own"), F.sequence(F.lit(0), F.col("h") - 1)
    visits = F.when(F.col("visits") > 0, F.sequence(F.lit(0), F.col("v") - 1)).otherwise(F.array().cast("array<int>"))
    at_home = F.concat(
        _in_tiles("homes", "left", own, F.filter(homes, lambda y: y >= F.col("own"))),
        _in_tiles("homes", "right", own, F.filter(homes, lambda y: y < F.col("own"))),
        _in_tiles("visits", "left", own, visits),
    )
    dealt = sized.withColumn("to", F.explode(F.when(F.col("home"), at_home).otherwise(_in_tiles("visits", "right", own, homes))))
    dealt = dealt.select("label", "k", "cell", "to.*", "row", "n", "x")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return _tile(group, cosine)

    found = checkpointed(dealt.groupBy("label", "k", "cell", "kind", "a", "b").applyInPandas(compare, "u long, links long, v long"))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("v is not null"), "u", "v").select(F.col("node").alias("u"), "component")
    groups = distinct.join(links, distinct["row"] == links["u"], "left").drop("u")
    groups = checkpointed(groups.join(parts, groups["row"] == parts["u"], "left").select("label", "x", "id", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "row").alias("component")))
    smallest = groups.groupBy("component").agg(F.min("id").alias("smallest"))
    groups = checkpointed(groups.join(smallest, "component").select("label", "x", "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "smallest"))
    linked = join_groups(rows.where("ok"), groups, ["label", "x"], "n")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("smallest"))
    out = linked.select("id", "n_links", "smallest").unionAll(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("smallest").alias("component_id"), F.col("id").eqNullSafe(F.col("smallest")).alias("kept"))


def _in_tiles(kind: str, side: str, own: Column, others: Column) -> Column:
    """The tiles (kind, a, b) that a vector of part `own` is in, on one side, with each of the parts on the other."""
    return F.transform(
        others,
        lambda y: F.struct(
            F.lit(kind).alias("kind"), (own if side == "left" else y).alias("a"), (y if side == "left" else own).alias("b"), F.lit(side).alias("side")
        ),
    )


def _tile(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one tile: of each vector how many rows it links to, and a root for those linked.

    A tile of kind homes with a = b compares its left vectors with one another; any other its left with its right.
    """
    left = (group["side"] == "left").to_numpy()
    within = group["kind"].iloc[0] == "homes" and group["a"].iloc[0] == group["b"].iloc[0]
    if not left.any() or (not within and left.all()):
        return pd.DataFrame({"u": [], "links": [], "v": []}, dtype="int64")
    x, n, row = unit(list(group["x"])), group["n"].to_numpy(np.int64), group["row"].to_numpy(np.int64)
    order = np.argsort(row)
    x, n, row, left = x[order], n[order], row[order], left[order]
    own = np.flatnonzero(left)
    other = own if within else np.flatnonzero(~left)
    near = x[own] @ x[other].T >= cosine
    if within:
        np.fill_diagonal(near, False)
    links, parent = np.zeros(len(row), np.int64), np.arange(len(row))
    links[own] += near @ n[other]
    if not within:
        links[other] += n[own] @ near
    i, j = np.nonzero(near)
    parent = union(parent, own[i], other[j])
    on = links > 0
    return pd.DataFrame({"u": row[on], "links": links[on], "v": row[parent[on]]})
