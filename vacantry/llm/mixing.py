"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fraction_of, free_name, shuffle_partitions

OTHER = "\x00other"
#: The largest rate that one number inverts; a larger one is the sum of as many equal smaller ones as it takes.
RATE = 64.0
#: Copies that one row makes at once.
BLOCK = 4096


def poisson_cdf(rate: float) -> list[float]:
    """Probabilities of at most 0, 1, 2, ...: the count is the number of these that a uniform number reaches. For rates up to RATE.

    Above the largest listed count lies less than 2**-53 of the distribution.
    """
    if rate <= 0:
        return []
    k, p = 0, math.exp(-rate)
    total, steps = p, [p]
    while k < rate + 12 * math.sqrt(rate) + 40:
        k += 1
        p = p * rate / k
        total += p
        if total == steps[-1]:
            break
        steps.append(total)
    return steps


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    *,
    by: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    other: float = 0.0,
    total: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Repeat documents so that each source's share of the text follows `weights`, in globally random order.

    A source with weight w (of the sum of the weights of the sources that are there) and S characters gets the
    mean repetition rate w * total / S; `total` is the number of characters wanted, by default as many as there
    are. Each row draws its number of copies by inverting the Poisson distribution of that rate at a uniform
    number hashed from (seed, id) (a rate above RATE as the sum of several draws), is exploded by it, and all
    copies are dealt to partitions and sorted by a hash of (seed, id, copy). Sources that `weights` does not name, and null ones, share the weight `other`.

    Returns the columns of `docs` and mix_copy (1, 2, ...), mix_copies, mix_order (in [0, 1), the place in the
    global order); columns of `docs` with these names are replaced. A null id draws like any one id; rows with
    equal ids draw equal counts; null and empty texts have no characters, so a source that holds nothing else
    has rate 0. An empty table gives an empty result. Only one number for each named source reaches the driver.
    """
    if not weights or any(w < 0 or not math.isfinite(w) for w in [*weights.values(), other]):
        raise ValueError("weights must be finite and not negative")
    group = _group(docs[by], weights)
    sizes = {
        r["g"]: r["n"]
        for r in docs.groupBy(group.alias("g")).agg(F.sum(F.coalesce(F.char_length(F.col(text_col)), F.lit(0))).alias("n")).collect()
        if r["n"]
    }
    shares = {g: weights.get(g, other) for g in sizes}
    whole, wanted = sum(shares[g] for g in sorted(shares)), sum(sizes.values()) if total is None else total
    copies = F.lit(0)
    for g in sorted(sizes):
        rate = shares[g] / whole * wanted / sizes[g] if whole else 0.0
        parts = max(1, math.ceil(rate / RATE))
        if steps := poisson_cdf(rate / parts):
            ladder = F.array(*[F.lit(x) for x in steps])
            copies = F.when(group == F.lit(g), _drawn(ladder, parts, seed, docs[id_col])).otherwise(copies)
    n, block = shuffle_partitions(docs.sparkSession), free_name(docs, "__block")
    out = docs.withColumn("mix_copies", copies).where("mix_copies > 0")
    out = out.withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((F.col("mix_copies") - 1) / BLOCK).cast("int"))))
    ends = F.least(F.col("mix_copies"), (F.col(block) + 1) * BLOCK)
    out = out.withColumn("mix_copy", F.explode(F.sequence(F.col(block) * BLOCK + 1, ends))).drop(block)
    out = out.withColumn("mix_order", fraction_of(F.lit(seed), F.col(id_col), F.col("mix_copy")))
    dealt = out.repartitionById(n, F.floor(F.col("mix_order") * n).cast("int"))
    return dealt.sortWithinPartitions("mix_order")


def _drawn(ladder: Column, parts: int, seed: int, of: Column) -> Column:
    """The number of steps reached by a uniform number of the row, or, added up, by one of each of its parts."""
    reached = lambda u: F.size(F.filter(ladder, lambda x: x <= u))
    if parts == 1:
        return reached(fraction_of(F.lit(seed), of))
    return F.aggregate(F.sequence(F.lit(1), F.lit(parts)), F.lit(0), lambda sum, k: sum + reached(fraction_of(F.lit(seed), of, F.lit("part"), k)))


def _group(source: Column, weights: dict[str, float]) -> Column:
    return F.when(source.cast("string").isin(*weights), source.cast("string")).otherwise(F.lit(OTHER))
