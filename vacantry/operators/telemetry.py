"""Windowed measures over event rows and scraped series; all but the running ones take a stream as well."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..session import stored

#: How late an event may be in a stream; the source has no rule for late data.
LATENESS = "10 minutes"


def watermarked(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Events up to LATENESS late count, later ones are dropped; batches are whole as they are."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, LATENESS) if df.isStreaming else df


def rate(df: DataFrame, by: list[str], *, ts: str = "ts", win: str = "5 minutes", slide: str = "1 minute", seconds: int = 300) -> DataFrame:
    """Events a second by name, over a sliding range."""
    w = watermarked(df, ts).groupBy(F.window(ts, win, slide), *by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.end").alias("at"), *by, "n", (F.col("n") / F.lit(seconds)).alias("per_second"))


def counter_increase(df: DataFrame, by: list[str], *, ts: str = "ts", value: str = "value", seq: str = "event_id") -> DataFrame:
    """What a cumulative counter rose by since its last sample, by ts and then seq; a fall is a reset, after which it rose from zero."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(ts, seq))
    rose = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return df.withColumn("increase", rose.cast("double"))


def p95(df: DataFrame, by: list[str], *, value: str = "value", ts: str = "ts", win: str = "5 minutes", slide: str = "5 minutes", exact: bool = False) -> DataFrame:
    """The 95th percentile by name over a range: approximate in bounded memory, or `exact`, interpolated, which holds a range's different values."""
    q = F.percentile(value, F.lit(0.95)) if exact else F.percentile_approx(value, F.lit(0.95))
    w = watermarked(df, ts).groupBy(F.window(ts, win, slide), *by).agg(q.alias("p95"))
    return w.select(F.col("window.end").alias("at"), *by, "p95")


#: Values that a quantile sketch holds about; its rank error is about 1.6 / SKETCH (0.04 %) with 99 % confidence, and none up to SKETCH values.
SKETCH = 4096


def quantile_states(df: DataFrame, by: list[str], *, value: str = "value", ts: str = "ts", win: str = "5 minutes") -> DataFrame:
    """(start, at, by, sketch): a mergeable sketch of the values by name in each range, of bounded size; null values do not count."""
    w = watermarked(df, ts).groupBy(F.window(ts, win), *by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH)).alias("sketch"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("at"), *by, "sketch")


def merge_states(states: DataFrame, by: list[str], *, win: str = "1 hour") -> DataFrame:
    """Sketches of short ranges merged to those of longer ones, without the values; a range counts where it starts."""
    w = states.groupBy(F.window("start", win), *by).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("at"), *by, "sketch")


def quantiles(states: DataFrame, by: list[str], qs: dict[str, float]) -> DataFrame:
    """(at, by, n, a column for each of `qs`): the number of values, and the smallest one that has that share of them at or below it; null without values."""
    n = F.kll_sketch_get_n_double("sketch")
    found = [F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(name) for name, q in qs.items()]
    return states.select("at", *by, n.alias("n"), *found)


#: How far from a share the sketches' bounds of its quantile lie; five times their rank error.
SLACK = 0.002


def exact_quantiles(df: DataFrame, states: DataFrame, by: list[str], qs: dict[str, float], *, value: str = "value", ts: str = "ts", win: str = "1 day") -> DataFrame:
    """As `quantiles` of the `states` of `df` in ranges `win`, but exact.

    A quantile lies between two values that the sketch names, so only values between these are ranked. Where the counts
    show that it does not, all values of its range are. NaN is the greatest value.
    """
    own = ["start", "at", *by]
    w, v = F.window(ts, win), F.col("v")
    each = df.select(w.alias("w"), *by, F.col(value).cast("double").alias("v")).select(F.col("w.start").alias("start"), F.col("w.end").alias("at"), *by, "v")
    some = F.kll_sketch_get_n_double("sketch") > 0
    near = lambda q: F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, q)))))
    asked = [F.struct(F.lit(name).alias("__of"), F.lit(Decimal(str(q))).cast("decimal(18,17)").alias("q"), near(q - SLACK).alias("low"), near(q + SLACK).alias("high")) for name, q in qs.items()]
    bounds = stored(states.select(*own, F.inline(F.array(*asked))))

    def met(bounds: DataFrame) -> DataFrame:
        b = bounds.select(*[F.col(x).alias(f"__{x}") for x in own], *[x for x in bounds.columns if x not in own])
        alike = [F.col(x).eqNullSafe(F.col(f"__{x}")) for x in own]
        return each.join(b, alike).drop(*[f"__{x}" for x in own])

    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = met(bounds).groupBy(*own, "__of", "q", "low", "high").agg(F.count("v").alias("n"), count(v < F.col("low")).alias("below"), count(v <= F.col("high")).alias("upto"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("n").cast("decimal(20,0)") * F.col("q")).cast("long"))
    counts = counts.withColumn("rank", rank).withColumn("between", F.coalesce((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("upto")), F.lit(False)))
    counts = stored(counts.withColumn("before", F.when(F.col("between"), F.col("below")).otherwise(0)))
    near_it = v.isNotNull() & (~F.col("between") | v.between(F.col("low"), F.col("high")))
    values = met(counts).where(near_it).groupBy(*own, "__of", "rank", "before", "v").agg(F.count(F.lit(1)).alias("times"))
    upto = F.col("before") + F.sum("times").over(Window.partitionBy(*own, "__of").orderBy("v"))
    found = values.withColumn("upto", upto).where(F.col("upto") >= F.col("rank")).groupBy(*own, "__of").agg(F.min("v").alias("v"))
    both = found.unionByName(counts.select(*own, "__of", "n"), allowMissingColumns=True)
    return both.groupBy(*own).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.max(F.when(F.col("__of") == name, v)).alias(name) for name in qs]).drop("start")


def histogram_quantile(df: DataFrame, by: list[str], *, q: float = 0.95, le: str = "le", count: str = "n") -> DataFrame:
    """A quantile from cumulative buckets (upper bound, count so far), interpolated within the bucket that it falls in.

    In the last, unbounded bucket it is that bucket's lower bound.
    """
    own = Window.partitionBy(*by).orderBy(le)
    each = df.withColumns({"__low": F.coalesce(F.lag(le).over(own), F.lit(0.0)), "__before": F.coalesce(F.lag(count).over(own), F.lit(0))})
    total = F.max(count).over(Window.partitionBy(*by))
    each = each.withColumn("__rank", F.lit(q) * total).where(F.col(count) >= F.col("__rank"))
    first = each.groupBy(*by).agg(F.min_by(F.struct(le, "__low", "__before", count, "__rank"), le).alias("b"))
    b = F.col("b")
    inside = b["__low"] + (b[le] - b["__low"]) * (b["__rank"] - b["__before"]) / F.nullif(b[count] - b["__before"], F.lit(0))
    return first.select(*by, F.when(b[le] == float("inf"), b["__low"]).otherwise(inside).alias("quantile"))


def backlog(df: DataFrame, *, sent: Column, received: Column, by: list[str] | None = None) -> DataFrame:
    """What was sent and not received, in all or by name."""
    grouped = df.groupBy(*(by or []))
    return grouped.agg(F.sum(F.when(sent, 1).when(received, -1).otherwise(0)).cast("long").alias("backlog"))


def running_backlog(df: DataFrame, *, sent: Column, received: Column, by: list[str], ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """The backlog after each event, by name."""
    step = F.when(sent, 1).when(received, -1).otherwise(0)
    own = Window.partitionBy(*by).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("backlog", F.sum(step).over(own).cast("long"))


def error_rate(df: DataFrame, by: list[str], *, status: str = "status", **kw) -> DataFrame:
    """Events a second whose status is 5 and two more characters."""
    return rate(df.where(F.col(status).cast("string").rlike("^5..$")), by, **kw)


def gauge_last(df: DataFrame, by: list[str], *, value: str = "value", ts: str = "ts", seq: str = "event_id", win: str = "5 minutes") -> DataFrame:
    """The last value by name in each range, by ts and then seq."""
    w = watermarked(df, ts).groupBy(F.window(ts, win), *by).agg(F.max_by(value, F.struct(ts, seq)).alias("last"))
    return w.select(F.col("window.end").alias("at"), *by, "last")


def gauge_sum(df: DataFrame, by: list[str], *, over: list[str], **kw) -> DataFrame:
    """The sum over names `over` of the last values of each range, by `by`."""
    return gauge_last(df, [*by, *over], **kw).groupBy("at", *by).agg(F.sum("last").alias("total"))


def relabel(df: DataFrame, label: str = "container") -> DataFrame:
    """Container names without their leading slash; a name without one becomes ''."""
    return df.withColumn(label, F.regexp_extract(label, "^/(.*)$", 1))


def debounce(df: DataFrame, key: str, *, ts: str = "ts", seq: str | None = None, gap: str = "10 seconds", payload: str | None = None) -> DataFrame:
    """Of saves of a key less than `gap` apart only the last counts: key, its time and, if named, its payload.

    Each save starts the wait anew. On a stream sessions are emitted once the watermark is past their end.
    """
    aggs = [F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")]
    if payload:
        aggs.append(F.max_by(payload, F.struct(ts, seq) if seq else F.col(ts)).alias(payload))
    w = watermarked(df, ts).groupBy(key, F.session_window(ts, gap)).agg(*aggs)
    return w.drop("session_window")


def debounce_batch(df: DataFrame, key: str, *, ts: str = "ts", seq: str = "event_id", seconds: int = 10) -> DataFrame:
    """The same for a table: rows that no save of their key follows within the gap."""
    following = F.lead(F.col(ts)).over(Window.partitionBy(key).orderBy(ts, seq))
    wait = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("__wait", wait).where(F.col("__wait").isNull() | (F.col("__wait") >= seconds * 1_000_000)).drop("__wait")


def settled(df: DataFrame, key: str, *, ts: str = "ts", seq: str = "seq", wait: int = 10, payload: str = "said") -> DataFrame:
    """Of a stream of saves: (key as text, payload, a text) of a key's last save, once `wait` seconds of the clock have passed without another.

    A key's state is its last save by ts, seq and payload (nulls are lowest), whatever order they arrive in; it goes
    when it is emitted. Rows without a key are left out.
    """

    def each(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            said = state.get[2]
            state.remove()
            yield pd.DataFrame({key: [group[0]], payload: [said]})
            return
        best = state.getOption
        for frame in frames:
            rows = zip(frame["__at"].tolist(), frame["__seq"].tolist(), frame["__said"].tolist(), strict=True)
            best = max(rows, default=best) if best is None else max([best, *rows])
        state.update(best)
        state.setTimeoutDuration(wait * 1000)

    low = F.lit(-(2**63))
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias(key), F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), low).alias("__at"), F.coalesce(F.col(seq).cast("long"), low).alias("__seq"), F.coalesce(F.col(payload), F.lit("")).alias("__said")
    )
    return rows.groupBy(key).applyInPandasWithState(each, f"`{key}` string, `{payload}` string", "at long, seq long, said string", "append", GroupStateTimeout.ProcessingTimeTimeout)
