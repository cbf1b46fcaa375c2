"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the session names in spark.checkpoint.dir; only a local session has a temporary one without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute `df` once into the shared checkpoint folder, so that its rows survive a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as a Parquet table, of which later reads take only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_table(df: DataFrame) -> None:
    """Delete the files of a table that `stored` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or that with as many _ as no column of `df` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, parts: int = 1024) -> DataFrame:
    """Each of `rows` with its group's row; `groups` has one for each key, and in `n` the number of its rows.

    Groups of more than 1/parts of all rows are fewer than `parts`: they are broadcast, so that no frequent key is
    dealt to one task; all others are joined by shuffle. `groups` is read several times, so it should be computed.
    """
    whole = groups.agg(F.sum(n)).first()[0] or 0
    frequent = F.col(n) > max(16, whole // parts)
    often = F.broadcast(groups.where(frequent))
    rare = rows.join(often.select(*keys), keys, "left_anti").join(groups.where(~frequent), keys)
    return rows.join(often, keys).unionByName(rare)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fraction_of(*parts: Column) -> Column:
    """A uniform number in [0, 1) that only the given columns decide: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 13), 16, 10).cast(
        "double"
    ) / F.lit(float(2**52))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Components of an undirected graph of long ids: (node, component), component the smallest node of each.

    Large-star and small-star contraction: every round hangs a node's larger neighbours, then itself, on the
    smallest neighbour, until the links form stars. Minima are pre-aggregated before each shuffle and joined
    back to the links, so no node's neighbours are gathered in one place; each round is cut by a checkpoint
    and only its number of links and a checksum reach the driver. Self links and repeated links are ignored;
    nodes without a link to another are not in the result; no links give an empty result.
    """
    links = checkpointed(
        edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where("u <> v").distinct()
    )
    seen = None
    while (now := _signature(links)) != seen and now[0]:
        seen = now
        links = checkpointed(_small_star(_large_star(links)))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Takes and returns links with u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    hung = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
