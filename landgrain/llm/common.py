"""Shared helpers: stage tables in the shared folder, gapless numbering, size-checked broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
#: Spark's own setting by which a query's shuffle files go when the query has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's ``spark.checkpoint.dir`` names it.

    Where it is unset, a local session (as in tests) gets a temporary folder; on a cluster that is an error.
    """
    path = spark.conf.get(CHECKPOINT, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="landgrain-")
        spark.conf.set(CHECKPOINT, path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table of the shared folder and read again: its lineage ends there, and its
    shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_broadcast(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """A broadcast hint only if the counted ``rows`` are at most ``most``; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df


def bucket_of(n: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int = 1024) -> DataFrame:
    """Gapless numbers from 0 within each combination of ``keys`` without sorting a whole key in one task.

    Rows are dealt into hash buckets of ``order``; a bucket starts where the counts of the buckets before it end.
    ``keys`` must not be null. Rows equal in all ``order`` columns get neighbouring numbers in any order.
    ``df`` is read twice, so pass a stage table.
    """
    dealt = df.withColumn("_bucket", bucket_of(buckets, *order))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        dealt.withColumn("_at", F.row_number().over(within) - 1)
        .join(starts, [*keys, "_bucket"])
        .withColumn(out, F.col("_start") + F.col("_at"))
        .drop("_bucket", "_at", "_start")
    )


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node reachable over the undirected ``pairs`` (a, b).

    Alternates large-star and small-star joins until the edge set stands still, so that chains shrink
    geometrically; every round ends in a stage table. Hubs are aggregated with partial minima.
    """
    edges = staged(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges"
    )
    # Few edges go through few tasks: a part holds a quarter of a million.
    parts = 1 + edges.count() // 250_000
    edges, state = edges.coalesce(parts), None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .coalesce(parts)
            .distinct()
            .coalesce(parts)
        )
        edges = staged(small, "edges").coalesce(parts)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
