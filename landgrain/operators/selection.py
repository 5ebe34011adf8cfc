"""Exact quantiles and ranks of large groups: rows are dealt to ranges of their order, ranges are counted, and only what
needs an order within a range is sorted there. No group, and no heaped value, is one task's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrain.operators.components import checkpointed


def ranged(df: DataFrame, order: list[str], out: str = "_range") -> DataFrame:
    """``df`` with the number of each row's range of ``order``: later ranges hold later rows. Ranges come from a sample of the
    order, so the result is a checkpoint: computed again, a row might change its range."""
    return checkpointed(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id()))


def joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which NULL keys meet."""
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys), F.lit(True))
    return a.join(b, on).drop(*(f"_r_{k}" for k in keys))


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], out: str = "quantiles") -> DataFrame:
    """(keys..., ``out``): the exact quantiles at ``at`` of each key's values, interpolated as ``percentile`` does.

    Equal values are counted first; per key the ranges' counts tell which ranges hold the two ranks of a quantile, and
    only those are put in order. NULL values do not count; a key without values has no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    rows = ranged(counts, [*keys, "_v"])
    w = Window.partitionBy(*keys)
    sizes = rows.groupBy(*keys, "_range").agg(F.sum("_n").alias("_s"))  # a row per key and range
    before = F.coalesce(F.sum("_s").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_range", before.alias("_before"), "_s", F.sum("_s").over(w).alias("_all"))
    q = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(x)).alias("q")) for k, x in enumerate(at))))
    place = F.col("q.q") * (F.col("_all") - 1)
    ranks = sizes.withColumn("q", q).withColumn("_place", place).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))))
    ranks = ranks.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_s")))
    ranks = checkpointed(ranks.select(*keys, "_range", "_before", F.col("q.k").alias("_k"), "_place", "_rank"))
    held = ranks.select(*keys, "_range", "_before").distinct()
    to = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v")) + F.col("_before")
    ordered = joined(rows, held, [*keys, "_range"]).withColumn("_to", to)
    found = joined(ranks.drop("_before"), ordered.drop("_before"), [*keys, "_range"]).where((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_n")))
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    part = F.max("_place") - F.floor(F.max("_place"))
    each = found.groupBy(*keys, "_k").agg((low * (1 - part) + high * part).alias("_v"))
    ends = F.array_sort(F.collect_list(F.struct("_k", "_v")))  # as many as ``at`` has
    return each.groupBy(*keys).agg(ends.alias("_q")).select(*keys, F.col("_q._v").alias(out))


def medians(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys..., ``out``): exact medians of groups of any size."""
    return quantiles(df, keys, value, [0.5], "_m").select(*keys, F.get("_m", F.lit(0)).alias(out))


def ranked(df: DataFrame, order: list[str], out: str) -> tuple[DataFrame, Column]:
    """(``df`` with each row's number from 0 in ``order``, the column of the number of rows). NULLs come first; rows equal in all
    of ``order`` get neighbouring numbers."""
    rows = ranged(df, order)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_s"))  # a row per range
    before = F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_all"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return rows.join(F.broadcast(sizes), "_range").withColumn(out, number).drop("_range", "_before"), F.col("_all")
