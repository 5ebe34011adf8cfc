"""what batches of models write and shuffle."""

import os

from pyspark.sql import functions as F

from landgrain.operators import components as C
from landgrain.operators import fixed_effects as E


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_rows_of_models_are_kept_small(spark):
    """Before, a row of a batch took over 100 bytes on disk."""
    rows = spark.range(30_000).select((F.col("id") % 300).cast("string").alias("d0"), (F.col("id") % 7).cast("string").alias("d1"), F.rand(1).alias("y"))
    rows = rows.select(F.lit("a model with a name").alias("model"), "*", F.lit(1.0).alias("w"), F.lit(0.0).alias("t"), F.lit(0).alias("q"))
    before = size(C.shared_folder(spark).removeprefix("file://"))
    clean = spark.conf.get(C.CLEAN, None)
    out = C.kept(rows, "rows")
    assert out.dtypes == rows.dtypes and out.count() == 30_000
    assert size(C.shared_folder(spark).removeprefix("file://")) - before < 20 * 30_000
    assert spark.conf.get(C.CLEAN, None) == clean


def test_rows_stay_where_they_are(spark):
    """The few numbers of a fit and the means of models are sent to the rows; before, all rows were shuffled by level and by model."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(400).select(
            F.lit("m").alias("model"), (F.col("id") % 20).cast("string").alias("d0"), (F.col("id") % 7).cast("string").alias("d1"),
            F.sin("id").alias("y"), F.cos(F.col("id") * 3).alias("x0"), F.lit(1.0).alias("w"),
        )
        rows = E.centred(C.checkpointed(rows), ["y", "x0"], ["model"])
        assert abs(rows.agg(F.avg("y")).first()[0]) < 1e-12
        left = E.residualised(rows, ["y", "x0"], ["d0", "d1"], "w", group=["model"])
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2 and plan.count("SortMergeJoin") == 1
        worst = left.groupBy("d1").agg(F.abs(F.sum("r_y")).alias("s")).agg(F.max("s")).first()[0]
        assert worst < 1e-9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
