from pyspark.sql import functions as F

from landgrain.streaming import monthly


def test_monthly_counts(spark, tmp_path):
    rows = [("1998-01-02 00:00:00", 1), ("1998-01-02 00:00:00", 1), ("1998-01-20 00:00:00", 2), ("1998-02-03 00:00:00", 3)]
    src = spark.createDataFrame(rows, "t string, k int").select(F.col("t").cast("timestamp").alias("t"), "k")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    out = monthly.deals_per_month(monthly.deduplicated(stream, "t", ["k"]), "t", None)
    q = out.writeStream.format("memory").queryName("months").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.month, r.n) for r in spark.sql("SELECT month, n FROM months").collect())
    assert q.exception() is None and got == [("1998-01", 2), ("1998-02", 1)]
