"""The driver's tables in the roles that the operators expect, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrain.functions.exprs import divided, month_label, quarter_label

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {CTES} {sql}"
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded sales: ``lineitem`` with price, area, date, rooms, building, block and apartment."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    dt = F.col("l_shipdate").cast("date")
    return l.select(
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("rooms"),
        F.col("l_partkey").alias("bld"),
        F.col("l_suppkey").alias("block"),
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("apt"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("area"),
        dt.alias("dt"),
        F.year(dt).alias("y"),
        month_label(dt).alias("ym"),
        quarter_label(dt).alias("yq"),
        divided("l_extendedprice", "l_quantity").alias("ppm"),
    )


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimation sample: plausible area, price and price per metre. (order, line, building, date, price) is unique,
    or one row of equals stays."""
    keys = ["ok", "rooms", "bld", "dt", "price"]
    d = deals(spark, sf_dir).where("area between 2 and 48 and price >= 1500 and ppm between 900 and 5000")
    return d.dropDuplicates([*keys, "area", "block"])


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, city, district): the area hierarchy from supplier, nation and region."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    out = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
    return out.select(F.col("s_suppkey").alias("block"), F.col("n_name").alias("city"), F.col("r_name").alias("district"))


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dwelling register from ``part``: floors, street, a building year with heaping and gaps, a point in metres."""
    k = F.col("p_partkey")
    raw = F.lit(1930) + (k * 37) % 90
    built = F.when(k % 10 == 9, None).when(k % 4 == 0, 5 * F.floor(raw / 5)).otherwise(raw).cast("int")
    return table(spark, sf_dir, "part").select(
        k.alias("bld"),
        F.col("p_size").alias("floors"),
        F.col("p_name").alias("street"),
        F.col("p_type").alias("kind"),
        F.col("p_brand").alias("brand"),
        built.alias("built"),
        ((k * 7919) % 10007).cast("double").alias("x"),
        ((k * 104729) % 10009).cast("double").alias("y"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, value): the monthly price index from order totals."""
    from landgrain.sources.tables import monthly_series

    return monthly_series(table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date"), "o_totalprice")


#: The same tables in SQL.
CTES = """
deals AS (
  SELECT l_orderkey AS ok, l_linenumber AS rooms, l_partkey AS bld, l_suppkey AS block,
    l_partkey * 1000000 + l_suppkey AS apt, l_extendedprice AS price, l_quantity AS area,
    CAST(l_shipdate AS DATE) AS dt, CAST(year(l_shipdate) AS INTEGER) AS y, strftime(l_shipdate, '%Y-%m') AS ym,
    year(l_shipdate) || 'Q' || quarter(l_shipdate) AS yq, l_extendedprice / nullif(l_quantity, 0) AS ppm
  FROM lineitem),
a AS (
  SELECT DISTINCT * FROM deals WHERE area BETWEEN 2 AND 48 AND price >= 1500 AND ppm BETWEEN 900 AND 5000),
places AS (
  SELECT s_suppkey AS block, n_name AS city, r_name AS district
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
reg AS (
  SELECT p_partkey AS bld, p_size AS floors, p_name AS street, p_type AS kind, p_brand AS brand,
    CAST(CASE WHEN p_partkey % 10 = 9 THEN NULL WHEN p_partkey % 4 = 0 THEN 5 * ((1930 + (p_partkey * 37) % 90) // 5)
      ELSE 1930 + (p_partkey * 37) % 90 END AS INTEGER) AS built,
    CAST((p_partkey * 7919) % 10007 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 10009 AS DOUBLE) AS y
  FROM part),
prices AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS value FROM orders GROUP BY 1)
"""
