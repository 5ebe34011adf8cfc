"""Queries over deals, register and hierarchy: cleaning, joins, aggregates, windows and stock value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrain.functions import exprs as X
from landgrain.operators import relational as R
from landgrain.operators import indices as I
from landgrain.plans.base import deals, places, prices, query, r6, register, sample, table
from landgrain.sources import tables as S


@query("SELECT y, count(*) AS n, round(sum(price), 2) AS price, round(avg(ppm), 6) AS ppm, CAST(min(dt) AS VARCHAR) AS first_day FROM a GROUP BY y")
def clean_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(spark, sf_dir).groupBy("y").agg(
        F.count("*").alias("n"), r6(F.sum("price"), 2).alias("price"), r6(F.avg("ppm")).alias("ppm"), F.min("dt").cast("string").alias("first_day")
    )


def block_stats(d: DataFrame) -> DataFrame:
    """Per block: recent median, two windows, counts, change and turnover windows."""
    within = lambda lo, hi: F.col("y").between(lo, hi)
    med = lambda c, cond: F.median(F.when(cond, F.col(c)))
    out = d.groupBy("block").agg(
        med("ppm", F.col("y") >= 2000).alias("ppm_r"), F.count_if(F.col("y") >= 2000).alias("n_r"),
        med("ppm", within(1996, 1997)).alias("ppm_a"), F.count_if(within(1996, 1997)).alias("n_a"),
        med("ppm", within(1999, 2000)).alias("ppm_b"), F.count_if(within(1999, 2000)).alias("n_b"),
        med("area", F.col("y") >= 1997).alias("area_med"),
    )
    return out.withColumn("change", X.divided("ppm_b", "ppm_a") - 1)


BLOCKS = """
bs AS (SELECT block, median(ppm) FILTER (WHERE y >= 2000) AS ppm_r, count(*) FILTER (WHERE y >= 2000) AS n_r,
  median(ppm) FILTER (WHERE y BETWEEN 1996 AND 1997) AS ppm_a, count(*) FILTER (WHERE y BETWEEN 1996 AND 1997) AS n_a,
  median(ppm) FILTER (WHERE y BETWEEN 1999 AND 2000) AS ppm_b, count(*) FILTER (WHERE y BETWEEN 1999 AND 2000) AS n_b,
  median(area) FILTER (WHERE y >= 1997) AS area_med FROM a GROUP BY block)
"""


@query(
    f"{', '}{BLOCKS} SELECT block, round(ppm_r, 6) AS ppm_r, n_r, round(ppm_a, 6) AS ppm_a, n_a, round(ppm_b, 6) AS ppm_b, n_b, "
    "round(area_med, 6) AS area_med, round(ppm_b / nullif(ppm_a, 0) - 1, 6) AS change FROM bs"
)
def block_price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = block_stats(sample(spark, sf_dir))
    return s.select("block", *(r6(c).alias(c) if c[0] in "pac" else F.col(c) for c in s.columns[1:]))


def unit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each register building with its block's place and a unit value by the fallback cascade: block price if it has
    five recent deals, else the city's; unit size of the building, block or city, else 25."""
    d, r, p = sample(spark, sf_dir), register(spark, sf_dir), places(spark, sf_dir)
    at = d.groupBy("bld").agg(F.min("block").alias("block"), F.count("*").alias("units"), F.median(F.when(F.col("y") >= 1997, F.col("area"))).alias("b_area"))
    blocks = block_stats(d).select("block", "ppm_r", "n_r", "area_med")
    city = d.join(p, "block").groupBy("city").agg(
        F.median(F.when(F.col("y") >= 2000, F.col("ppm"))).alias("c_ppm"), F.median(F.when(F.col("y") >= 1997, F.col("area"))).alias("c_area")
    )
    out = r.join(at, "bld").join(blocks, "block", "left").join(p, "block", "left").join(city, "city", "left")
    return out.select(
        "bld", "block", "city", "district", "units", "built", "floors",
        F.coalesce("b_area", "area_med", "c_area", F.lit(25.0)).alias("unit_m2"),
        F.coalesce(F.when(F.col("n_r") >= 5, F.col("ppm_r")), "c_ppm").alias("loc_ppm"),
    ).withColumn("unit_val", F.col("loc_ppm") * F.col("unit_m2"))


UNITS = f"""{BLOCKS},
ub AS (SELECT bld, min(block) AS block, count(*) AS units, median(area) FILTER (WHERE y >= 1997) AS b_area FROM a GROUP BY bld),
cp AS (SELECT city, median(ppm) FILTER (WHERE y >= 2000) AS c_ppm, median(area) FILTER (WHERE y >= 1997) AS c_area
  FROM a JOIN places USING (block) GROUP BY city),
uv AS (SELECT *, loc_ppm * unit_m2 AS unit_val FROM (
  SELECT bld, block, city, district, units, built, floors, coalesce(b_area, area_med, c_area, 25) AS unit_m2,
    coalesce(CASE WHEN n_r >= 5 THEN ppm_r END, c_ppm) AS loc_ppm
  FROM reg JOIN ub USING (bld) LEFT JOIN bs USING (block) LEFT JOIN places USING (block) LEFT JOIN cp USING (city)))
"""


@query(
    f", {UNITS}, t AS (SELECT sum(units * unit_val) / sum(units) AS pbar FROM uv WHERE unit_val IS NOT NULL) "
    "SELECT district, CAST(sum(units) AS BIGINT) AS units, round(sum(units * unit_val), 2) AS stock_value, "
    "round(sum(units * unit_val) / max(pbar), 4) AS effective, round(sum(units * unit_val) / sum(units) / max(pbar), 6) AS quality, "
    "round(median(loc_ppm), 6) AS ppm FROM uv, t WHERE unit_val IS NOT NULL AND district IS NOT NULL GROUP BY district"
)
def unit_value_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock value and effective supply by district."""
    u = unit_values(spark, sf_dir).where("unit_val is not null")
    mean = u.agg((F.sum(F.col("units") * F.col("unit_val")) / F.sum("units")).alias("pbar"))
    value = F.sum(F.col("units") * F.col("unit_val"))
    out = u.where("district is not null").crossJoin(F.broadcast(mean)).groupBy("district")
    return out.agg(
        F.sum("units").alias("units"), r6(value, 2).alias("stock_value"), r6(value / F.max("pbar"), 4).alias("effective"),
        r6(value / F.sum("units") / F.max("pbar")).alias("quality"), r6(F.median("loc_ppm")).alias("ppm"),
    )


@query(
    f", {UNITS} SELECT CAST(floor(built / 10) * 10 AS INTEGER) AS dec, CAST(sum(units) AS BIGINT) AS units, round(median(unit_m2), 6) AS m2, "
    "count(*) AS buildings, round(100.0 * count(*) FILTER (WHERE floors >= 9) / count(*), 6) AS high FROM uv "
    "WHERE built BETWEEN 1940 AND 2025 AND unit_val IS NOT NULL GROUP BY 1 HAVING sum(units) >= 10"
)
def stock_by_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit_values(spark, sf_dir).where("built between 1940 and 2025 and unit_val is not null")
    return u.groupBy(X.decade("built").alias("dec")).agg(
        F.sum("units").alias("units"), r6(F.median("unit_m2")).alias("m2"), F.count("*").alias("buildings"),
        r6(100.0 * X.divided(F.count_if(F.col("floors") >= 9), F.count("*"))).alias("high"),
    ).where("units >= 10")


@query(
    f", {UNITS}, old AS (SELECT * FROM uv WHERE built < 1980 AND floors <= 25), "
    "sc AS (SELECT c, m FROM (SELECT unnest([800, 1000, 1200]) AS c), (SELECT unnest([2.5, 3.0, 4.0]) AS m)) "
    "SELECT c, CAST(m AS DOUBLE) AS m, round(CAST(m AS DOUBLE) * c * 1.15 / (CAST(m AS DOUBLE) - 1), 4) AS threshold, "
    "CAST(coalesce(sum(units) FILTER (WHERE loc_ppm >= CAST(m AS DOUBLE) * c * 1.15 / (CAST(m AS DOUBLE) - 1)), 0) AS BIGINT) AS units, "
    "round(coalesce(sum(units * unit_m2 * ((CAST(m AS DOUBLE) - 1) * loc_ppm - CAST(m AS DOUBLE) * c * 1.15)) "
    "FILTER (WHERE loc_ppm >= CAST(m AS DOUBLE) * c * 1.15 / (CAST(m AS DOUBLE) - 1)), 0), 2) AS surplus FROM old, sc GROUP BY c, m"
)
def scenario_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renewal candidates whose price reaches the threshold m C 1.15 / (m - 1), with their surplus, per scenario."""
    old = unit_values(spark, sf_dir).where("built < 1980 and floors <= 25")
    s = R.scenarios(old, c=[800, 1000, 1200], m=[2.5, 3.0, 4.0])
    threshold = F.col("m") * F.col("c") * 1.15 / (F.col("m") - 1)
    yes = F.col("loc_ppm") >= threshold
    gain = F.col("units") * F.col("unit_m2") * ((F.col("m") - 1) * F.col("loc_ppm") - F.col("m") * F.col("c") * 1.15)
    return s.groupBy("c", "m").agg(
        r6(F.first(threshold), 4).alias("threshold"),
        F.coalesce(F.sum(F.when(yes, F.col("units"))), F.lit(0)).alias("units"),
        r6(F.coalesce(F.sum(F.when(yes, gain)), F.lit(0.0)), 2).alias("surplus"),
    )


@query(
    f", {BLOCKS}, u AS (SELECT block, city, ppm_b / ppm_a - 1 AS change, n_a + n_b AS n FROM bs JOIN places USING (block) WHERE n_a >= 3 AND n_b >= 3) "
    "SELECT city, round(median(change), 6) AS change, CAST(sum(n) AS BIGINT) AS n, count(*) AS blocks FROM u GROUP BY city HAVING sum(n) >= 20"
)
def change_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = block_stats(sample(spark, sf_dir)).where("n_a >= 3 and n_b >= 3").join(places(spark, sf_dir), "block")
    out = s.groupBy("city").agg(r6(F.median("change")).alias("change"), F.sum(F.col("n_a") + F.col("n_b")).alias("n"), F.count("*").alias("blocks"))
    return out.where("n >= 20")


@query(
    ", c AS (SELECT block, rooms, kind, count(*) AS n FROM a JOIN reg USING (bld) GROUP BY ALL) "
    "SELECT block, rooms, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, rooms, kind) AS r FROM c) WHERE r = 1"
)
def modal_unit_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.modal_rows(sample(spark, sf_dir).join(register(spark, sf_dir), "bld"), "block", ["rooms", "kind"])


@query(
    ", m AS (SELECT kind, street, count(*) AS n FROM reg GROUP BY ALL) "
    "SELECT kind, arg_min(street, (-n, street)) AS street FROM m GROUP BY kind"
)
def mode_street_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = register(spark, sf_dir).groupBy("kind", "street").agg(F.count("*").alias("n"))
    return n.groupBy("kind").agg(F.min_by("street", F.struct(-F.col("n"), "street")).alias("street"))


@query(
    ", w AS (SELECT bld, city, sum(area) AS w FROM a JOIN places USING (block) GROUP BY ALL) "
    "SELECT bld, city, round(w, 4) AS w FROM (SELECT *, row_number() OVER (PARTITION BY bld ORDER BY w DESC, city DESC) AS r FROM w) WHERE r = 1"
)
def majority_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(places(spark, sf_dir), "block")
    return R.majority(d, "bld", "city", "area").select("bld", "city", r6("w", 4).alias("w"))


@query(
    ", first AS (SELECT DISTINCT bld FROM a WHERE y <= 1998), extra AS (SELECT * FROM a WHERE y > 1998 AND bld NOT IN (SELECT bld FROM first)) "
    "SELECT 'first' AS src, count(*) AS n, round(sum(price), 2) AS price FROM a WHERE y <= 1998 "
    "UNION ALL SELECT 'second', count(*), round(coalesce(sum(price), 0), 2) FROM extra"
)
def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a second source only for buildings that the first one lacks."""
    d = sample(spark, sf_dir)
    first = d.where("y <= 1998").withColumn("src", F.lit("first"))
    both = S.with_optional(first, d.where("y > 1998").withColumn("src", F.lit("second")), ["bld"])
    got = both.groupBy("src").agg(F.count("*").alias("n"), F.sum("price").alias("price"))
    kinds = spark.range(2).select(F.when(F.col("id") == 0, "first").otherwise("second").alias("src"))
    return kinds.join(got, "src", "left").select("src", F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce("price", F.lit(0.0)), 2).alias("price"))


@query(
    "SELECT district, city, count(*) AS n, round(avg(price), 4) AS price FROM a JOIN places USING (block) "
    "GROUP BY GROUPING SETS ((), (district), (district, city))"
)
def summary_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(places(spark, sf_dir), "block")
    return d.rollup("district", "city").agg(F.count("*").alias("n"), r6(F.avg("price"), 4).alias("price"))


@query(
    ", b AS (SELECT city, district, sum(price) AS p, sum(area) AS m FROM a JOIN places USING (block) GROUP BY ALL), "
    "l AS (SELECT 'all' AS level, 'all' AS area, p, m FROM b UNION ALL SELECT 'district', district, p, m FROM b UNION ALL SELECT 'city', city, p, m FROM b) "
    "SELECT level, area, round(sum(p) / sum(m), 6) AS ratio FROM l GROUP BY ALL"
)
def ratio_of_sums_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(places(spark, sf_dir), "block").withColumnRenamed("area", "m2")
    out = R.levels_sum(d, ["district", "city"], p=F.sum("price"), m=F.sum("m2"))
    return out.select("level", "area", r6(X.divided("p", "m")).alias("ratio"))


EDGES = [1000.0, 1200.0, 1500.0, 1900.0, 2400.0, 3000.0]


@query(
    ", e AS (SELECT unnest([0, 1, 2, 3, 4]) AS bin, unnest([1000, 1200, 1500, 1900, 2400]) AS lo, unnest([1200, 1500, 1900, 2400, 3000]) AS hi), "
    "v AS (SELECT district, least(greatest(ppm, 1000), 3000) AS p FROM a JOIN places USING (block)), "
    "c AS (SELECT district, bin, count(*) AS n FROM v JOIN e ON p >= lo AND (p < hi OR (bin = 4 AND p <= hi)) GROUP BY ALL) "
    "SELECT d.district, CAST(e.bin AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT district FROM v) d CROSS JOIN e LEFT JOIN c ON c.district = d.district AND c.bin = e.bin"
)
def histogram_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(sample(spark, sf_dir).join(places(spark, sf_dir), "block"), ["district"], "ppm", EDGES)


@query(
    "SELECT city, round(sum(area * ppm) / sum(area), 6) AS mean, "
    "round(sqrt((sum(area * ppm * ppm) - sum(area * ppm) ** 2 / sum(area)) / (sum(area) - sum(area * area) / sum(area))), 4) AS sd "
    "FROM a JOIN places USING (block) GROUP BY city"
)
def weighted_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(places(spark, sf_dir), "block")
    return d.groupBy("city").agg(
        r6(R.weighted_mean("ppm", "area")).alias("mean"), r6(F.sqrt(R.weighted_variance("ppm", "area")), 4).alias("sd")
    )


@query(
    ", s AS (SELECT city, ppm, sum(area) AS w FROM a JOIN places USING (block) GROUP BY ALL), "
    "u AS (SELECT *, sum(w) OVER (PARTITION BY city ORDER BY ppm) AS u, sum(w) OVER (PARTITION BY city) AS t FROM s) "
    "SELECT city, round(min(ppm), 6) AS ppm FROM u WHERE 2 * u >= t GROUP BY city"
)
def weighted_median_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(places(spark, sf_dir), "block")
    return R.weighted_median(d, ["city"], "ppm", "area").select("city", r6("ppm").alias("ppm"))


@query(
    ", b AS (SELECT bld, min(block) AS block, count(*) AS n, avg(ln(ppm)) AS fe FROM a GROUP BY bld) "
    "SELECT block, round(sqrt(greatest(sum(n * fe * fe) / sum(n) - (sum(n * fe) / sum(n)) ** 2, 0)), 6) AS spread, count(*) AS buildings "
    "FROM b GROUP BY block HAVING count(*) >= 5"
)
def inequality_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sample(spark, sf_dir).groupBy("bld").agg(F.min("block").alias("block"), F.count("*").alias("n"), F.avg(F.ln("ppm")).alias("fe"))
    m = R.weighted_mean(F.col("fe") * F.col("fe"), "n") - F.pow(R.weighted_mean("fe", "n"), 2)
    out = b.groupBy("block").agg(r6(F.sqrt(F.greatest(m, F.lit(0.0)))).alias("spread"), F.count("*").alias("buildings"))
    return out.where("buildings >= 5")


@query(
    ", c AS (SELECT block, kind, count(*) AS n FROM a JOIN reg USING (bld) GROUP BY ALL) "
    "SELECT block, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(6), 6) AS entropy FROM c GROUP BY block"
)
def mix_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(register(spark, sf_dir), "bld")
    return R.entropy(d, ["block"], "kind", 6).select("block", r6("entropy").alias("entropy"))


@query(
    ", k AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS rooms), n AS (SELECT y, rooms, count(*) AS n FROM a GROUP BY ALL), "
    "g AS (SELECT y.y, CAST(k.rooms AS INTEGER) AS rooms, coalesce(n, 0) AS n FROM (SELECT DISTINCT y FROM a) y CROSS JOIN k LEFT JOIN n ON n.y = y.y AND n.rooms = k.rooms) "
    "SELECT y, rooms, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share FROM g"
)
def room_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shares(sample(spark, sf_dir), ["y"], "rooms", list(range(1, 8))).select("y", "rooms", "n", r6("share").alias("share"))


@query(
    "SELECT ym, all_deals, coalesce(n, 0) AS sample FROM (SELECT ym, count(*) AS all_deals FROM (SELECT DISTINCT ok, rooms, bld, dt, price, ym FROM deals) GROUP BY ym) "
    "FULL JOIN (SELECT ym, count(*) AS n FROM a GROUP BY ym) USING (ym)"
)
def deals_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = deals(spark, sf_dir).select("ok", "rooms", "bld", "dt", "price", "ym").distinct().groupBy("ym").agg(F.count("*").alias("all_deals"))
    own = sample(spark, sf_dir).groupBy("ym").agg(F.count("*").alias("sample"))
    return every.join(own, "ym", "full").select("ym", "all_deals", F.coalesce("sample", F.lit(0)).alias("sample"))


@query(
    ", m AS (SELECT DISTINCT ym AS month FROM a), f AS (SELECT month, last_value(value IGNORE NULLS) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS v "
    "FROM m LEFT JOIN prices USING (month)) SELECT month, round(v, 4) AS value FROM f"
)
def carry_forward_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir)
    months = R.calendar(d, F.min("dt"), F.max("dt"))
    return I.filled_prices(prices(spark, sf_dir), months).select("month", r6("value", 4).alias("value"))


@query(
    ", f AS (SELECT month, last_value(value IGNORE NULLS) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT DISTINCT ym AS month FROM a) LEFT JOIN prices USING (month)), "
    "x AS (SELECT ym, median(ppm) AS p FROM a GROUP BY ym), q AS (SELECT ym, p / v AS r FROM x JOIN f ON month = ym) "
    "SELECT ym, round(100 * r / (SELECT avg(r) FROM q WHERE ym LIKE '1998%'), 6) AS real_index FROM q"
)
def real_median_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir)
    p = I.filled_prices(prices(spark, sf_dir), R.calendar(d, F.min("dt"), F.max("dt")))
    m = d.groupBy("ym").agg(F.median("ppm").alias("p")).join(p.withColumnRenamed("month", "ym"), "ym")
    m = m.withColumn("r", X.divided("p", "value"))
    return R.rebased(m, [], "r", F.col("ym").startswith("1998"), "real_index").select("ym", r6("real_index").alias("real_index"))


RETURNS = """
, s AS (SELECT a.*, price / 1000 AS real_price FROM a),
p AS (SELECT *, lead(dt) OVER w AS ndt, lead(real_price) OVER w AS np, lead(area) OVER w AS na FROM s
  WINDOW w AS (PARTITION BY apt ORDER BY dt, ok, rooms, price, area)),
q AS (SELECT *, date_diff('day', dt, ndt) / 365.25 AS years, ln(np / real_price) AS gain FROM p
  WHERE ndt IS NOT NULL AND abs(na / area - 1) <= 0.5 AND date_diff('day', dt, ndt) / 365.25 >= 0.5)
"""


@query(
    RETURNS + "SELECT CASE WHEN years <= 2 THEN 'a' WHEN years <= 4 THEN 'b' ELSE 'c' END AS held, count(*) AS n, round(median(exp(gain / years) - 1), 6) AS annual, "
    "round(avg(CASE WHEN gain < 0 THEN 1.0 ELSE 0.0 END), 6) AS losses FROM q GROUP BY 1"
)
def repeat_sale_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).withColumn("real_price", F.col("price") / 1000)
    r = I.returns(d, "apt", "dt", ["dt", "ok", "rooms", "price", "area"], "real_price", "area", 0.5)
    held = X.binned("years", [0.4, 2, 4, 100], ["a", "b", "c"])
    return r.groupBy(held.alias("held")).agg(
        F.count("*").alias("n"), r6(F.median("annual")).alias("annual"), r6(F.avg((F.col("gain") < 0).cast("double"))).alias("losses")
    )


@query(
    RETURNS.replace("PARTITION BY apt", "PARTITION BY bld") + ", st AS (SELECT *, exp(gain / years) - 1 AS annual, CAST(year(dt) AS INTEGER) AS start FROM q) "
    "SELECT start, count(*) AS n, round(median(annual), 6) AS annual, round(avg(CASE WHEN gain < 0 THEN 1.0 ELSE 0.0 END), 6) AS losses FROM st GROUP BY start HAVING count(*) >= 500"
)
def returns_by_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real returns from one sale of a building to the next by the year of the first, where it has 500 pairs."""
    d = sample(spark, sf_dir).withColumn("real_price", F.col("price") / 1000)
    r = I.returns(d, "bld", "dt", ["dt", "ok", "rooms", "price", "area"], "real_price", "area", 0.5)
    out = I.returns_by_start(r, "dt", 500)
    return out.select("start", "n", r6("annual").alias("annual"), r6("losses").alias("losses"))


@query(
    "SELECT CAST(floor(built / 10) * 10 AS INTEGER) AS dec, count(*) AS n, round(avg(area), 6) AS area, round(avg(ceil(rooms)), 6) AS rooms, "
    "round(avg(area / rooms) FILTER (WHERE area / rooms BETWEEN 5 AND 50), 6) AS per_room FROM a JOIN reg USING (bld) WHERE built BETWEEN 1930 AND 2025 GROUP BY 1"
)
def vintage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(register(spark, sf_dir), "bld").where("built between 1930 and 2025")
    per = X.divided("area", "rooms")
    return d.groupBy(X.decade("built").alias("dec")).agg(
        F.count("*").alias("n"), r6(F.avg("area")).alias("area"), r6(F.avg(F.ceil("rooms"))).alias("rooms"),
        r6(F.avg(F.when(per.between(5, 50), per))).alias("per_room"),
    )


@query(
    "SELECT bld, y, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(median(ppm), 6) END AS ppm FROM a GROUP BY bld, y"
)
def suppressed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).groupBy("bld", "y").agg(F.count("*").alias("n"), F.median("ppm").alias("_m"))
    return d.select("bld", "y", "n", R.suppressed("n", 5, r6("_m")).alias("ppm"))


@query(
    ", c AS (SELECT block, y, count(*) AS n FROM a GROUP BY ALL), p AS (SELECT block, y, avg(ln(ppm)) AS lp FROM a GROUP BY ALL) "
    "SELECT p.block, p.y, round(lp, 6) AS lp, c.n AS stock FROM p JOIN c ON c.block = p.block AND c.y = p.y - 1"
)
def lagged_supply_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir)
    c = d.groupBy("block", "y").agg(F.count("*").alias("stock"))
    p = d.groupBy("block", "y").agg(r6(F.avg(F.ln("ppm"))).alias("lp"))
    return R.lagged(p, c, ["block"], "y").select("block", "y", "lp", "stock")


@query(
    ", p AS (SELECT * FROM (VALUES ('early', 1990, 1996), ('mid', 1997, 1998), ('late', 1999, 2005)) t(period, low, high)) "
    "SELECT period, count(*) AS n, round(avg(ppm), 6) AS ppm FROM a JOIN p ON y BETWEEN low AND high GROUP BY period"
)
def by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = spark.createDataFrame([("early", 1990, 1996), ("mid", 1997, 1998), ("late", 1999, 2005)], "period string, low int, high int")
    return R.in_period(sample(spark, sf_dir), periods, "y").groupBy("period").agg(F.count("*").alias("n"), r6(F.avg("ppm")).alias("ppm"))


@query(
    ", own AS (SELECT bld, median(area) AS v FROM a WHERE y >= 2001 GROUP BY bld), bl AS (SELECT block, median(area) AS v FROM a WHERE y >= 2001 GROUP BY block), "
    "nat AS (SELECT median(area) AS v FROM a), u AS (SELECT bld, min(block) AS block FROM a GROUP BY bld) "
    "SELECT bld, round(coalesce(own.v, bl.v, nat.v), 6) AS m2, CASE WHEN own.v IS NOT NULL THEN 1 WHEN bl.v IS NOT NULL THEN 2 ELSE 3 END AS m2_level "
    "FROM u LEFT JOIN own USING (bld) LEFT JOIN bl USING (block), nat"
)
def size_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir)
    recent = d.where("y >= 2001")
    levels = [
        (recent.groupBy("bld").agg(F.median("area").alias("v")), ["bld"], "v"),
        (recent.groupBy("block").agg(F.median("area").alias("v")), ["block"], "v"),
        (d.agg(F.median("area").alias("v")), [], "v"),
    ]
    u = d.groupBy("bld").agg(F.min("block").alias("block"))
    return R.cascade(u, levels, "m2").select("bld", r6("m2").alias("m2"), "m2_level")


@query(
    ", s AS (SELECT DISTINCT kind, brand FROM reg), p AS (SELECT kind, string_agg(brand, ';' ORDER BY brand) AS packed FROM s GROUP BY kind) "
    "SELECT kind, brand FROM s WHERE kind IN (SELECT kind FROM p)"
)
def pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = register(spark, sf_dir).select("kind", "brand").distinct()
    return S.unpack_rows(S.pack_rows(s, "kind", ["brand"]), "packed", ";", ",", {"brand": "string"})


@query(
    ", b AS (SELECT block, area, y, ppm FROM a), e AS (SELECT block, count(*) AS n, avg(ppm) AS m FROM b GROUP BY block) "
    "SELECT b.block, count(*) AS n, round(avg(abs(ppm - m)), 6) AS gap FROM b JOIN e USING (block) WHERE e.n >= 100 GROUP BY b.block"
)
def demeaned_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.with_size(sample(spark, sf_dir), ["block"], 100)
    m = d.groupBy("block").agg(F.avg("ppm").alias("m"))
    return d.join(m, "block").groupBy("block").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("ppm") - F.col("m")))).alias("gap"))


@query(
    ", y AS (SELECT city, y, avg(ppm) AS p FROM a JOIN places USING (block) GROUP BY ALL), "
    "w AS (SELECT *, avg(p) OVER w3 AS m, count(*) OVER w3 AS k, p - lag(p) OVER o AS d1, sum(p) OVER o AS total FROM y "
    "WINDOW o AS (PARTITION BY city ORDER BY y), w3 AS (PARTITION BY city ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) "
    "SELECT city, y, round(CASE WHEN k = 3 THEN m ELSE p END, 6) AS smooth, round(d1, 6) AS d1, round(total, 4) AS total FROM w"
)
def smoothed_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(places(spark, sf_dir), "block").groupBy("city", "y").agg(F.avg("ppm").alias("p"))
    w = Window.partitionBy("city").orderBy("y")
    out = R.moving_mean(d, ["city"], "y", "p", "smooth")
    return out.select("city", "y", r6("smooth").alias("smooth"), r6(F.col("p") - F.lag("p").over(w)).alias("d1"), r6(F.sum("p").over(w), 4).alias("total"))


@query(
    ", b AS (SELECT city, y, count(*) AS n FROM a JOIN places USING (block) GROUP BY ALL), full_ AS (SELECT city FROM b GROUP BY city HAVING count(*) = (SELECT count(DISTINCT y) FROM a)) "
    "SELECT city, CAST(sum(n) AS BIGINT) AS n FROM b WHERE city IN (SELECT city FROM full_) GROUP BY city"
)
def balanced_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(places(spark, sf_dir), "block").groupBy("city", "y").agg(F.count("*").alias("n"))
    years = d.agg(F.count_distinct("y")).first()[0]
    return R.balanced(d, ["city"], "y", years).groupBy("city").agg(F.sum("n").alias("n"))


@query(
    ", e AS (SELECT user_id AS place, count(*) AS valid, count(*) FILTER (WHERE event_type = 'click') AS p1, count(*) FILTER (WHERE event_type = 'error') AS p2 FROM events GROUP BY 1) "
    "SELECT place, round((p1 + p2) / valid, 6) AS share, (p1 + p2) / valid >= 0.5 AS won FROM e"
)
def party_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("place")).agg(
        F.count("*").alias("valid"), F.count_if(F.col("event_type") == "click").alias("p1"), F.count_if(F.col("event_type") == "error").alias("p2")
    )
    share, won = X.party_share(["p1", "p2"], "valid")
    return e.select("place", r6(share).alias("share"), won.alias("won"))


@query(
    ", e AS (SELECT user_id AS place, event_type, count(*) AS n FROM events GROUP BY ALL), h AS (SELECT place, n AS n1 FROM e WHERE event_type = 'click'), "
    "k AS (SELECT place, n AS n2 FROM e WHERE event_type = 'view' OR event_type = 'purchase') "
    "SELECT place, n1, CAST(max(n2) AS BIGINT) AS n2 FROM h JOIN k USING (place) WHERE n1 <= 1.5 * n2 AND n2 <= 1.5 * n1 GROUP BY ALL"
)
def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("place"), "event_type").agg(F.count("*").alias("n"))
    first = e.where("event_type = 'click'").select("place", "n")
    second = e.where("event_type in ('view', 'purchase')").select("place", "n")
    return R.ratio_match(first, second, ["place"], "n").groupBy("place", F.col("n").alias("n1")).agg(F.max("n_b").alias("n2"))


@query(
    ", n AS (SELECT kind, brand, sum(floors) AS s FROM reg GROUP BY ALL) SELECT kind, "
    + ", ".join(f"CAST(coalesce(sum(s) FILTER (WHERE brand = 'Brand#{k}'), 0) AS BIGINT) AS b{k}" for k in (1, 2, 3))
    + " FROM n GROUP BY kind"
)
def floors_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = register(spark, sf_dir).groupBy("kind").pivot("brand", ["Brand#1", "Brand#2", "Brand#3"]).agg(F.sum("floors"))
    return p.toDF("kind", "b1", "b2", "b3").na.fill(0)


@query(
    ", s AS (SELECT DISTINCT kind AS place, street AS name FROM reg), l AS (SELECT DISTINCT place, split_part(name, ' ', 1) AS short FROM s WHERE length(name) >= 5) "
    "SELECT l.place, count(*) AS n FROM l JOIN s ON s.place = l.place AND s.name <> l.short AND contains(s.name, l.short) AND length(l.short) >= 3 "
    "WHERE NOT EXISTS (SELECT 1 FROM s s2 WHERE s2.place = l.place AND s2.name = l.short) GROUP BY l.place"
)
def street_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = register(spark, sf_dir).select(F.col("kind").alias("place"), F.col("street").alias("name")).distinct()
    short = s.where(F.char_length("name") >= 5).select("place", F.split_part("name", F.lit(" "), F.lit(1)).alias("name")).distinct()
    found = R.contains_match(short, s, "place", "name").where("how = 'part'")
    return found.groupBy("place").agg(F.count("*").alias("n"))


@query(
    "SELECT rooms, count(*) AS n, round(avg(l), 6) AS mean_log, CAST(sum(z) AS BIGINT) AS zeros, round(avg(sig), 6) AS sig FROM ("
    "SELECT rooms, CASE WHEN rooms - 3 > 0 THEN ln(rooms - 3) WHEN rooms - 3 = 0 THEN 0 END AS l, CAST(rooms = 3 AS INTEGER) AS z, "
    "round(ppm * pow(10, 3 - floor(log10(ppm)))) / pow(10, 3 - floor(log10(ppm))) AS sig FROM a) GROUP BY rooms"
)
def scaled_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, zero = X.log_with_zero(F.when(F.col("rooms") >= 3, F.col("rooms") - 3))
    d = sample(spark, sf_dir).select("rooms", log.alias("l"), F.coalesce(zero, F.lit(0)).alias("z"), X.significant("ppm").alias("sig"))
    return d.groupBy("rooms").agg(F.count("*").alias("n"), r6(F.avg("l")).alias("mean_log"), F.sum("z").alias("zeros"), r6(F.avg("sig")).alias("sig"))
