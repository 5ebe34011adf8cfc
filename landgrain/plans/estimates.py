"""Queries of the analytic core: regressions, price indices, premiums, supply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrain.functions import exprs as X
from landgrain.operators import fixed_effects as E
from landgrain.operators import indices as I
from landgrain.operators import relational as R
from landgrain.operators import selection
from landgrain.operators import supply as U
from landgrain.operators.components import checkpointed
from landgrain.plans import normal_equations as Q
from landgrain.plans.base import places, prices, query, r6, register, sample


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample with logs, place and register columns."""
    d = sample(spark, sf_dir).join(places(spark, sf_dir), "block").join(register(spark, sf_dir).drop("x", "y"), "bld")
    return d.select(
        "*", F.ln("price").alias("lprice"), F.ln("ppm").alias("lp"), F.ln("area").alias("larea"),
        F.least(F.round(F.col("area") / 5) * 5, F.lit(45.0)).cast("int").alias("size"), F.col("rooms").cast("double").alias("nrooms"),
    )


#: ``logged`` in SQL.
LG = """
, lg AS (SELECT a.*, city, district, floors, street, kind, brand, built, ln(price) AS lprice, ln(ppm) AS lp, ln(area) AS larea,
  CAST(least(round(area / 5) * 5, 45) AS INTEGER) AS size, CAST(rooms AS DOUBLE) AS nrooms
  FROM a JOIN places USING (block) JOIN reg USING (bld)), """
BASE_M, BASE_Q = "ym[:4] = '1998'", "yq[:4] = '1998'"
REPEATS = "rp AS (SELECT * FROM lg QUALIFY count(*) OVER (PARTITION BY apt) >= 2), "


def rounded(df: DataFrame, keys: list[str], **digits: int) -> DataFrame:
    return df.select(*keys, *(r6(c, k).alias(c) for c, k in digits.items()))


def estimates(fits: dict[str, E.Fit], df: DataFrame) -> DataFrame:
    """(model, term, beta, se), rounded."""
    parts = [fit.table(df).withColumn("model", F.lit(name)) for name, fit in fits.items()]
    return rounded(reduce(DataFrame.unionByName, parts), ["model", "term"], beta=6, se=6)


def fits_sql(models: dict[str, str]) -> str:
    """The same from the CTEs ``<name>_fit`` of each model."""
    return " UNION ALL ".join(f"SELECT '{m}' AS model, term, round(beta, 6) AS beta, round(se, 6) AS se FROM {n}_fit" for m, n in models.items())


WITHIN = """
, r AS (SELECT block, bld, ln(price) AS y, ln(area) AS x FROM a),
m AS (SELECT block, avg(y) AS my, avg(x) AS mx FROM r GROUP BY block),
d AS (SELECT block, y - my AS y, x - mx AS x FROM r JOIN m USING (block)),
b AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM d),
s AS (SELECT block, sum(x * (y - beta * x)) AS s FROM d, b GROUP BY block)
"""


@query(
    WITHIN + "SELECT 'larea' AS term, round(max(beta), 6) AS beta, round(sqrt(sum(s * s)) / max(sxx) * sqrt(count(*) / (count(*) - 1)), 6) AS se, "
    "count(*) AS clusters, round(max(sxy * sxy / sxx / syy), 6) AS r2 FROM s, b"
)
def within_ols_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = logged(spark, sf_dir)
    fit = E.fe_ols(d, "lprice", ["larea"], ["block"], "block")
    return fit.table(d).select("term", r6("beta").alias("beta"), r6("se").alias("se"), "clusters", r6("r2_within").alias("r2"))


@query(
    ", r AS (SELECT city, ln(ppm) AS y, area AS w FROM a JOIN places USING (block)), g AS (SELECT city, sum(w) AS s, sum(w * y) AS sy, sum(w * y * y) AS syy FROM r GROUP BY city) "
    "SELECT round((sum(sy * sy / s) - sum(sy) ** 2 / sum(s)) / (sum(syy) - sum(sy) ** 2 / sum(s)), 8) AS r2 FROM g"
)
def between_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.between_share(logged(spark, sf_dir), "city", "lp", "area").select(r6("r2", 8).alias("r2"))


@query(
    ", q AS (SELECT list(e) AS e FROM (SELECT unnest(quantile_cont(ppm, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM a)), "
    "v AS (SELECT ppm, area, len(list_filter(e, lambda z: z < ppm)) AS bin FROM a, q) "
    "SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(sum(area * ppm) / sum(area), 4) AS x, round(sum(area * area) / sum(area), 4) AS y FROM v GROUP BY bin"
)
def binned_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.binned_scatter(sample(spark, sf_dir).withColumn("w", F.col("area")), "ppm", "area", "w", 10)
    return out.select("bin", "n", r6("x", 4).alias("x"), r6("y", 4).alias("y"))


@query(
    ", t AS (SELECT block, y, ln(price) AS p, ln(area) AS x FROM a), w AS (SELECT block, p, x, y + k AS win, CAST(1 - k AS DOUBLE) AS late FROM t, (SELECT unnest([0, 1]) AS k)), "
    "c AS (SELECT *, count(*) OVER (PARTITION BY win, block) AS k FROM w), z AS (SELECT * FROM c WHERE k >= 2), "
    "d AS (SELECT win, p - avg(p) OVER g AS p, x - avg(x) OVER g AS x, late - avg(late) OVER g AS l FROM z WINDOW g AS (PARTITION BY win, block)), "
    "s AS (SELECT win, sum(l * l) AS ll, sum(l * x) AS lx, sum(x * x) AS xx, sum(l * p) AS lp, sum(x * p) AS xp FROM d GROUP BY win), "
    "b AS (SELECT win AS y, (lp * xx - xp * lx) / nullif(ll * xx - lx * lx, 0) AS change FROM s), "
    "o AS (SELECT y.y, CASE WHEN y.y = (SELECT min(y) FROM a) THEN 0 ELSE change END AS change FROM (SELECT DISTINCT y FROM a) y LEFT JOIN b USING (y)) "
    "SELECT y, round(change, 6) AS change, round(100 * exp(sum(change) OVER (ORDER BY y)), 4) AS index FROM o"
)
def hedonic_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.chained_index(logged(spark, sf_dir), "lprice", ["larea"], "block", "y")
    return out.select("y", r6("change").alias("change"), r6("index", 4).alias("index"))


@query(
    ", m AS (SELECT *, sum(area * ppm) OVER b / sum(area) OVER b AS mx, sum(area * price) OVER b / sum(area) OVER b AS my FROM a WINDOW b AS (PARTITION BY block)), "
    "v0 AS (SELECT ppm - mx AS x, price - my AS y, area FROM m), q AS (SELECT quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM v0), "
    "v AS (SELECT *, len(list_filter(e, lambda z: z < x)) AS bin FROM v0, q) "
    "SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(sum(area * x) / sum(area), 4) AS x, round(sum(area * y) / sum(area), 2) AS y FROM v GROUP BY bin"
)
def binned_scatter_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price against price per metre, both relative to their block's mean."""
    d = sample(spark, sf_dir).withColumn("w", F.col("area"))
    return rounded(R.binned_scatter(d, "ppm", "price", "w", 10, "block"), ["bin", "n"], x=4, y=2)


@query(
    LG + Q.effects("f", "lg", "block", ["ym"], ["lprice", "larea", "nrooms"]) + "," + Q.solve("b", "f_mo", ["larea", "nrooms"], ["lprice"]) + ","
    + Q.index("i", f"p_lprice - {Q.coefficient('b_x', 'larea', 'lprice')} * p_larea - {Q.coefficient('b_x', 'nrooms', 'lprice')} * p_nrooms", "f_wide", "ym", BASE_M)
    + " SELECT ym, round(index, 4) AS index FROM i"
)
def hedonic_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.pooled_index(logged(spark, sf_dir), "lprice", ["larea", "nrooms"], "block", "ym", F.col("ym").startswith("1998"))
    return rounded(out, ["ym"], index=4)


FE = LG + Q.effects("f", "lg", "bld", ["ym", "size"], ["lp"]) + "," + Q.index("i", "p_lp", "f_wide", "ym", BASE_M)


@query(FE + " SELECT ym, round(index, 4) AS index FROM i")
def building_fe_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.fe_index(logged(spark, sf_dir), "lp", "bld", "ym", ["size"], F.col("ym").startswith("1998"))
    return rounded(out, ["ym"], index=4)


@query(LG + REPEATS + Q.effects("f", "rp", "apt", ["yq", "size"], ["lp"]) + "," + Q.index("i", "p_lp", "f_wide", "yq", BASE_Q) + " SELECT yq, round(index, 4) AS index FROM i")
def repeat_sales_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.repeat_sales_index(logged(spark, sf_dir), "lp", "apt", "yq", ["size"], F.col("yq").startswith("1998"))
    return rounded(out, ["yq"], index=4)


@query(
    LG + "lv AS (SELECT *, unnest([{t: 'all', v: 'all'}, {t: 'district', v: district}, {t: 'city', v: city}]) AS z FROM lg), "
    "lw AS (SELECT * EXCLUDE (z), z.t AS tier, z.v AS zone, count(*) OVER (PARTITION BY z.t, z.v) AS deals FROM lv), "
    "ar AS (SELECT *, CASE WHEN deals >= 10000 THEN ym ELSE yq END AS period FROM lw WHERE deals >= 1000), "
    + Q.effects("f", "ar", "bld", ["period", "size"], ["lp"], ["tier", "zone"]) + ","
    + Q.index("i", "p_lp", "f_wide", "period", "period[:4] = '1998'", ["tier", "zone"]) + " SELECT tier, zone AS area, period, round(index, 4) AS index FROM i"
)
def area_indices_all_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = logged(spark, sf_dir).withColumnRenamed("area", "m2")
    out = I.area_indices(d, "lp", "bld", "ym", "yq", ["size"], ["district", "city"], "1998", 1000, 10_000)
    return rounded(out, ["tier", "area", "period"], index=4)


AREAS = (
    LG + "lv AS (SELECT *, unnest([{t: 'all', v: 'all'}, {t: 'district', v: district}, {t: 'city', v: city}]) AS z FROM lg), "
    "lw AS (SELECT * EXCLUDE (z), z.t AS tier, z.v AS zone, count(*) OVER (PARTITION BY z.t, z.v) AS deals FROM lv), "
    "ar AS (SELECT *, CASE WHEN deals >= 10000 THEN ym ELSE yq END AS period FROM lw WHERE deals >= 1000), "
    "ag0 AS (SELECT * FROM ar QUALIFY count(*) OVER (PARTITION BY tier, zone, apt) >= 2), ag AS (SELECT * FROM ag0 QUALIFY count(*) OVER (PARTITION BY tier, zone) >= 300), "
    + Q.effects("f", "ar", "bld", ["period", "size"], ["lp"], ["tier", "zone"]) + "," + Q.index("ib", "p_lp", "f_wide", "period", "period[:4] = '1998'", ["tier", "zone"]) + ","
    + Q.effects("r", "ag", "apt", ["period", "size"], ["lp"], ["tier", "zone"]) + "," + Q.index("ir", "p_lp", "r_wide", "period", "period[:4] = '1998'", ["tier", "zone"]) + ","
    + Q.effects("h", "ar", "block", ["period"], ["lprice", "larea"], ["tier", "zone"]) + ", "
    "hw AS (SELECT w.*, b FROM h_wide w JOIN (SELECT tier, zone, sum(r_lprice * r_larea) / sum(r_larea * r_larea) AS b FROM h_res GROUP BY ALL) USING (tier, zone)), "
    + Q.index("ip", "p_lprice - b * p_larea", "hw", "period", "period[:4] = '1998'", ["tier", "zone"]) + ", "
    "cw AS (SELECT tier, zone, block, lprice AS p, larea AS x, y + k AS win, CAST(1 - k AS DOUBLE) AS late FROM ar, (SELECT unnest([0, 1]) AS k)), "
    "cz AS (SELECT * FROM cw QUALIFY count(*) OVER (PARTITION BY tier, zone, win, block) >= 2), "
    "cd AS (SELECT tier, zone, win, p - avg(p) OVER g AS p, x - avg(x) OVER g AS x, late - avg(late) OVER g AS l FROM cz WINDOW g AS (PARTITION BY tier, zone, win, block)), "
    "cs AS (SELECT tier, zone, win, count(*) AS n, sum(l * l) AS ll, sum(l * x) AS lx, sum(x * x) AS xx, sum(l * p) AS lp, sum(x * p) AS xp FROM cd GROUP BY ALL), "
    "cb AS (SELECT tier, zone, win AS y, CASE WHEN n >= 30 THEN (lp * xx - xp * lx) / nullif(ll * xx - lx * lx, 0) END AS change FROM cs), "
    "cy AS (SELECT DISTINCT tier, zone, y FROM ar), "
    "ic AS (SELECT tier, zone, CAST(y AS VARCHAR) AS period, 100 * exp(sum(CASE WHEN y = (SELECT min(y) FROM cy c WHERE c.tier = cy.tier AND c.zone = cy.zone) THEN 0 ELSE coalesce(change, 0) END) OVER (PARTITION BY tier, zone ORDER BY y)) AS index "
    "FROM cy LEFT JOIN cb USING (tier, zone, y)) "
)


@query(AREAS + " UNION ALL ".join(f"SELECT '{k}' AS kind, tier, zone AS area, period, round(index, 4) AS index FROM {t}" for k, t in (("building", "ib"), ("repeat", "ir"), ("pooled", "ip"), ("chained", "ic"))))
def area_indices_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building, repeat-sales, pooled and chained indices of every area and level."""
    d = logged(spark, sf_dir).withColumnRenamed("area", "m2")
    out = I.area_indices_all_kinds(d, "lp", "lprice", ["larea"], "bld", "apt", "block", "ym", "yq", "y", ["size"], ["district", "city"], "1998", 1000, 10_000)
    return rounded(out, ["kind", "tier", "area", "period"], index=4)


@query(
    LG + REPEATS + "big AS (SELECT city FROM rp GROUP BY city HAVING count(*) >= 300 ORDER BY count(*) DESC, city LIMIT 20), "
    "rc AS (SELECT * FROM rp WHERE city IN (SELECT city FROM big)), " + Q.effects("f", "rc", "apt", ["y", "size"], ["lp"], ["city"]) + ","
    + Q.index("i", "p_lp", "f_wide", "y", "y = '1998'", ["city"]) + " SELECT city, y, round(index, 4) AS index FROM i"
)
def city_yearly_repeat_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly repeat-sales indices of apartments in the 20 cities with the most repeated sales, at least 300."""
    d = R.with_size(logged(spark, sf_dir), ["city", "apt"], 2)
    d = d.join(R.largest(d, ["city"], 20, 300).select("city"), "city", "left_semi")
    return rounded(I.repeat_sales_index(d, "lp", "apt", "y", ["size"], F.col("y") == "1998", ["city"]), ["city", "y"], index=4)


@query(
    FE + ", m AS (SELECT ym, median(ppm) AS p FROM lg GROUP BY ym), "
    f"w AS (SELECT ym, ln(p / avg(p) FILTER (WHERE {BASE_M}) OVER ()) AS r, ln(index / 100) AS b FROM m JOIN i USING (ym)), "
    "d AS (SELECT *, r - lag(r) OVER t AS r1, b - lag(b) OVER t AS b1, r - lag(r, 12) OVER t AS r12, b - lag(b, 12) OVER t AS b12 FROM w WINDOW t AS (ORDER BY ym)) "
    "SELECT round(corr(r1, b1), 6) AS corr1, round(corr(r12, b12), 6) AS corr12, round(stddev(r1), 6) AS sd_raw, round(stddev(b1), 6) AS sd_building, "
    "round(stddev(r - b), 6) AS sd_gap, round(arg_max(r, ym) - arg_min(r, ym), 6) AS change_raw, round(arg_max(b, ym) - arg_min(b, ym), 6) AS change_building FROM d"
)
def indices_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw median against building effects: changes, their spread and correlation, the gap, and the change over all."""
    d = logged(spark, sf_dir)
    base = F.col("ym").startswith("1998")
    raw = I.raw_index(d, "ppm", "ym", base).withColumn("kind", F.lit("raw"))
    fe = I.fe_index(d, "lp", "bld", "ym", ["size"], base).withColumn("kind", F.lit("building"))
    out = I.comparison(raw.unionByName(fe), "kind", "ym", "index", "raw", "building")
    return rounded(out, [], corr1=6, corr12=6, sd_raw=6, sd_building=6, sd_gap=6, change_raw=6, change_building=6)


@query(
    LG + "cal AS (SELECT DISTINCT ym AS month FROM lg), fp AS (SELECT month, last_value(value IGNORE NULLS) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS v FROM cal LEFT JOIN prices USING (month)), "
    "cb AS (SELECT avg(v) AS b FROM fp WHERE month[:4] = '1998'), re AS (SELECT lg.*, ln(ppm / (v / b)) AS rp FROM lg JOIN fp ON month = ym, cb), "
    + Q.effects("f", "re", "bld", ["ym", "size"], ["rp"]) + "," + Q.index("i", "p_rp", "f_wide", "ym", BASE_M) + " SELECT ym, round(index, 4) AS index FROM i"
)
def deflated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = logged(spark, sf_dir)
    p = I.filled_prices(prices(spark, sf_dir), R.calendar(d, F.min("dt"), F.max("dt")))
    real = I.deflated(d, "ppm", "ym", p, "1998", "real")
    return rounded(I.fe_index(real, "real", "bld", "ym", ["size"], F.col("ym").startswith("1998")), ["ym"], index=4)


def premium_sql(kind: str, base: str, source: str = "lg", keys: str = "", least: int = 1) -> str:
    """Premiums of ``kind`` from effects "f", in which it is the first small dimension."""
    k = f"{keys}, " if keys else ""
    using = f"USING ({k}l)" if keys else "USING (l)"
    ref = f"JOIN ref USING ({keys})" if keys else ", ref"
    return (
        f", ref AS (SELECT {k}p_lp AS b FROM f_wide WHERE l = '0:{base}'), "
        f"cnt AS (SELECT {k}'0:' || {kind} AS l, count(*) AS n FROM {source} GROUP BY ALL HAVING count(*) >= {least}), "
        f"pr AS (SELECT {k}l[3:] AS {kind}, n, exp(p_lp - b) - 1 AS premium FROM f_wide JOIN cnt {using} {ref}) "
    )


@query(LG + Q.effects("f", "lg", "bld", ["rooms", "ym", "size"], ["lp"]) + premium_sql("rooms", "3") + "SELECT rooms, n, round(premium, 6) AS premium FROM pr")
def rooms_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.premiums(logged(spark, sf_dir), "lp", "rooms", "3", "bld", ["ym", "size"]), ["rooms", "n"], premium=6)


@query(
    LG + Q.effects("f", "lg", "bld", ["rooms", "y", "size"], ["lp"], ["district"]) + premium_sql("rooms", "3", keys="district", least=30)
    + "SELECT district, rooms, n, round(premium, 6) AS premium FROM pr"
)
def rooms_gradient_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.premiums(logged(spark, sf_dir), "lp", "rooms", "3", "bld", ["y", "size"], ["district"], 30)
    return rounded(out, ["district", "rooms", "n"], premium=6)


@query(
    LG + "fl AS (SELECT *, least(rooms - 1, floors) AS fl FROM lg), ps AS (SELECT *, CASE WHEN fl = 0 THEN 'ground' WHEN fl = floors THEN 'top' "
    "WHEN 3 * fl <= floors THEN 'lower' WHEN 3 * fl <= 2 * floors THEN 'middle' ELSE 'upper' END AS pos FROM fl), "
    + Q.effects("f", "ps", "block", ["pos", "y", "size"], ["lp"]) + premium_sql("pos", "lower", "ps") + "SELECT pos, n, round(premium, 6) AS premium FROM pr"
)
def position_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = logged(spark, sf_dir).withColumn("pos", X.position_class(F.least(F.col("rooms") - 1, "floors"), "floors"))
    return rounded(I.premiums(d, "lp", "pos", "lower", "block", ["y", "size"]), ["pos", "n"], premium=6)


@query(
    LG + Q.effects("f", "lg", "bld", ["rooms", "y"], ["lp"], ["district"]) + premium_sql("rooms", "1", keys="district")
    + ", z AS (SELECT district, CAST(rooms AS DOUBLE) AS x, ln(premium + 1) AS e, n FROM pr) "
    "SELECT district, round((sum(n) * sum(n * x * e) - sum(n * x) * sum(n * e)) / (sum(n) * sum(n * x * x) - sum(n * x) ** 2), 6) AS slope FROM z GROUP BY district"
)
def floor_slope_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.premiums(logged(spark, sf_dir), "lp", "rooms", "1", "bld", ["y"], ["district"])
    p = p.withColumn("x", F.col("rooms").cast("double")).withColumn("e", F.ln(F.col("premium") + 1))
    return rounded(p.groupBy("district").agg(R.slope("x", "e", "n").alias("slope")), ["district"], slope=6)


HEIGHT = (
    "ht AS (SELECT *, block || '|' || y AS cell, CAST(floors > 25 AS INTEGER)::DOUBLE AS tall, CAST(greatest(y - built, 0) > 30 AS INTEGER)::DOUBLE AS old, 0 AS one, "
    "CAST(least(rooms - 1, floors) AS DOUBLE) AS own FROM lg WHERE built IS NOT NULL), "
)


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = logged(spark, sf_dir).where("built is not null")
    d = d.withColumn("cell", F.concat_ws("|", "block", "y")).withColumn("age", X.building_age("y", "built").cast("double"))
    d = d.withColumn("own", F.least(F.col("rooms") - 1, "floors").cast("double"))
    return d.withColumn("tall", (F.col("floors") > 25).cast("double")).withColumn("old", (F.col("age") > 30).cast("double"))


@query(
    LG + HEIGHT + Q.ols("h", "ht", "lp", ["larea", "tall", "old"], ["cell"], "block") + "," + Q.ols("p", "ht", "lp", ["larea", "tall", "old"], ["one"], None)
    + " " + fits_sql({"effects": "h", "pooled": "p"})
)
def height_hedonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-by-year effects, building height and age classes, clustered by block, and the contrast without effects."""
    d, xs = heights(spark, sf_dir), ["larea", "tall", "old"]
    return estimates({"effects": E.fe_ols(d, "lp", xs, ["cell"], "block"), "pooled": E.pooled_ols(d, "lp", xs)}, d)


@query(
    LG + HEIGHT + Q.ols("h", "ht", "lp", ["tall"], ["cell"], "block") + "," + Q.ols("p", "ht", "lp", ["tall", "own"], ["cell"], "block")
    + " " + fits_sql({"height": "h", "height and floor": "p"})
)
def height_and_own_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect of a tall building with and without the dwelling's own floor, block-by-year effects."""
    d = heights(spark, sf_dir)
    fit = lambda xs: E.fe_ols(d, "lp", xs, ["cell"], "block")
    return estimates({"height": fit(["tall"]), "height and floor": fit(["tall", "own"])}, d)


@query(
    LG + REPEATS + "vt AS (SELECT *, CASE WHEN built >= 1980 THEN 'new' WHEN built IS NULL THEN 'na' ELSE 'old' END AS vintage FROM rp), "
    + Q.effects("f", "vt", "apt", ["y"], ["larea"], ["vintage"]) + ", e AS (SELECT vintage, l[3:] AS y, p_larea AS e FROM f_wide) "
    "SELECT vintage, y, round(e - first_value(e) OVER (PARTITION BY vintage ORDER BY y), 6) AS drift FROM e"
)
def recorded_area_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded area of the same apartment by year of sale, against the first year, by the building's vintage."""
    d = R.with_size(logged(spark, sf_dir), ["apt"], 2)
    d = d.withColumn("vintage", X.or_missing(F.when(F.col("built") >= 1980, "new").when(F.col("built").isNotNull(), "old")))
    return rounded(I.drift(d, "larea", "apt", "y", ["vintage"]), ["vintage", "y"], drift=6)


@query(
    LG + Q.effects("f", "lg", "bld", ["ym", "size"], ["lp"]) + ", e AS (SELECT bld, avg(q_lp) AS e, count(*) AS n FROM f_q GROUP BY bld) "
    "SELECT bld, round(e - (SELECT sum(e * n) / sum(n) FROM e), 6) AS effect, n FROM e"
)
def building_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.big_effects(logged(spark, sf_dir), "lp", ["bld", "ym", "size"]), ["bld", "n"], effect=6)


@query(
    LG + "b AS (SELECT bld, block, block || '|' || ym AS cell, lp FROM lg), it AS (SELECT 0 AS k, bld, block, cell, lp AS r, CAST(0 AS DOUBLE) AS c FROM b UNION ALL "
    "SELECT k + 1, bld, block, cell, r1 - avg(r1) OVER z, c + avg(r1) OVER z FROM (SELECT *, r - avg(r) OVER (PARTITION BY bld) AS r1 FROM it WHERE k < 200) WINDOW z AS (PARTITION BY cell)), "
    "e AS (SELECT block, cell, any_value(c) AS c FROM it WHERE k = 200 GROUP BY block, cell) "
    "SELECT block, count(*) AS months, round(stddev(c), 5) AS spread, round(arg_max(c, cell) - arg_min(c, cell), 5) AS change FROM e GROUP BY block"
)
def block_month_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-by-month effects with building effects, more levels than a Gram matrix is made for: their spread and their
    change from the first to the last month, per block. The SQL takes means in turn until they stand still."""
    d = logged(spark, sf_dir).withColumn("cell", F.concat_ws("|", "block", "ym"))
    e = E.level_effects(d, "lp", ["bld", "cell"]).withColumn("block", F.substring_index("level", "|", 1).cast("long"))
    out = e.groupBy("block", "component").agg(
        F.count("*").alias("months"), F.stddev("effect").alias("spread"), (F.max_by("effect", "level") - F.min_by("effect", "level")).alias("change")
    )
    return rounded(out, ["block", "months"], spread=5, change=5)


UNLINKED = (
    LG + Q.effects("f", "lg", "block", ["cell"], ["lp"]).replace("FROM lg ", "FROM (SELECT *, city || '|' || y AS cell FROM lg) ")
    + ", ed AS (SELECT DISTINCT block, '0:' || city || '|' || y AS l FROM lg), wk AS (SELECT DISTINCT l, l AS c FROM ed UNION SELECT b.l, wk.c FROM wk JOIN ed a ON a.l = wk.l JOIN ed b ON b.block = a.block), "
    "cp AS (SELECT l, min(c) AS c FROM wk GROUP BY l), base AS (SELECT min(l) AS l FROM f_wide) "
    "SELECT split_part(w.l[3:], '|', 1) AS city, CAST(split_part(w.l[3:], '|', 2) AS INTEGER) AS y, round(CASE WHEN cp.c = bc.c THEN w.p_lp - bw.p_lp END, 6) AS effect "
    "FROM f_wide w JOIN cp ON cp.l = w.l, base JOIN f_wide bw ON bw.l = base.l JOIN cp bc ON bc.l = base.l"
)


@query(UNLINKED)
def unlinked_city_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City-by-year effects with block effects, against the first one: a block lies in one city, so no other city's years are
    comparable with it, and they are NULL."""
    d = logged(spark, sf_dir).withColumn("cell", F.concat_ws("|", "city", "y"))
    e = E.level_effects(d, "lp", ["block", "cell"])
    first = e.agg(F.min("level").alias("_l"))
    out = E.comparable(e.crossJoin(F.broadcast(first)), [], F.col("level") == F.col("_l"))
    parts = F.split("level", r"\|")
    return out.select(F.get(parts, F.lit(0)).alias("city"), F.get(parts, F.lit(1)).cast("int").alias("y"), r6("effect").alias("effect"))


ROOMS = "rm AS (SELECT *, CAST(rooms = 2 AS INTEGER)::DOUBLE AS room2, CAST(rooms = 4 AS INTEGER)::DOUBLE AS room4, CAST(rooms = 6 AS INTEGER)::DOUBLE AS room6, y % 2 AS half FROM lg), "


def room_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = logged(spark, sf_dir)
    return d.select("*", *((F.col("rooms") == k).cast("double").alias(f"room{k}") for k in (2, 4, 6)))


def iv_row(fit: E.Fit, df: DataFrame, model: str) -> DataFrame:
    """(model, beta, se, first_stage_f, partial_r2), rounded."""
    x = fit.terms[0]
    row = [(model, float(fit.beta[0]), float(fit.se[0]), fit.first_stage_f.get(x), fit.partial_r2.get(x))]
    out = df.sparkSession.createDataFrame(row, "model string, beta double, se double, first_stage_f double, partial_r2 double")
    return rounded(out, ["model"], beta=6, se=6, first_stage_f=4, partial_r2=6)


def iv_sql(model: str, name: str) -> str:
    return f"SELECT '{model}' AS model, round(beta, 6) AS beta, round(se, 6) AS se, round(f, 4) AS first_stage_f, round(partial, 6) AS partial_r2 FROM {name}_fit"


def ols_sql(model: str, name: str, term: str) -> str:
    return f"SELECT '{model}' AS model, round(beta, 6) AS beta, round(se, 6) AS se, CAST(NULL AS DOUBLE) AS first_stage_f, CAST(NULL AS DOUBLE) AS partial_r2 FROM {name}_fit WHERE term = '{term}'"


@query(
    LG + ROOMS + Q.iv("v", "rm", "lprice", "larea", ["room2", "room4", "room6"], ["bld", "ym"], "block") + "," + Q.ols("o", "rm", "lprice", ["larea"], ["bld", "ym"], "block")
    + " " + iv_sql("iv", "v") + " UNION ALL " + ols_sql("ols", "o", "larea")
)
def iv_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log price on log area, with room dummies as instruments, building and month effects, clustered by block."""
    d = room_dummies(spark, sf_dir)
    fit = E.fe_2sls(d, "lprice", ["larea"], ["room2", "room4", "room6"], [], ["bld", "ym"], "block")
    return iv_row(fit, d, "iv").unionByName(iv_row(E.fe_ols(d, "lprice", ["larea"], ["bld", "ym"], "block"), d, "ols"))


def ols4(*a: str) -> str:
    return ols_sql(*a).replace(", 6)", ", 4)")


def iv4(*a: str) -> str:
    return iv_sql(*a).replace(", 4)", ", 2)").replace(", 6)", ", 4)")


def bias_sql() -> str:
    parts, out = [], []
    for period in ("early", "late"):
        src = f"SELECT * FROM rm WHERE y {'<' if period == 'early' else '>='} 1998"
        parts.append(f"s_{period} AS ({src})")
        for model, y, xs in (("price", "lprice", ["larea"]), ("per metre", "lp", ["larea"]), ("per metre, rooms alone", "lp", ["nrooms"])):
            name = f"{period}_{len(parts)}"
            parts.append(Q.ols(name, f"s_{period}", y, xs, ["block", "y"], "block"))
            out.append(f"SELECT '{period}' AS period, * FROM ({ols_sql(model, name, xs[0])})")
        parts.append(Q.iv(f"{period}_v", f"s_{period}", "lp", "larea", ["room2", "nrooms"], ["block", "y"], "block"))
        out.append(f"SELECT '{period}' AS period, * FROM ({iv_sql('per metre, iv', f'{period}_v')})")
    return ", ".join(parts) + " " + " UNION ALL ".join(out)


@query(LG + ROOMS + bias_sql())
def division_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in the area bias the slope of price per metre on it: log price, per metre, rooms in the area's place, and
    instrumented, by period."""
    models = [
        E.Model("price", "lprice", ("larea",), ("block", "y"), "block"),
        E.Model("per metre", "lp", ("larea",), ("block", "y"), "block"),
        E.Model("per metre, rooms alone", "lp", ("nrooms",), ("block", "y"), "block"),
        E.Model("per metre, iv", "lp", (), ("block", "y"), "block", None, ("larea",), ("room2", "nrooms")),
    ]
    d = room_dummies(spark, sf_dir).withColumn("period", F.when(F.col("y") < 1998, "early").otherwise("late"))
    return rounded(E.fitted_models(d, models, ["period"]), ["period", "model"], beta=6, se=6, first_stage_f=4, partial_r2=6)


@query(
    LG + ROOMS + Q.iv("v", "rm", "lprice", "larea", ["room2", "nrooms"], ["block", "ym"], "block") + ","
    + Q.index("i", "p_lprice - (SELECT beta FROM v_fit) * p_larea", "v_wide", "ym", BASE_M) + " SELECT ym, round(index, 4) AS index FROM i"
)
def iv_adjusted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = room_dummies(spark, sf_dir)
    fit = E.fe_2sls(d, "lprice", ["larea"], ["room2", "nrooms"], [], ["block", "ym"], "block")
    d = d.withColumn("rest", F.col("lprice") - float(fit.beta[0]) * F.col("larea"))
    return rounded(I.fe_index(d, "rest", "block", "ym", [], F.col("ym").startswith("1998")), ["ym"], index=4)


@query(
    LG + "nw AS (SELECT *, CAST(rooms >= 5 AS INTEGER)::DOUBLE AS fresh FROM lg), " + Q.ols("o", "nw", "lp", ["fresh"], ["bld", "ym", "size"], "bld")
    + " SELECT round(beta, 6) AS slope, round(exp(beta) - 1, 6) AS premium FROM o_fit"
)
def binary_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary premium by partialling out: both sides less building, month and size effects, then one slope."""
    d = logged(spark, sf_dir).withColumn("fresh", (F.col("rooms") >= 5).cast("double"))
    return rounded(I.partialled_premium(d, "lp", "fresh", ["bld", "ym", "size"]), [], slope=6, premium=6)


#: Context measures of a building; ``all`` is every one together.
MEASURES = ("height", "age", "homes")
CONTEXT = (
    Q.effects("f", "lg", "bld", ["y", "size"], ["lp"]) + ", e0 AS (SELECT bld, avg(q_lp) AS e, count(*) AS n, min(city) AS city FROM f_q GROUP BY bld), "
    "cx AS (SELECT bld, city, n, e - (SELECT sum(e * n) / sum(n) FROM e0) AS effect, CAST(least(n, 50) AS DOUBLE) AS w, ln(floors) AS height, "
    "(2001 - built) / 100.0 AS age, ln(n) AS homes, 0 AS one, CAST(kind = 'PROMO' AS INTEGER)::DOUBLE AS style FROM e0 JOIN reg USING (bld) WHERE n >= 3), "
)


def context_models() -> list[tuple[str, list[str], str]]:
    """(model, regressors, absorbed): each measure alone raw, within cities and with a control; then all together."""
    one = [(f"{m}{how}", [m, *more], by) for m in MEASURES for how, more, by in ((", raw", [], "one"), (", city", [], "city"), (", city and style", ["style"], "city"))]
    return [*one, ("all, raw", list(MEASURES), "one"), ("all, city", list(MEASURES), "city")]


@query(
    LG + CONTEXT + ", ".join(Q.ols(f"m{k}", "cx", "effect", xs, [by], "city", "w") for k, (_, xs, by) in enumerate(context_models()))
    + " " + fits_sql({m: f"m{k}" for k, (m, _, _) in enumerate(context_models())})
)
def premium_on_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building effects on context measures, weighted by min(n, 50), clustered by city: a family of models."""
    d = logged(spark, sf_dir)
    fe = E.big_effects(d, "lp", ["bld", "y", "size"]).join(register(spark, sf_dir), "bld")
    at = d.groupBy("bld").agg(F.min("city").alias("city"))
    rows = fe.join(at, "bld").where("n >= 3").select(
        "city", "effect", F.least("n", F.lit(50)).cast("double").alias("w"), F.ln("floors").alias("height"), ((2001 - F.col("built")) / 100).alias("age"),
        F.ln("n").alias("homes"), F.lit(0).alias("one"), (F.col("kind") == "PROMO").cast("double").alias("style"),
    )
    models = [E.Model(m, "effect", tuple(xs), (by,), "city", "w") for m, xs, by in context_models()]
    return rounded(E.fitted_models(rows, models), ["model", "term"], beta=6, se=6)


@query(
    LG + Q.effects("f", "lg", "bld", ["ym"], ["lprice", "larea"]) + ", q AS (SELECT list_sort(list_distinct(quantile_cont(r_larea, [0.05 * k for k in range(0, 21)])))[2:-2] AS e FROM f_res), "
    "v AS (SELECT r_larea AS x, r_lprice AS y, len(list_filter(e, lambda z: z < r_larea)) AS bin FROM f_res, q) "
    "SELECT 'bin' AS kind, CAST(bin AS VARCHAR) AS level, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM v GROUP BY bin "
    "UNION ALL SELECT 'rooms', CAST(rooms AS VARCHAR), count(*), round(avg(r_larea), 6), round(avg(r_lprice), 6) FROM f_res GROUP BY rooms"
)
def residual_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What building and month effects leave of price and area: means by bins of area, and by rooms (the visual IV)."""
    d = E.residualised(logged(spark, sf_dir), ["lprice", "larea"], ["bld", "ym"]).withColumn("one", F.lit(1.0))
    bins = R.binned_scatter(d, "r_larea", "r_lprice", "one", 20).select(F.lit("bin").alias("kind"), F.col("bin").cast("string").alias("level"), "n", "x", "y")
    rooms = d.groupBy("rooms").agg(F.count("*").alias("n"), F.avg("r_larea").alias("x"), F.avg("r_lprice").alias("y"))
    rooms = rooms.select(F.lit("rooms").alias("kind"), F.col("rooms").cast("string").alias("level"), "n", "x", "y")
    return rounded(bins.unionByName(rooms), ["kind", "level", "n"], x=6, y=6)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per register building with its city and a unit weight."""
    at = sample(spark, sf_dir).groupBy("bld").agg(F.min("block").alias("block"))
    u = register(spark, sf_dir).join(at, "bld").join(places(spark, sf_dir), "block")
    return u.select("city", "district", "built", F.lit(1.0).alias("one"), F.col("floors").cast("double").alias("floors"))


REGISTER = "reg JOIN (SELECT bld, min(block) AS block FROM a GROUP BY bld) USING (bld) JOIN places USING (block)"


def stock_sql(market: str, weight: str, name: str, source: str = REGISTER) -> str:
    """CTE ``name``({market}, year, h, stock): de-heaped, scaled and accumulated vintages of the register."""
    n = name
    return f"""
, {n}u AS (SELECT {market}, built, CAST({weight} AS DOUBLE) AS w FROM {source}),
{n}g AS (SELECT {market}, CAST(yr AS INTEGER) AS year FROM (SELECT DISTINCT {market} FROM {n}u), (SELECT unnest(range(1928, 2023)) AS yr)),
{n}h0 AS (SELECT g.{market}, g.year, coalesce(sum(u.w), 0) AS h, (g.year + 2) // 5 AS k FROM {n}g g LEFT JOIN {n}u u ON u.{market} = g.{market} AND u.built = g.year GROUP BY ALL),
{n}x AS (SELECT {market}, k, greatest(max(h) FILTER (WHERE year % 5 = 0) - median(h) FILTER (WHERE year % 5 <> 0), 0) AS x, count(*) AS c FROM {n}h0 GROUP BY ALL),
{n}h1 AS (SELECT {market}, year, h - CASE WHEN year % 5 = 0 AND c = 5 THEN x ELSE 0 END + CASE WHEN c = 5 THEN x / 5 ELSE 0 END AS h FROM {n}h0 JOIN {n}x USING ({market}, k)),
{n}sc AS (SELECT {market}, 1 + coalesce(coalesce(sum(w) FILTER (WHERE built IS NULL OR built NOT BETWEEN 1928 AND 2022), 0) / sum(w) FILTER (WHERE built BETWEEN 1928 AND 2022), 0) AS f FROM {n}u GROUP BY {market}),
{n} AS (SELECT {market}, year, h * f AS h, sum(h * f) OVER (PARTITION BY {market} ORDER BY year) AS stock FROM {n}h1 JOIN {n}sc USING ({market}))
"""


STOCK = stock_sql("district", "1.0", "st")


@query(STOCK + "SELECT district, year, round(h, 6) AS h, round(stock, 6) AS stock FROM st")
def stock_deheaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = U.stock(units(spark, sf_dir), ["district"], "built", "one", 1928, 2022)
    return s.select("district", "year", r6("h").alias("h"), r6("stock").alias("stock"))


@query(
    STOCK + ", n AS (SELECT year, sum(stock) AS n FROM st GROUP BY year), e AS (SELECT district, max(stock) FILTER (WHERE year = 1984) AS s0, max(stock) FILTER (WHERE year = 1997) AS s1 FROM st GROUP BY district), "
    "ne AS (SELECT max(n) FILTER (WHERE year = 1984) AS n0, max(n) FILTER (WHERE year = 1997) AS n1 FROM n) "
    "SELECT district, year, round(s1 + (s1 - s0) / (n1 - n0) * (n - n1), 6) AS predicted FROM st JOIN e USING (district) JOIN n USING (year), ne"
)
def predicted_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = U.stock(units(spark, sf_dir), ["district"], "built", "one", 1928, 2022)
    return U.predicted_stock(s, ["district"], 1984, 1997).select("district", "year", r6("predicted").alias("predicted"))


def supply_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City by year: the price index effect and lagged log stock, actual, predicted and in floors (years shifted onto the
    deals')."""
    d, u = logged(spark, sf_dir), units(spark, sf_dir)
    p = U.market_index(d, "lp", ["city"], "y", "bld", ["size"], 1998, 36)
    s = U.stock(u, ["city"], "built", "one", 1928, 2022)
    z = U.predicted_stock(s, ["city"], 1984, 1991).where("stock > 0 and predicted > 0")
    z = z.select("city", "year", F.ln("stock").alias("ls"), F.ln("predicted").alias("lz"))
    f = U.stock(u, ["city"], "built", "floors", 1928, 2022).where("stock > 0").select("city", "year", F.ln("stock").alias("lf"))
    return checkpointed(U.panel(p, z.join(f, ["city", "year"]), ["city"], "y"))


PANEL = (
    LG + "cellr AS (SELECT *, city || '|' || y AS cell FROM lg QUALIFY count(*) OVER (PARTITION BY bld) >= 2), cn AS (SELECT city, y, cell, count(*) AS n FROM cellr GROUP BY ALL), "
    + Q.effects("f", "cellr", "bld", ["cell", "size"], ["lp"]) + ", pe AS (SELECT city, y, p_lp AS e FROM f_wide JOIN cn ON l = '0:' || cell WHERE n >= 36), "
    "pi AS (SELECT p.city, p.y, p.e - b.e AS lp FROM pe p JOIN pe b ON b.city = p.city AND b.y = 1998) " + stock_sql("city", "1.0", "s1") + stock_sql("city", "floors", "s2")
    + ", sn AS (SELECT year, sum(stock) AS n FROM s1 GROUP BY year), se AS (SELECT city, max(stock) FILTER (WHERE year = 1984) AS s0, max(stock) FILTER (WHERE year = 1991) AS s1 FROM s1 GROUP BY city), "
    "ne AS (SELECT max(n) FILTER (WHERE year = 1984) AS n0, max(n) FILTER (WHERE year = 1991) AS n1 FROM sn), "
    "pz AS (SELECT city, year, stock, se.s1 + (se.s1 - s0) / nullif(n1 - n0, 0) * (n - n1) AS z FROM s1 JOIN se USING (city) JOIN sn USING (year), ne), "
    "pn AS (SELECT pi.city, pi.y, lp, ln(pz.stock) AS ls, ln(z) AS lz, ln(s2.stock) AS lf FROM pi JOIN pz ON pz.city = pi.city AND pz.year = pi.y - 1 "
    "JOIN s2 ON s2.city = pi.city AND s2.year = pi.y - 1 WHERE pz.stock > 0 AND z > 0 AND s2.stock > 0)"
)
@query(
    PANEL + ", " + Q.ols("o", "pn", "lp", ["ls"], ["city", "y"], "city") + "," + Q.iv("v", "pn", "lp", "ls", ["lz"], ["city", "y"], "city") + ","
    + Q.ols("t", "pn", "lp", ["ls"], ["city", "y"], "city", slopes=[("city", "y - 1998")]) + "," + Q.ols("h", "pn", "lp", ["ls", "lf"], ["city", "y"], "city")
    + " " + iv_sql("iv", "v") + " UNION ALL " + ols_sql("two-way", "o", "ls") + " UNION ALL " + ols_sql("trends", "t", "ls")
    + " UNION ALL " + ols_sql("race: homes", "h", "ls") + " UNION ALL " + ols_sql("race: floors", "h", "lf")
)
def panel_supply_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on lagged stock, two-way effects: OLS, instrumented, with market trends, and two measures in a race."""
    two_way = {"absorb": ("city", "y"), "cluster": "city"}
    models = [
        E.Model("two-way", "lp", ("ls",), **two_way),
        E.Model("iv", "lp", (), endogenous=("ls",), instruments=("lz",), **two_way),
        E.Model("trends", "lp", ("ls",), slope="t", **two_way),
        E.Model("race", "lp", ("ls", "lf"), **two_way),
    ]
    out = E.fitted_models(supply_panel(spark, sf_dir).withColumn("t", F.col("y") - 1998), models)
    race = F.when(F.col("term") == "ls", "race: homes").otherwise("race: floors")
    out = out.withColumn("model", F.when(F.col("model") == "race", race).otherwise(F.col("model")))
    return rounded(out, ["model"], beta=6, se=6, first_stage_f=4, partial_r2=6)


#: Periods by first and last year of sale; the tables hold seven years.
SPANS = ((1995, 1996), (1997, 1998), (1999, 2000))
SPAN_SQL = "CASE " + " ".join(f"WHEN y BETWEEN {a} AND {b} THEN {k}" for k, (a, b) in enumerate(SPANS)) + " END"
PERIODS = (
    LG + f"ps AS (SELECT *, {SPAN_SQL} AS t FROM lg), cellr AS (SELECT *, city || '|' || t AS cell FROM ps WHERE t IS NOT NULL QUALIFY count(*) OVER (PARTITION BY bld) >= 2), cn AS (SELECT city, t, cell, count(*) AS n FROM cellr GROUP BY ALL), "
    + Q.effects("f", "cellr", "bld", ["cell", "size"], ["lp"]) + ", pe AS (SELECT city, t, p_lp AS e FROM f_wide JOIN cn ON l = '0:' || cell WHERE n >= 50), "
    "pi AS (SELECT p.city, p.t, p.e - b.e AS lp FROM pe p JOIN pe b ON b.city = p.city AND b.t = 1) " + stock_sql("city", "1.0", "s1") + stock_sql("city", "floors", "s2")
    + ", zs AS (SELECT s.city, s.year, s.stock, " + "e.b + (e.b - e.f) / nullif(ne.b - ne.f, 0) * (n.stock - ne.b) AS z FROM s1 s JOIN (SELECT city, max(stock) FILTER (WHERE year = 1984) AS f, max(stock) FILTER (WHERE year = 1991) AS b FROM s1 GROUP BY city) e USING (city) "
    "JOIN (SELECT year, sum(stock) AS stock FROM s1 GROUP BY year) n USING (year), (SELECT sum(stock) FILTER (WHERE year = 1984) AS f, sum(stock) FILTER (WHERE year = 1991) AS b FROM s1) ne), "
    f"pn AS (SELECT pi.city, pi.t, lp, ln(zs.stock) AS ls, ln(greatest(z, 1)) AS lz, ln(s2.stock) AS lf FROM pi JOIN zs ON zs.city = pi.city AND zs.year = CASE pi.t {' '.join(f'WHEN {k} THEN {a - 1}' for k, (a, _) in enumerate(SPANS))} END "
    f"JOIN s2 ON s2.city = zs.city AND s2.year = zs.year WHERE zs.stock > 0 AND s2.stock > 0 AND z IS NOT NULL), bal AS (SELECT * FROM pn QUALIFY count(*) OVER (PARTITION BY city) = {len(SPANS)}), "
    "fd AS (SELECT city, t, lp - lag(lp) OVER c AS d_lp, ls - lag(ls) OVER c AS d_ls, lz - lag(lz) OVER c AS d_lz, lf - lag(lf) OVER c AS d_lf FROM bal WINDOW c AS (PARTITION BY city ORDER BY t)), fe AS (SELECT * FROM fd WHERE d_lp IS NOT NULL), "
)


@query(
    PERIODS + Q.ols("l", "bal", "lp", ["ls"], ["city", "t"], "city") + "," + Q.ols("lt", "bal", "lp", ["ls"], ["city", "t"], "city", slopes=[("city", "t")]) + ","
    + Q.ols("o", "fe", "d_lp", ["d_ls"], ["t"], "city") + "," + Q.ols("m", "fe", "d_lp", ["d_ls"], ["city", "t"], "city") + "," + Q.iv("v", "fe", "d_lp", "d_ls", ["d_lz"], ["t"], "city") + ","
    + Q.ols("h", "fe", "d_lp", ["d_ls", "d_lf"], ["t"], "city") + " " + ols4("levels", "l", "ls") + " UNION ALL " + ols4("levels, trends", "lt", "ls") + " UNION ALL " + ols4("differences", "o", "d_ls")
    + " UNION ALL " + ols4("differences, markets", "m", "d_ls") + " UNION ALL " + iv4("differences, iv", "v") + " UNION ALL " + ols4("race: homes", "h", "d_ls") + " UNION ALL " + ols4("race: floors", "h", "d_lf")
)
def first_difference_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of years, in markets that have all of them: prices on the stock before the period's first year, in levels
    (with and without market trends) and in changes (with market effects, instrumented, and two measures in a race)."""
    d, u = logged(spark, sf_dir), units(spark, sf_dir)
    p = U.period_index(d, "lp", ["city"], "y", SPANS, "bld", ["size"], 1, 50)
    s = U.stock(u, ["city"], "built", "one", 1928, 2022)
    z = U.predicted_stock(s, ["city"], 1984, 1991).where("stock > 0 and predicted is not null")
    z = z.select("city", "year", F.ln("stock").alias("ls"), F.ln(F.greatest("predicted", F.lit(1.0))).alias("lz"))
    f = U.stock(u, ["city"], "built", "floors", 1928, 2022).where("stock > 0").select("city", "year", F.ln("stock").alias("lf"))
    rows = R.balanced(checkpointed(p.join(z.join(f, ["city", "year"]), ["city", "year"])), ["city"], "t", len(SPANS))
    columns = ["lp", "ls", "lz", "lf"]
    moved = U.first_differences(rows, "city", "t", columns, len(SPANS)).withColumns({c: F.lit(None).cast("double") for c in columns})
    rows = rows.select("city", "t", *columns).withColumns({f"d_{c}": F.lit(None).cast("double") for c in columns}).unionByName(moved)
    level, change = {"cluster": "city", "where": "lp is not null"}, {"cluster": "city", "where": "d_lp is not null"}
    models = [
        E.Model("levels", "lp", ("ls",), ("city", "t"), **level),
        E.Model("levels, trends", "lp", ("ls",), ("city", "t"), slope="t", **level),
        E.Model("differences", "d_lp", ("d_ls",), ("t",), **change),
        E.Model("differences, markets", "d_lp", ("d_ls",), ("city", "t"), **change),
        E.Model("differences, iv", "d_lp", (), ("t",), endogenous=("d_ls",), instruments=("d_lz",), **change),
        E.Model("race", "d_lp", ("d_ls", "d_lf"), ("t",), **change),
    ]
    out = E.fitted_models(rows, models)
    race = F.when(F.col("term") == "d_ls", "race: homes").otherwise("race: floors")
    out = out.withColumn("model", F.when(F.col("model") == "race", race).otherwise(F.col("model")))
    return rounded(out, ["model"], beta=4, se=4, first_stage_f=2, partial_r2=4)


@query(
    PANEL + ", ld AS (SELECT city, 0 AS one, max(lp) FILTER (WHERE y = 2000) - max(lp) FILTER (WHERE y = 1996) AS d_lp, max(ls) FILTER (WHERE y = 2000) - max(ls) FILTER (WHERE y = 1996) AS d_ls FROM pn GROUP BY city), "
    + Q.ols("o", "ld", "d_lp", ["d_ls"], ["one"], None) + " " + fits_sql({"long": "o"})
)
def long_difference_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = U.long_difference(supply_panel(spark, sf_dir), "city", "y", ["lp", "ls"], 1996, 2000)
    return estimates({"long": E.pooled_ols(d, "d_lp", ["d_ls"])}, d)


@query(
    LG + "st AS (SELECT city, count(*) AS homes FROM (SELECT bld, min(block) AS block FROM a GROUP BY bld) JOIN places USING (block) GROUP BY city), "
    "ct AS (SELECT city, avg(lp) AS lp, count(DISTINCT apt) AS heads FROM lg GROUP BY city), xs AS (SELECT city, lp, ln(homes / heads) AS per_head, 0 AS one FROM ct JOIN st USING (city)), "
    + Q.ols("o", "xs", "lp", ["per_head"], ["one"], None) + " " + fits_sql({"levels": "o"})
)
def cross_section_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City mean price on log buildings per apartment, in levels."""
    d = logged(spark, sf_dir)
    c = d.groupBy("city").agg(F.avg("lp").alias("lp"), F.count_distinct("apt").alias("heads"))
    n = units(spark, sf_dir).groupBy("city").agg(F.count("*").alias("homes"))
    rows = c.join(n, "city").withColumn("per_head", F.ln(F.col("homes") / F.col("heads")))
    return estimates({"levels": U.cross_section(rows, "lp", "per_head")}, rows)


GRID_AXES = ["geo", "split", "per"]


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale under each definition: area (city, district, all), size (all, rooms) and period (annual, spans)."""
    d = logged(spark, sf_dir).withColumn("class", X.room_class("rooms"))
    d = R.scenarios(d, geo=["city", "district", "all"], split=["all", "rooms"], per=["annual", "spans"]).where("geo <> 'all' or split <> 'all'")
    span = reduce(lambda out, k: out.when(F.col("y").between(*SPANS[k]), k), range(1, len(SPANS)), F.when(F.col("y").between(*SPANS[0]), 0))
    d = d.withColumn("t", F.when(F.col("per") == "annual", F.col("y")).otherwise(span)).where("t is not null").withColumnRenamed("area", "m2")
    d = d.withColumn("place", F.when(F.col("geo") == "city", F.col("city")).when(F.col("geo") == "district", F.col("district")).otherwise("all"))
    return d.withColumn("sized", F.when(F.col("split") == "rooms", F.col("class")).otherwise("all"))


def grid_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(geo, split, area, size, year, s_n, z_n, s_val, z_val): logs of the actual and the predicted stock of every market."""
    sales = sample(spark, sf_dir)
    shares = R.shares(sales.withColumn("class", X.room_class("rooms")), ["bld"], "class", ["2", "3", "4", "5"]).select("bld", F.col("class").alias("size"), "share")
    at = sales.groupBy("bld").agg(F.min("block").alias("block"))
    u = register(spark, sf_dir).join(at, "bld").join(places(spark, sf_dir), "block").select("bld", "city", "district", "built", F.col("floors").cast("double").alias("floors"))
    one = u.select("*", F.lit("all").alias("split"), F.lit("all").alias("size"), F.lit(1.0).alias("n"))
    u = one.unionByName(u.join(shares, "bld").select(*u.columns, F.lit("rooms").alias("split"), "size", F.col("share").alias("n"))).where("n > 0")
    geo = F.explode(F.array(*(F.struct(F.lit(g).alias("geo"), v.alias("area")) for g, v in (("city", F.col("city")), ("district", F.col("district")), ("all", F.lit("all"))))))
    u = u.withColumn("val", F.col("n") * F.col("floors")).withColumn("_g", geo).select("*", "_g.*")
    market, out = ["geo", "split", "area", "size"], None
    for m in ("n", "val"):
        s = checkpointed(U.stock(u, market, "built", m, 1928, 2022))
        nation = s.where("geo = 'all' and split = 'all'").select("year", F.col("stock").alias("n"))
        z = U.predicted_stock(s, market, 1984, 1991, nation).where("stock > 0")
        z = z.select(*market, "year", F.ln("stock").alias(f"s_{m}"), F.ln(F.greatest("predicted", F.lit(1.0))).alias(f"z_{m}"))
        out = z if out is None else out.join(z, [*market, "year"])
    return out


def grid_sql() -> str:
    span = "CASE " + " ".join(f"WHEN y BETWEEN {a} AND {b} THEN {k}" for k, (a, b) in enumerate(SPANS)) + " END"
    before = "CASE t " + " ".join(f"WHEN {k} THEN {a - 1}" for k, (a, _) in enumerate(SPANS)) + " END"
    keys = ["def", "wt"]
    parts = [
        "gd AS (SELECT *, unnest(['city', 'district', 'all']) AS geo FROM lg), ge AS (SELECT *, unnest(['all', 'rooms']) AS split FROM gd), gp AS (SELECT *, unnest(['annual', 'spans']) AS per FROM ge)",
        f"gr AS (SELECT *, geo || '|' || split || '|' || per AS def, CASE geo WHEN 'city' THEN city WHEN 'district' THEN district ELSE 'all' END || '|' || CASE split WHEN 'all' THEN 'all' ELSE "
        f"CASE WHEN rooms < 3 THEN '2' WHEN rooms < 4 THEN '3' WHEN rooms < 5 THEN '4' ELSE '5' END END AS m, CASE per WHEN 'annual' THEN y ELSE {span} END AS t FROM gp WHERE geo <> 'all' OR split <> 'all')",
        "gs AS (SELECT *, m || '#' || t AS cell FROM gr WHERE t IS NOT NULL QUALIFY count(*) OVER (PARTITION BY def, bld) >= 2), gn AS (SELECT def, geo, split, per, m, t, cell, count(*) AS n FROM gs GROUP BY ALL)",
        Q.effects("gf", "gs", "bld", ["cell", "size"], ["lp"], ["def"]),
        "gk AS (SELECT gn.*, p_lp AS e FROM gn JOIN gf_wide w ON w.def = gn.def AND l = '0:' || cell WHERE n >= CASE per WHEN 'annual' THEN 30 ELSE 50 END)",
        "gi AS (SELECT a.*, a.e - b.e AS lp FROM gk a JOIN gk b ON a.def = b.def AND a.m = b.m AND b.t = CASE b.per WHEN 'annual' THEN 1998 ELSE 1 END)",
        "gu0 AS (SELECT bld, CASE WHEN rooms < 3 THEN '2' WHEN rooms < 4 THEN '3' WHEN rooms < 5 THEN '4' ELSE '5' END AS size, count(*) AS n FROM a GROUP BY ALL)",
        f"gu1 AS (SELECT bld, city, district, built, floors, 'all' AS split, 'all' AS size, CAST(1 AS DOUBLE) AS n FROM {REGISTER} UNION ALL SELECT bld, city, district, built, floors, 'rooms', size, n / sum(n) OVER (PARTITION BY bld) FROM {REGISTER} JOIN gu0 USING (bld))",
        "gu AS (SELECT *, g.geo || '|' || split || '|' || g.v || '|' || size AS m FROM (SELECT *, unnest([{geo: 'city', v: city}, {geo: 'district', v: district}, {geo: 'all', v: 'all'}]) AS g FROM gu1))",
    ]
    text = ", ".join(parts)
    for w, weight in (("n", "n"), ("val", "n * floors")):
        text += stock_sql("m", weight, f"gt{w}", "gu")
        text += (
            f", gz{w} AS (SELECT s.m, s.year, ln(s.stock) AS s, ln(greatest(e.b + (e.b - e.f) / nullif(ne.b - ne.f, 0) * (na.stock - ne.b), 1)) AS z FROM gt{w} s "
            f"JOIN (SELECT m, max(stock) FILTER (WHERE year = 1984) AS f, max(stock) FILTER (WHERE year = 1991) AS b FROM gt{w} GROUP BY m) e USING (m) JOIN gt{w} na ON na.m = 'all|all|all|all' AND na.year = s.year, "
            f"(SELECT max(stock) FILTER (WHERE year = 1984) AS f, max(stock) FILTER (WHERE year = 1991) AS b FROM gt{w} WHERE m = 'all|all|all|all') ne WHERE s.stock > 0)"
        )
    text += (
        f", gj AS (SELECT gi.*, a.s AS s_n, a.z AS z_n, b.s AS s_val, b.z AS z_val FROM gi JOIN gzn a ON a.m = geo || '|' || split || '|' || gi.m AND a.year = CASE per WHEN 'annual' THEN t - 1 ELSE {before} END "
        "JOIN gzval b ON b.m = a.m AND b.year = a.year WHERE a.z IS NOT NULL AND b.z IS NOT NULL), "
        "gw AS (SELECT *, unnest([{wt: 'n', s: s_n, z: z_n}, {wt: 'val', s: s_val, z: z_val}]) AS v FROM gj), "
        "gl AS (SELECT def, geo, split, per, m, t, lp, v.wt AS wt, v.s AS s, v.z AS z, split_part(m, '|', 1) || '#' || t AS gt, split_part(m, '|', 2) || '#' || t AS st FROM gw), "
        f"gb AS (SELECT * FROM gl WHERE per = 'spans' QUALIFY count(*) OVER (PARTITION BY def, wt, m) = {len(SPANS)}), "
        "gc AS (SELECT * REPLACE (lp - lag(lp) OVER o AS lp, s - lag(s) OVER o AS s, z - lag(z) OVER o AS z) FROM gb WINDOW o AS (PARTITION BY def, wt, m ORDER BY t)), "
        "gq AS (SELECT * FROM gc WHERE lp IS NOT NULL), ga AS (SELECT * FROM gl WHERE per = 'annual'), gx AS (SELECT * FROM gl WHERE split = 'rooms' AND geo <> 'all'), gy AS (SELECT * FROM gq WHERE split = 'rooms' AND geo <> 'all'), "
    )
    values = ["lp", "s", "z"]
    text += ", ".join([
        Q.effects("h1", "gl", "m", ["t"], values, keys), Q.effects("h2", "ga", "m", ["t"], values, keys, slopes=[("m", "t - 1998")]),
        Q.effects("h3", "gx", "m", ["gt", "st"], values, keys), Q.effects("h4", "gq", "t", [], values, keys), Q.effects("h5", "gy", "gt", ["st"], values, keys),
    ])
    fits = (("fe", "h1", "r_s", "true"), ("tr", "h2", "r_s", "true"), ("cross", "h3", "r_s", "true"), ("iv", "h1", "r_z", "per = 'annual'"), ("dif", "h4", "r_s", "true"), ("difiv", "h4", "r_z", "true"), ("difcross", "h5", "r_s", "true"))
    out = []
    for model, source, z, where in fits:
        k = f"y{len(out)}"
        text += (
            f", {k}b AS (SELECT def, wt, sum({z} * r_lp) / sum({z} * r_s) AS beta, sum({z} * r_s) AS zs, sum({z} * {z}) AS zz, sum({z} * r_s) / sum({z} * {z}) AS pi, sum(r_lp * r_lp) AS yy FROM {source}_res WHERE {where} GROUP BY ALL HAVING abs(sum({z} * r_s)) > 1e-9), "
            f"{k}e AS (SELECT *, {z} * (r_lp - beta * r_s) AS sc, {z} * (r_s - pi * {z}) AS fs, r_lp - beta * r_s AS er FROM {source}_res JOIN {k}b USING (def, wt) WHERE {where}), "
            f"{k}c AS (SELECT def, wt, any_value(beta) AS beta, any_value(zs) AS zs, any_value(zz) AS zz, any_value(pi) AS pi, any_value(yy) AS yy, sum(sc) AS sc, sum(fs) AS fs, sum(sc * sc) AS hc, sum(er * er) AS rss, count(*) AS n FROM {k}e GROUP BY def, wt, m)"
        )
        f = "round(any_value(pi) ** 2 / (sum(fs * fs) * count(*) / (count(*) - 1) / any_value(zz) ** 2), 2)" if z == "r_z" else "CAST(NULL AS DOUBLE)"
        out.append(
            f"SELECT def, '{model}_' || wt AS model, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, round(any_value(beta), 4) AS beta, round(sqrt(sum(sc * sc) * count(*) / (count(*) - 1)) / abs(any_value(zs)), 4) AS se, "
            f"round(sqrt(sum(hc)) / abs(any_value(zs)), 4) AS se_hc, round(1 - sum(rss) / any_value(yy), 4) AS r2_within, {f} AS first_stage_f FROM {k}c GROUP BY def, wt HAVING count(*) > 1"
        )
    return text + " SELECT split_part(def, '|', 1) AS geo, split_part(def, '|', 2) AS split, split_part(def, '|', 3) AS per, * EXCLUDE (def) FROM (" + " UNION ALL ".join(out) + ")"


@query(LG + grid_sql())
def market_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on lagged stock under every definition of area, size and period, with effects, trends, crossed effects,
    instruments and differences: all in one batch."""
    annual = F.col("per") == "annual"
    d = definitions(spark, sf_dir)
    p = U.market_index(
        d, "lp", ["place", "sized"], "t", "bld", ["size"], F.when(annual, 1998).otherwise(1), F.when(annual, 30).otherwise(50), GRID_AXES
    ).withColumnsRenamed({"place": "area", "sized": "size"}).drop("n")
    first = F.element_at(F.create_map(*(F.lit(x) for k, (a, _) in enumerate(SPANS) for x in (k, a))), F.col("t"))
    p = p.withColumn("year", F.when(annual, F.col("t")).otherwise(first) - 1)
    cells = p.join(grid_stock(spark, sf_dir), ["geo", "split", "area", "size", "year"]).drop("year")
    cells = cells.select("*", annual.alias("annual"), (F.col("split") == "rooms").alias("by_size"), (F.col("geo") == "all").alias("whole"))
    out = U.definition_grid(cells.withColumn("t", F.when(annual, F.col("t") - 1998).otherwise(F.col("t"))), GRID_AXES, ["n", "val"], len(SPANS))
    return rounded(out.where("clusters > 1"), [*GRID_AXES, "model", "n", "clusters"], beta=4, se=4, se_hc=4, r2_within=4, first_stage_f=2)


NW = (
    LG + "pm AS (SELECT district, ym, avg(lp) FILTER (WHERE rooms >= 4) - avg(lp) FILTER (WHERE rooms <= 3) AS rel, "
    "ln(count(*) FILTER (WHERE rooms >= 4) / nullif(count(*) FILTER (WHERE rooms <= 3), 0)) AS q, CAST(datediff('month', DATE '1995-01-01', CAST(ym || '-01' AS DATE)) AS DOUBLE) AS t FROM lg GROUP BY ALL), "
    "s AS (SELECT * FROM pm WHERE rel IS NOT NULL AND q IS NOT NULL AND isfinite(q)), "
    "g AS (SELECT district, [[1.0 * count(*), sum(q), sum(t), sum(rel), 1, 0, 0], [sum(q), sum(q * q), sum(q * t), sum(q * rel), 0, 1, 0], [sum(t), sum(q * t), sum(t * t), sum(t * rel), 0, 0, 1]] AS m FROM s GROUP BY district), "
    + Q.gauss("i", "g", ["district"])
    + ", u AS (SELECT s.district, t, [(rel - i.m[1][4] - i.m[2][4] * q - i.m[3][4] * t) * z for z in [1.0, q, t]] AS u FROM s JOIN i USING (district)), "
    "ul AS (SELECT district, u, lag(u, 1) OVER w AS u1, lag(u, 2) OVER w AS u2 FROM u WINDOW w AS (PARTITION BY district ORDER BY t)), "
    "pr AS (SELECT district, a, b, sum(u[a] * u[b] + coalesce(2.0 / 3 * (u[a] * u1[b] + u1[a] * u[b]), 0) + coalesce(1.0 / 3 * (u[a] * u2[b] + u2[a] * u[b]), 0)) AS v "
    "FROM ul, (SELECT unnest(range(1, 4)) AS a), (SELECT unnest(range(1, 4)) AS b) GROUP BY ALL), "
    "se AS (SELECT district, k, sqrt(greatest(sum(m[k][4 + a] * v * m[k][4 + b]), 0)) AS se FROM pr JOIN i USING (district), (SELECT unnest(range(1, 4)) AS k) GROUP BY ALL) "
    "SELECT district, ['const', 'q', 't'][k] AS term, round(m[k][4], 6) AS beta, round(se, 6) AS se FROM se JOIN i USING (district)"
)


@query(NW)
def newey_west_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative price of large to small dwellings on their relative number and a trend, Newey-West errors."""
    large, small = F.col("rooms") >= 4, F.col("rooms") <= 3
    m = logged(spark, sf_dir).groupBy("district", "ym").agg(
        (F.avg(F.when(large, F.col("lp"))) - F.avg(F.when(small, F.col("lp")))).alias("rel"), F.ln(X.divided(F.count_if(large), F.count_if(small))).alias("q")
    )
    t = m.withColumn("t", F.months_between(F.to_date(F.concat("ym", F.lit("-01"))), F.lit("1995-01-01").cast("date")))
    return rounded(U.newey_west(t, ["district"], "t", "rel", ["q", "t"]), ["district", "term"], beta=6, se=6)


@query(
    ", c AS (SELECT district, y, CASE WHEN rooms < 3 THEN '2' WHEN rooms < 4 THEN '3' WHEN rooms < 5 THEN '4' ELSE '5' END AS size, count(*) AS n "
    "FROM a JOIN places USING (block) GROUP BY ALL) SELECT district, y, size, n, "
    "CAST(sum(n) OVER (PARTITION BY district, y) - n AS BIGINT) AS other_sizes, CAST(sum(n) OVER (PARTITION BY size, y) - n AS BIGINT) AS elsewhere, CAST(sum(n) OVER (PARTITION BY y) AS BIGINT) AS nation FROM c"
)
def cross_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(places(spark, sf_dir), "block").withColumn("size", X.room_class("rooms"))
    c = d.groupBy("district", "y", "size").agg(F.count("*").alias("n"))
    return U.other_supply(c, "size", "district", "y", "n")


MEDIANS = (
    ", m AS (SELECT district, CASE WHEN rooms < 3 THEN '2' WHEN rooms < 4 THEN '3' WHEN rooms < 5 THEN '4' ELSE '5' END AS size, "
    "median(price) AS p, median(area) AS m2 FROM a JOIN places USING (block) GROUP BY ALL) "
)


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(places(spark, sf_dir), "block").withColumn("size", X.room_class("rooms"))
    of = lambda value, out: selection.medians(d, ["district", "size"], value, out)
    return of("price", "p").join(of("area", "m2"), ["district", "size"])


@query(
    MEDIANS + "SELECT m.district, m.size, round((m.p * r.m2 - r.p * m.m2) / nullif(r.m2 - m.m2, 0), 4) AS break_even, "
    "round(m.m2 * s.p / s.m2 / m.p, 6) AS split_value FROM m JOIN m r ON r.district = m.district AND r.size = '4' "
    "JOIN m s ON s.district = m.district AND s.size = '2' WHERE m.size NOT IN ('4', '2')"
)
def break_even_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = medians(spark, sf_dir)
    b = U.break_even(m, "district", "size", "p", "m2", "4")
    v = U.split_value(m, "district", "size", "p", "m2", "2")
    return b.join(v, ["district", "size"]).select("district", "size", r6("break_even", 4).alias("break_even"), r6("split_value").alias("split_value"))


@query(
    ", u AS (SELECT district, CASE WHEN floors BETWEEN 1 AND 3 THEN 5000 WHEN floors >= 9 THEN 8000 ELSE 6500 END AS cost, units FROM reg JOIN "
    "(SELECT bld, min(block) AS block, count(*) AS units FROM a GROUP BY bld) USING (bld) JOIN places USING (block)), "
    "g AS (SELECT district, sum(cost * units) AS c, sum(units) AS w FROM u GROUP BY district) "
    "SELECT district, round(c / w, 4) AS cost, round(c / w / (SELECT sum(c) / sum(w) FROM g), 6) AS relative FROM g"
)
def regional_cost_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sample(spark, sf_dir).groupBy("bld").agg(F.min("block").alias("block"), F.count("*").alias("units"))
    u = register(spark, sf_dir).join(at, "bld").join(places(spark, sf_dir), "block")
    u = u.withColumn("cost", F.when(F.col("floors").between(1, 3), 5000).when(F.col("floors") >= 9, 8000).otherwise(6500))
    return U.cost_index(u, "district", "cost", "units").select("district", r6("cost", 4).alias("cost"), r6("relative").alias("relative"))


@query(
    MEDIANS + ", b AS (SELECT m.district, m.size, m.p, m.m2, (m.p * r.m2 - r.p * m.m2) / nullif(r.m2 - m.m2, 0) AS be FROM m JOIN m r ON r.district = m.district AND r.size = '4' WHERE m.size <> '4'), "
    "k AS (SELECT *, unnest([0.0, 0.5, 1.0]) AS spaces FROM b) "
    "SELECT district, size, CAST(spaces AS DOUBLE) AS spaces, round(be - m2 * 700 - spaces * 35 * 300, 4) AS margin, round((be - m2 * 700 - spaces * 35 * 300) / p, 6) AS margin_share FROM k"
)
def cost_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = U.break_even(medians(spark, sf_dir), "district", "size", "p", "m2", "4")
    costs = b.select("district", "size", (F.col("m2") * 700).alias("unit_cost"), F.lit(300.0).alias("underground"))
    out = U.margins(b, costs, ["district", "size"], "p", [0.0, 0.5, 1.0])
    return rounded(out, ["district", "size", "spaces"], margin=4, margin_share=6)
