"""Queries of reports, sets, recodings and composition tables, and of the sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrain.functions import exprs as X
from landgrain.operators import relational as R
from landgrain.operators import supply as U
from landgrain.operators.components import shared_folder
from landgrain.plans.base import deals, places, query, r6, register, sample, table
from landgrain.plans.estimates import LG, REGISTER, logged, rounded, stock_sql, units
from landgrain.sources import tables as S

CLASS = "CASE WHEN rooms < 3 THEN '2' WHEN rooms < 4 THEN '3' WHEN rooms < 5 THEN '4' ELSE '5' END"


@query(", c AS (SELECT city, count(*) AS n FROM a JOIN places USING (block) GROUP BY city HAVING count(*) >= 50) SELECT city, n FROM c ORDER BY n DESC, city LIMIT 20")
def largest_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.largest(sample(spark, sf_dir).join(places(spark, sf_dir), "block"), ["city"], 20, 50)


@query("SELECT city, district, count(*) AS n FROM a JOIN places USING (block) GROUP BY ALL HAVING count(*) >= 100 ORDER BY n DESC, city")
def cities_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(places(spark, sf_dir), "block")
    return R.ordered_report(d, ["city", "district"], 100, F.desc("n"), "city")


@query(
    ", x AS (SELECT DISTINCT bld FROM a WHERE y <= 1996), z AS (SELECT DISTINCT bld FROM a WHERE y >= 2000) "
    "SELECT 'either' AS kind, CAST(bld AS VARCHAR) AS key FROM (SELECT bld FROM x UNION SELECT bld FROM z) "
    "UNION ALL SELECT 'first only', CAST(bld AS VARCHAR) FROM (SELECT bld FROM x EXCEPT SELECT bld FROM z) "
    "UNION ALL SELECT 'all classes', ym FROM (SELECT ym FROM a GROUP BY ym HAVING count(DISTINCT rooms) = (SELECT count(DISTINCT rooms) FROM a))"
)
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings sold early or late, those sold early only, and months in which every number of rooms was sold."""
    d = sample(spark, sf_dir)
    x, z = d.where("y <= 1996").select("bld"), d.where("y >= 2000").select("bld")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), df[df.columns[0]].cast("string").alias("key"))
    out = named(R.key_union(x, z), "either").union(named(R.key_difference(x, z), "first only"))
    return out.union(named(R.in_all_classes(d, "ym", "rooms"), "all classes"))


@query(
    LG + "m AS (SELECT bld, y, median(lp) AS m FROM lg GROUP BY ALL) SELECT rooms, count(*) AS n, round(avg(lp), 6) AS lp FROM lg JOIN m USING (bld, y) WHERE lp > m + ln(0.8) GROUP BY rooms"
)
def trimmed_by_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log price by rooms without sales over 20 % under their building-year's median."""
    d = R.trimmed(logged(spark, sf_dir), ["bld", "y"], "lp")
    return d.groupBy("rooms").agg(F.count("*").alias("n"), r6(F.avg("lp")).alias("lp"))


@query(
    ", b AS (SELECT *, ntile(7) OVER (ORDER BY ppm, ok, rooms, bld, dt, price, area, block) - 1 AS bin FROM a) "
    "SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(min(ppm), 6) AS low, round(max(ppm), 6) AS high, round(avg(area), 6) AS area FROM b GROUP BY bin"
)
def rank_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales in seven parts of equal size by price per metre."""
    d = R.rank_bins(sample(spark, sf_dir), "ppm", ["ok", "rooms", "bld", "dt", "price", "area", "block"], 7)
    return d.groupBy("bin").agg(F.count("*").alias("n"), r6(F.min("ppm")).alias("low"), r6(F.max("ppm")).alias("high"), r6(F.avg("area")).alias("area"))


@query(
    LG + f"c AS (SELECT y, {CLASS} AS size, avg(lp) AS p, ln(count(*)) AS q FROM lg GROUP BY ALL), "
    "g AS (SELECT *, p - avg(p) OVER (PARTITION BY y) AS gp, q - avg(q) OVER (PARTITION BY y) AS gq FROM c) "
    "SELECT size, y, round(gp - first_value(gp) OVER w, 6) AS price, round(gq - first_value(gq) OVER w, 6) AS stock FROM g WINDOW w AS (PARTITION BY size ORDER BY y)"
)
def relative_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and number of each size against the mean over sizes, 0 in the first year."""
    d = logged(spark, sf_dir).withColumn("size", X.room_class("rooms"))
    c = d.groupBy("y", "size").agg(F.avg("lp").alias("p"), F.ln(F.count("*")).alias("q"))
    out = R.relative_to_classes(R.relative_to_classes(c, "y", "size", "p", "price"), "y", "size", "q", "stock")
    return rounded(out, ["size", "y"], price=6, stock=6)


@query(
    ", m AS (SELECT sum(area * ppm) / sum(area) AS m, sum(area) AS s, sum(area * area) AS s2, sum(area * ppm * ppm) AS xx, sum(area * ppm) AS x FROM a), "
    "v AS (SELECT m, sqrt((xx - x * x / s) / (s - s2 / s)) AS sd FROM m) "
    "SELECT district, round(avg((ppm - m) / sd), 6) AS z, round(10 * avg(CASE WHEN rooms >= 4 THEN 1.0 ELSE 0 END), 6) AS tenths, round(avg(ln(area)), 6) AS log FROM a JOIN places USING (block), v GROUP BY district"
)
def scaled_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three scales of regressors: a weighted z-score, a share in tenths and a log."""
    d = R.standardised(sample(spark, sf_dir), "ppm", "area", "z").join(places(spark, sf_dir), "block")
    tenths = 10 * F.avg((F.col("rooms") >= 4).cast("double"))
    return d.groupBy("district").agg(r6(F.avg("z")).alias("z"), r6(tenths).alias("tenths"), r6(F.avg(F.ln("area"))).alias("log"))


@query(
    ", l AS (SELECT kind, min(brand) AS t FROM reg WHERE floors > 25 AND kind <> 'LARGE' GROUP BY kind HAVING min(brand) < 'Brand#12'), d AS (SELECT kind, min(street) AS t FROM reg GROUP BY kind) "
    "SELECT kind, CASE kind WHEN 'SMALL' THEN 'little' WHEN 'PROMO' THEN 'offer' ELSE coalesce(l.t, d.t) END AS label, count(*) AS n FROM reg LEFT JOIN l USING (kind) LEFT JOIN d USING (kind) GROUP BY ALL"
)
def labels_with_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = register(spark, sf_dir)
    labels = r.where("floors > 25 and kind <> 'LARGE'").groupBy("kind").agg(F.min("brand").alias("text")).where("text < 'Brand#12'")
    dictionary = r.groupBy("kind").agg(F.min("street").alias("text"))
    out = R.labelled(r, "kind", {"SMALL": "little", "PROMO": "offer"}, labels, dictionary)
    return out.groupBy("kind", "label").agg(F.count("*").alias("n"))


@query(
    ", c AS (SELECT city, y, median(ppm) AS p FROM a JOIN places USING (block) GROUP BY ALL), g AS (SELECT DISTINCT city FROM c), t AS (SELECT unnest(range(1994, 2003)) AS y) "
    "SELECT g.city AS city, CAST(t.y AS VARCHAR) AS year, round(p, 3) AS ppm FROM g JOIN t ON true LEFT JOIN c ON c.city = g.city AND c.y = t.y"
)
def city_year_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median price by city and year as a complete matrix, stacked again."""
    d = sample(spark, sf_dir).join(places(spark, sf_dir), "block")
    wide = R.matrix(d, "city", "y", list(range(1994, 2003)), F.median("ppm"))
    return rounded(R.stacked(wide, "city", "year", "ppm"), ["city", "year"], ppm=3)


@query(
    LG + "w AS (SELECT unnest([{a: 'lp', b: 'larea', c: corr(lp, larea)}, {a: 'lp', b: 'nrooms', c: corr(lp, nrooms)}, {a: 'lp', b: 'floors', c: corr(lp, floors)}, {a: 'larea', b: 'nrooms', c: corr(larea, nrooms)}, "
    "{a: 'larea', b: 'floors', c: corr(larea, floors)}, {a: 'nrooms', b: 'floors', c: corr(nrooms, floors)}]) AS p FROM lg), "
    "s AS (SELECT block, y, avg(lp) AS v FROM lg GROUP BY ALL), t AS (SELECT s.y AS y, corr(s.v, u.v) AS c FROM s JOIN s u ON u.block = s.block AND u.y = s.y - 1 GROUP BY s.y) "
    "SELECT p.a AS a, p.b AS b, round(p.c, 6) AS corr FROM w UNION ALL SELECT 'block', CAST(y AS VARCHAR), round(c, 6) FROM t"
)
def correlation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of correlations of sales' measures, and how blocks' prices correlate from year to year."""
    d = logged(spark, sf_dir)
    pairs = R.correlations(d, ["lp", "larea", "nrooms", "floors"])
    years = R.stability(d, "block", "y", F.avg("lp")).select(F.lit("block").alias("a"), F.col("y").cast("string").alias("b"), "corr")
    return rounded(pairs.union(years), ["a", "b"], corr=6)


@query(
    ", b AS (SELECT block, median(ppm) AS m, avg(ppm) AS t FROM a GROUP BY block) SELECT district, round(avg(m / t), 6) AS ratio, round(avg(abs(m / t - 1)), 6) AS mape, round(corr(m, t), 6) AS corr "
    "FROM b JOIN places USING (block) GROUP BY district"
)
def agreement_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sample(spark, sf_dir).groupBy("block").agg(F.median("ppm").alias("m"), F.avg("ppm").alias("t")).join(places(spark, sf_dir), "block")
    return rounded(R.agreement(b, ["district"], "m", "t"), ["district"], ratio=6, mape=6, corr=6)


@query(
    "SELECT street, count(*) AS units, max(floors) AS floors, median(built) FILTER (WHERE built BETWEEN 1940 AND 2010) AS built, round(avg(CASE WHEN built >= 2000 THEN 1.0 ELSE 0 END), 6) AS new_share FROM reg GROUP BY street"
)
def register_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rolled_up(register(spark, sf_dir), ["street"], "floors", "built", 1940, 2010, 2000).select("street", "units", "floors", "built", r6("new_share").alias("new_share"))


@query(
    "SELECT user_id AS place, count(*) AS valid, count(*) FILTER (WHERE event_type = 'view') AS h, count(*) FILTER (WHERE event_type IN ('click', 'error')) AS u, round(median(value), 6) AS at, "
    "round(count(*) FILTER (WHERE event_type IN ('click', 'error')) / count(*), 6) AS share FROM events GROUP BY user_id"
)
def polling_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ballot boxes summed to their place, which lies at the boxes' median."""
    e = table(spark, sf_dir, "events")
    p = R.places_of_boxes(e.withColumnRenamed("user_id", "place"), ["place"], "event_type", {"h": ["view"], "u": ["click", "error"]}, ["value"])
    share, _ = X.party_share(["u"], "valid")
    return p.select("place", "valid", "h", "u", r6("value").alias("at"), r6(share).alias("share"))


@query(
    f", f AS (SELECT a.y AS y, area, rooms, {CLASS} AS size FROM a JOIN reg USING (bld) WHERE a.y - built BETWEEN 0 AND 1), "
    "s AS (SELECT y, unnest(['2', '3', '4', '5']) AS size FROM f GROUP BY y), n AS (SELECT y, size, count(*) AS n FROM f GROUP BY ALL), "
    "t AS (SELECT y, count(*) AS n, round(avg(area), 6) AS m2, median(area) AS m2_median, round(avg(ceil(rooms)), 6) AS rooms FROM f GROUP BY y) "
    "SELECT t.y AS y, t.n AS n, m2, m2_median, rooms, s.size AS size, round(coalesce(n.n, 0) / t.n, 6) AS share FROM t JOIN s ON s.y = t.y LEFT JOIN n ON n.y = s.y AND n.size = s.size"
)
def first_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was sold when the building was new, by year of sale, and the shares of sizes."""
    d = sample(spark, sf_dir).join(register(spark, sf_dir).drop("x", "y"), "bld").where("y - built between 0 and 1").withColumn("size", X.room_class("rooms"))
    means = d.groupBy("y").agg(F.count("*").alias("n"), F.avg("area").alias("m2"), F.median("area").alias("m2_median"), F.avg(F.ceil("rooms")).alias("rooms"))
    out = means.join(R.shares(d, ["y"], "size", ["2", "3", "4", "5"]).drop("n"), "y")
    return rounded(out, ["y", "n", "m2_median", "size"], m2=6, rooms=6, share=6)


@query(
    stock_sql("district", "1.0", "s1") + stock_sql("district", "floors", "s2")
    + ", g AS (SELECT district, s1.year AS year, ln(s1.stock) AS n, ln(s2.stock) AS f FROM s1 JOIN s2 USING (district, year) WHERE s1.stock > 0 AND s2.stock > 0), "
    "d AS (SELECT n - lag(n) OVER w AS n, f - lag(f) OVER w AS f FROM g WINDOW w AS (PARTITION BY district ORDER BY year)) SELECT round(corr(n, f), 6) AS corr, round(stddev(n), 6) AS sd_n, round(stddev(f), 6) AS sd_f FROM d"
)
def growth_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike two measures of the stock grow."""
    u = units(spark, sf_dir)
    n = U.stock(u, ["district"], "built", "one", 1928, 2022).where("stock > 0").select("district", "year", F.ln("stock").alias("n"))
    f = U.stock(u, ["district"], "built", "floors", 1928, 2022).where("stock > 0").select("district", "year", F.ln("stock").alias("f"))
    return rounded(U.growth_similarity(n.join(f, ["district", "year"]), ["district"], "year", "n", "f"), [], corr=6, sd_n=6, sd_f=6)


SIZES = ["2", "3", "4", "5"]
SIZED = (
    f", ow AS (SELECT bld, {CLASS} AS size, count(*) AS n FROM a WHERE y <= 1997 GROUP BY ALL), bl AS (SELECT block, {CLASS} AS size, count(*) AS n FROM a WHERE rooms <= 5 AND y <= 1995 GROUP BY ALL), "
    "sz AS (SELECT unnest(['2', '3', '4', '5']) AS size), "
    "os AS (SELECT b.bld, sz.size, coalesce(ow.n, 0) / sum(coalesce(ow.n, 0)) OVER (PARTITION BY b.bld) AS w FROM (SELECT DISTINCT bld FROM ow) b JOIN sz ON true LEFT JOIN ow ON ow.bld = b.bld AND ow.size = sz.size), "
    "bs AS (SELECT b.block, sz.size, coalesce(bl.n, 0) / sum(coalesce(bl.n, 0)) OVER (PARTITION BY b.block) AS w FROM (SELECT DISTINCT block FROM bl) b JOIN sz ON true LEFT JOIN bl ON bl.block = b.block AND bl.size = sz.size), "
    "iu AS (SELECT r.bld, r.block, built, district, sz.size, coalesce(os.w, bs.w, 0.25) AS w, CASE WHEN os.w IS NOT NULL THEN 1 WHEN bs.w IS NOT NULL THEN 2 ELSE 0 END AS lv FROM "
    f"(SELECT bld, block, built, district FROM {REGISTER}) r JOIN sz ON true LEFT JOIN os ON os.bld = r.bld AND os.size = sz.size LEFT JOIN bs ON bs.block = r.block AND bs.size = sz.size)"
)


def sized_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register buildings with fractional size weights: from own sales, else their block's, else even."""
    d = sample(spark, sf_dir)
    at = d.groupBy("bld").agg(F.min("block").alias("block"))
    u = register(spark, sf_dir).join(at, "bld").join(places(spark, sf_dir), "block").select("bld", "block", "built", "district")
    c = d.withColumn("size", X.room_class("rooms"))
    level = lambda rows, key: R.shares(rows, [key], "size", SIZES).groupBy(key).pivot("size", SIZES).agg(F.first("share"))
    levels = [(level(c.where("y <= 1997"), "bld"), ["bld"]), (level(c.where("rooms <= 5 and y <= 1995"), "block"), ["block"])]
    return U.imputed_sizes(u, levels, SIZES)


@query(SIZED + " SELECT district, size, CAST(lv AS INTEGER) AS level, round(sum(w), 6) AS homes FROM iu GROUP BY ALL")
def imputed_size_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.by_size(sized_units(spark, sf_dir), SIZES)
    return rounded(out.groupBy("district", "size", F.col("share_level").alias("level")).agg(F.sum("w").alias("homes")), ["district", "size", "level"], homes=6)


@query(
    SIZED + stock_sql("size", "w", "st", "iu") + "SELECT year, size, round(h, 6) AS built, round(h / nullif(sum(h) OVER y, 0), 6) AS built_share, round(stock / nullif(sum(stock) OVER y, 0), 6) AS stock_share FROM st WINDOW y AS (PARTITION BY year)"
)
def completions_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was built by year and size, and the composition of completions and of the stock."""
    s = U.composition(U.by_size(sized_units(spark, sf_dir), SIZES), "size", "built", "w", 1928, 2022)
    return rounded(s, ["year", "size"], built=6, built_share=6, stock_share=6)


@query(
    ", o AS (SELECT o_orderkey AS ok, o_custkey AS cust FROM orders), l AS (SELECT ok, rooms, price FROM deals QUALIFY row_number() OVER (PARTITION BY ok ORDER BY price DESC, rooms, bld, dt, area) = 1) "
    "SELECT coalesce(rooms, 0) AS rooms, count(*) AS orders, round(sum(price), 2) AS price FROM o LEFT JOIN l USING (ok) GROUP BY 1"
)
def dearest_line_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with one matched line each, the dearest."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ok"))
    m = R.match_one(o, deals(spark, sf_dir).select("ok", "rooms", "price", "bld", "dt", "area"), ["ok"], [F.desc("price"), "rooms", "bld", "dt", "area"])
    return m.groupBy(F.coalesce("rooms", F.lit(0)).alias("rooms")).agg(F.count("*").alias("orders"), r6(F.sum("price"), 2).alias("price"))


@query(
    ", k AS (SELECT ok, rooms, price FROM deals QUALIFY row_number() OVER (PARTITION BY ok, rooms ORDER BY dt, bld, price, area, block) = 1) SELECT rooms, count(*) AS n, round(sum(price), 2) AS price FROM k GROUP BY rooms"
)
def one_sale_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated (order, line) keys: the first in a total order stays."""
    d = R.one_per_key(deals(spark, sf_dir), ["ok", "rooms"], ["dt", "bld", "price", "area", "block"])
    return d.groupBy("rooms").agg(F.count("*").alias("n"), r6(F.sum("price"), 2).alias("price"))


@query(
    ", t AS (SELECT floors, CAST(split_part(brand, '#', 2) AS INTEGER) AS brand, CASE WHEN floors % 5 = 0 THEN NULL ELSE floors END AS shown, TRY_CAST(CASE WHEN floors % 7 = 0 THEN 'x' ELSE built || '-' || (1 + floors % 12) || '-01' END AS DATE) AS d FROM reg) "
    "SELECT brand, count(shown) AS shown, CAST(sum(shown) AS BIGINT) AS total, CAST(min(d) AS VARCHAR) AS first_day, count(d) AS days FROM t GROUP BY brand"
)
def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that came as text: loose casts give NULL, keys must cast, dates as day/month/year."""
    r = register(spark, sf_dir)
    floors = F.when(F.col("floors") % 5 == 0, F.concat("floors", F.lit("?"))).otherwise(F.col("floors").cast("string"))
    day = F.when(F.col("floors") % 7 == 0, "x").otherwise(F.concat(F.lit("01/"), F.lpad((1 + F.col("floors") % 12).cast("string"), 2, "0"), F.lit("/"), "built"))
    t = r.select(X.strict(F.substring_index("brand", "#", -1), "int").alias("brand"), X.loose(floors, "int").alias("shown"), X.loose_date(day).alias("d"))
    return t.groupBy("brand").agg(
        F.count("shown").alias("shown"), F.sum("shown").alias("total"), F.min("d").cast("string").alias("first_day"), F.count("d").alias("days")
    )


@query(
    ", k AS (SELECT block * 1000000 + bld AS key, greatest(rooms, area / 10) AS largest, least(greatest(area, 10), 30) AS capped, area FROM a) "
    "SELECT CAST(key // 1000000 AS BIGINT) AS block, round(sum(largest), 6) AS largest, round(sum(capped), 6) AS capped, CAST(sum(key % 1000000) AS BIGINT) AS blds, "
    "count(*) FILTER (WHERE area >= 2 * 24 ** 0.25 AND area < 2 * 24 ** 0.5) AS second FROM k GROUP BY 1"
)
def keys_and_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite keys there and back, row-wise maxima, caps, and bins that grow geometrically."""
    d = sample(spark, sf_dir).withColumn("key", X.key_of("block", "bld", 1_000_000))
    block, bld = X.key_parts("key", 1_000_000)
    edges = X.geometric_edges(2.0, 48.0, 4)
    d = d.select(block.alias("block"), bld.alias("bld"), X.largest_of("rooms", F.col("area") / 10).alias("largest"), X.clipped("area", 10, 30).alias("capped"), X.binned("area", edges, [0, 1, 2, 3], "left").alias("bin"))
    return d.groupBy("block").agg(r6(F.sum("largest")).alias("largest"), r6(F.sum("capped")).alias("capped"), F.sum("bld").alias("blds"), F.count_if(F.col("bin") == 1).alias("second"))


@query(
    ", m AS (SELECT kind, brand, (34 + x / 1e5) * 111320 * cos(radians(31.8)) AS mx, (31 + y / 1e5) * 110574 AS my, CASE WHEN floors % 10 = 0 THEN NULL ELSE floors / 10.0 END AS km FROM reg) "
    "SELECT kind, round(avg(mx), 4) AS mx, round(avg(my), 4) AS my, CAST(sum(CASE WHEN km IS NULL THEN 0 ELSE round(25 * (ln(km) + 3)) + 1 END) AS BIGINT) AS codes, count(km) AS known FROM m GROUP BY kind"
)
def projected_and_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees to metres, distances as coarse log codes, infinities as missing."""
    r = register(spark, sf_dir)
    mx, my = X.metres(34 + F.col("x") / 1e5, 31 + F.col("y") / 1e5)
    km = X.finite(F.when(F.col("floors") % 10 == 0, F.lit(float("inf"))).otherwise(F.col("floors") / 10.0))
    m = r.select("kind", mx.alias("mx"), my.alias("my"), km.alias("km"), X.log_code(km).alias("code"))
    return m.groupBy("kind").agg(r6(F.avg("mx"), 4).alias("mx"), r6(F.avg("my"), 4).alias("my"), F.sum("code").alias("codes"), F.count("km").alias("known"))


@query(
    ", c AS (SELECT CASE WHEN floors = 1 THEN 'edu' WHEN floors = 2 THEN 'health' WHEN floors = 3 THEN 'relig' WHEN floors IN (4, 5, 20) THEN 'public' WHEN floors = 7 THEN 'culture' WHEN floors = 8 THEN 'hotel' "
    "WHEN floors = 9 THEN 'center' WHEN floors IN (10, 11) THEN 'comm' WHEN floors = 12 THEN 'ind' WHEN floors = 21 THEN 'res' WHEN floors = 25 THEN 'transport' WHEN floors = 29 THEN 'roads' WHEN floors = 33 THEN 'park' END AS use, "
    "NOT (contains(street, 'ring') OR contains(street, 'bolt')) AS kept, CASE WHEN floors % 3 = 0 THEN kind END AS religion, floors % 50 AS boarding, brand, x, kind, built FROM reg), "
    "g AS (SELECT *, CASE WHEN (religion IS NOT NULL AND religion <> 'main') OR (religion IS NULL AND brand IN ('Brand#1', 'Brand#2')) THEN 'minority' WHEN boarding >= 40 THEN 'orthodox' ELSE 'other' END AS grp, "
    "CASE WHEN kind = 'SMALL' THEN CASE WHEN x > 5000 THEN 'east' ELSE 'west' END WHEN kind = 'LARGE' THEN 'north' WHEN brand = 'Brand#3' THEN 'south' END AS region FROM c) "
    "SELECT use, grp, region, count(*) AS n, count(*) FILTER (WHERE kept) AS kept FROM g GROUP BY ALL"
)
def recoded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-use codes, excluded categories, groups of places from two sources, regions by rules."""
    r = register(spark, sf_dir).withColumn("religion", F.when(F.col("floors") % 3 == 0, F.col("kind"))).withColumn("boarding", F.col("floors") % 50)
    split = F.when(F.col("x") > 5000, "east").otherwise("west")
    region = X.region_of(F.col("kind"), F.col("brand"), {"LARGE": "north"}, {"Brand#3": "south"}, "SMALL", split)
    group = X.place_group("religion", "boarding", "brand", ["Brand#1", "Brand#2"])
    c = r.select(X.recoded("floors", X.LAND_USE).alias("use"), group.alias("grp"), region.alias("region"), X.excluded("street", ("ring", "bolt")).alias("kept"))
    return c.groupBy("use", "grp", "region").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


@query(
    ", t AS (SELECT street, floors, CASE WHEN floors % 4 = 0 THEN floors WHEN floors % 4 = 1 THEN floors WHEN floors % 4 = 2 THEN 0 WHEN floors < 20 THEN NULL ELSE 23 END AS level FROM reg) "
    "SELECT replace(street, ' ', '') AS street, count(*) AS n, count(level) AS known, CAST(coalesce(sum(level), 0) AS BIGINT) AS levels FROM t GROUP BY 1"
)
def parsed_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor texts of several forms, and street names without blanks and type."""
    f = F.col("floors")
    text = F.when(f % 4 == 0, f.cast("string")).when(f % 4 == 1, F.concat(F.lit("קומה "), f)).when(f % 4 == 2, "קרקע").when(f < 20, "no floor").otherwise("עשרים ושלוש")
    d = register(spark, sf_dir).select(F.concat(F.lit("רחוב "), "street").alias("street"), text.alias("text"))
    d = X.parsed_once(d, "text", "level").withColumn("street", X.street_key("street"))
    return d.groupBy("street").agg(F.count("*").alias("n"), F.count("level").alias("known"), F.coalesce(F.sum("level"), F.lit(0)).alias("levels"))


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(", t AS (SELECT block, count(*) AS n, sum(area) AS m2 FROM a GROUP BY block) SELECT block, n, round(m2, 4) AS m2, round(m2 / n, 6) AS mean FROM t")
def staged_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the sample per block through a stage: the second use of the same plan reads what the first one wrote."""
    root = folder(spark, "stages")
    totals = lambda: S.stage_once(sample(spark, sf_dir).groupBy("block").agg(F.count("*").alias("n"), F.sum("area").alias("m2")), root, "totals")
    means = totals().select("block", (F.col("m2") / F.col("n")).alias("mean"))
    return totals().join(means, "block").select("block", "n", r6("m2", 4).alias("m2"), r6("mean").alias("mean"))


@query("SELECT DISTINCT street AS name FROM reg JOIN a USING (bld) WHERE street NOT IN (SELECT street FROM reg WHERE built >= 2012)")
def undocumented_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets of sold buildings that the dictionary, streets of buildings from 2012 on, has no entry for."""
    r = register(spark, sf_dir)
    published = sample(spark, sf_dir).select("bld").join(r, "bld").select(F.col("street").alias("name"))
    return R.undocumented(published, r.where("built >= 2012").select(F.col("street").alias("name")))


@query("SELECT kind, count(*) AS n, CAST(sum(floors) AS BIGINT) AS floors, count(built) AS known, min(street) AS street FROM reg GROUP BY kind")
def csv_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register written as delimited text in two parts, and read as one table with loose and strict columns."""
    r = register(spark, sf_dir).select("bld", "floors", "kind", "street", "built")
    paths = [folder(spark, "csv") for _ in range(2)]
    for path, part in zip(paths, (r.where("floors <= 20"), r.where("floors > 20"))):
        S.write_csv(part, path)
    text = S.read_parts(spark, paths, "bld string, floors string, kind string, street string, built string")
    typed = text.select(X.strict("bld", "long").alias("bld"), X.loose("floors", "int").alias("floors"), "kind", "street", X.loose("built", "int").alias("built"))
    return typed.groupBy("kind").agg(F.count("*").alias("n"), F.sum("floors").alias("floors"), F.count("built").alias("known"), F.min("street").alias("street"))


@query("SELECT district, count(*) AS n, CAST(sum(block) AS BIGINT) AS blocks FROM places GROUP BY district")
def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas through a headerless and a headed text table, column by column."""
    p, a, b = places(spark, sf_dir), folder(spark, "tsv"), folder(spark, "text")
    p.write.csv(a, sep="\t")
    S.write_csv(S.read_headless(spark, a, "block string, city string, district string"), b)
    t = S.read_text_table(spark, b, {"block": "long", "district": "string"}, ("block",))
    return t.groupBy("district").agg(F.count("*").alias("n"), F.sum("block").alias("blocks"))


@query("SELECT kind, count(*) AS n FROM reg WHERE x - floors <= 6000 AND x + floors >= 2000 AND y - 5 <= 7000 AND y + 5 >= 1000 GROUP BY kind")
def boxed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings with nested boxes, staged in order of place and read through a window."""
    r = register(spark, sf_dir)
    box = F.struct((F.col("x") - F.col("floors")).alias("xmin"), (F.col("x") + F.col("floors")).alias("xmax"), (F.col("y") - 5).alias("ymin"), (F.col("y") + 5).alias("ymax"))
    path = folder(spark, "boxes")
    S.stage(S.clustered(r.select("kind", "x", box.alias("bbox")), "x"), path)
    return S.read_box(spark, path, ["kind"], 2000, 1000, 6000, 7000).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT CAST(floor(x / 2500) AS BIGINT) AS ti, CAST(floor(y / 2500) AS BIGINT) AS tj, count(*) AS rows, count(*) FILTER (WHERE built IS NOT NULL) AS known FROM reg GROUP BY 1, 2")
def tiles_and_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles in folders and nested JSON documents, read back: infinities come back as missing."""
    r, tiles, docs = register(spark, sf_dir), folder(spark, "tiles"), folder(spark, "json")
    index = S.write_tiled(r, tiles, "x", "y", 2500.0)
    year = F.when(F.col("built").isNull(), F.lit(float("inf"))).otherwise(F.col("built").cast("double"))
    S.write_json(spark.read.parquet(tiles).select("ti", "tj", year.alias("year")), docs)
    back = spark.read.schema("ti long, tj long, year double").json(docs)
    return index.join(back.groupBy("ti", "tj").agg(F.count("year").alias("known")), ["ti", "tj"])
