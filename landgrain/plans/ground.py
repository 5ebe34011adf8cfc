"""Queries of the spatial and network operators on the points and chains that the driver's tables give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrain.functions import exprs as X
from landgrain.operators import network as N
from landgrain.operators import relational as R
from landgrain.operators import spatial as P
from landgrain.operators.components import shared_folder
from landgrain.plans.base import query, r6, register, table
from landgrain.sources import tables as S

WIDTH = 10_010.0


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as one square of the smallest square grid over the city that holds them all, numbered by key."""
    k, s = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    grid = s.agg(F.ceil(F.sqrt(F.max("s_suppkey") + 1)).alias("n"))  # one row
    s = s.crossJoin(F.broadcast(grid)).select(k.alias("poly"), (k % F.col("n")).alias("i"), F.floor(k / F.col("n")).alias("j"), (WIDTH / F.col("n")).alias("side"))
    corner = lambda a, b: F.struct(((F.col("i") + a) * F.col("side")).alias("x"), ((F.col("j") + b) * F.col("side")).alias("y"))
    return s.select("poly", "side", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("rings"))


#: The same squares: poly, i, j, side and the corners.
SQ = (
    ", gn AS (SELECT CAST(ceil(sqrt(max(s_suppkey) + 1)) AS BIGINT) AS n FROM supplier), "
    "sq0 AS (SELECT s_suppkey AS poly, s_suppkey % n AS i, s_suppkey // n AS j, 10010.0::DOUBLE / n AS side FROM supplier, gn), "
    "sq AS (SELECT *, i * side AS sx0, j * side AS sy0, (i + 1) * side AS sx1, (j + 1) * side AS sy1 FROM sq0), "
    "inq AS (SELECT reg.*, poly FROM reg JOIN sq ON x >= sx0 AND x < sx1 AND y >= sy0 AND y < sy1)"
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register(spark, sf_dir).select(F.col("bld").alias("id"), "x", "y", "floors", "kind", "built")


@query(SQ + ", c AS (SELECT poly, count(*) AS n FROM inq GROUP BY poly) SELECT poly, coalesce(n, 0) AS n FROM sq LEFT JOIN c USING (poly)")
def points_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.counts_in(points(spark, sf_dir), squares(spark, sf_dir), 500.0)


@query(
    SQ + " SELECT poly, round(side * side, 4) AS area, round(4 * side, 4) AS perimeter, round((i + 0.5) * side, 4) AS cx, "
    "round((j + 0.5) * side, 4) AS cy, round(pi() / 4, 6) AS compactness FROM sq"
)
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.measures(squares(spark, sf_dir))
    return m.select("poly", *(r6(c, 4).alias(c) for c in ("area", "perimeter", "cx", "cy")), r6("compactness").alias("compactness"))


@query(
    "SELECT p.bld AS a, q.bld AS b, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 6) AS d FROM reg p JOIN reg q "
    "ON p.bld < q.bld AND abs(p.x - q.x) <= 100 AND abs(p.y - q.y) <= 100 WHERE sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 100"
)
def pairs_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pairs_within(points(spark, sf_dir), 100.0).select("a", "b", r6("d").alias("d"))


@query(
    ", s AS (SELECT bld, x, y FROM reg WHERE brand = 'Brand#7'), d AS (SELECT r.bld AS id, s.bld AS rid, sqrt((r.x - s.x) ** 2 + (r.y - s.y) ** 2) AS d FROM reg r, s) "
    "SELECT id, arg_min(rid, (d, rid)) AS rid, round(min(d), 6) AS d FROM d GROUP BY id"
)
def nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations are the buildings of one brand."""
    p = register(spark, sf_dir)
    stations = p.where("brand = 'Brand#7'").select(F.col("bld").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return P.nearest(p.withColumnRenamed("bld", "id"), stations, 500.0).select("id", "rid", r6("d").alias("d"))


@query(
    ", d AS (SELECT r.bld AS id, s.bld AS rid, s.floors AS v, sqrt((r.x - s.x) ** 2 + (r.y - s.y) ** 2) AS d FROM reg r JOIN reg s ON s.kind = r.kind AND s.built IS NOT NULL WHERE r.built IS NULL), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, rid) AS rk FROM d) "
    "SELECT id, round(sum(v / greatest(d, 100) ** 2) / sum(1 / greatest(d, 100) ** 2), 6) AS v FROM k WHERE rk <= 3 GROUP BY id"
)
def knn_idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings of unknown year take floors from the three nearest known ones of their kind."""
    p = points(spark, sf_dir)
    right = p.where("built is not null").select(
        "kind", F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("floors").cast("double").alias("v"), F.lit(1.0).alias("valid")
    )
    near = P.nearest_in_group(p.where("built is null").select("kind", "id", "x", "y"), right, "kind", 3)
    return P.weighted_nearest(near, ["v"], "valid").select("id", r6("v").alias("v"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two or more distinct parts as street segments: parts are connectors at even places along the way."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("bld")).distinct()  # noqa: E741
    p = l.join(register(spark, sf_dir).select("bld", "x", "y"), "bld")
    g = p.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bld", "x", "y"))).alias("p")).where(F.size("p") >= 2)
    connector = lambda q, i: F.struct(q["bld"].alias("connector_id"), (i / (F.size("p") - 1)).cast("double").alias("at"))
    return g.select("id", F.transform("p", connector).alias("connectors"), F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


SEGMENTS = """
, l AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS bld FROM lineitem WHERE l_partkey IN (SELECT bld FROM reg)),
s AS (SELECT id, bld, row_number() OVER (PARTITION BY id ORDER BY bld) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM l),
k AS (SELECT bld, sum(CASE WHEN i = 0 OR i = n - 1 THEN 1 ELSE 2 END) AS streets FROM s WHERE n >= 2 GROUP BY bld)
"""


@query(
    SEGMENTS + "SELECT brand, count(*) AS nodes, "
    "round(CASE WHEN count(*) FILTER (WHERE streets = 1 OR streets >= 3) >= 5 THEN count(*) FILTER (WHERE streets = 1) / count(*) FILTER (WHERE streets = 1 OR streets >= 3) END, 6) AS dead_ends, "
    "round(CASE WHEN count(*) FILTER (WHERE streets >= 3) >= 5 THEN count(*) FILTER (WHERE streets >= 4) / count(*) FILTER (WHERE streets >= 3) END, 6) AS four_way "
    "FROM k JOIN reg USING (bld) GROUP BY brand"
)
def street_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = N.street_counts(segments(spark, sf_dir)).join(register(spark, sf_dir).select(F.col("bld").alias("connector_id"), "brand"), "connector_id")
    out = N.node_shares(n, ["brand"])
    return out.select("brand", "nodes", r6("dead_ends").alias("dead_ends"), r6("four_way").alias("four_way"))


@query(
    SEGMENTS + ", e AS (SELECT id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM s JOIN reg USING (bld) WHERE n >= 2 WINDOW w AS (PARTITION BY id ORDER BY s.bld)), "
    "q AS (SELECT id % 10 AS zone, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS len, floor((((degrees(atan2(x2 - x, y2 - y)) % 180 + 180) % 180 + 5) % 180) / 10) AS bin FROM e WHERE x2 IS NOT NULL), "
    "h AS (SELECT zone, bin, sum(len) AS w FROM q GROUP BY ALL) "
    "SELECT zone, round((ln(sum(w)) - sum(w * ln(w)) / sum(w) + ln(2)) / ln(36), 6) AS entropy, round(sum(w), 2) AS street FROM h GROUP BY zone"
)
def bearing_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = N.pieces(segments(spark, sf_dir)).withColumn("zone", F.col("id") % 10)
    return N.orientation_entropy(parts, ["zone"]).select("zone", r6("entropy").alias("entropy"), r6("street", 2).alias("street"))


@query(
    SEGMENTS + ", e AS (SELECT id, i, n, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM s JOIN reg USING (bld) WHERE n >= 2 WINDOW w AS (PARTITION BY id ORDER BY i)), "
    "g AS (SELECT *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS len FROM e WHERE x2 IS NOT NULL), "
    "h AS (SELECT *, sum(len) OVER (PARTITION BY id ORDER BY i) - len AS before, sum(len) OVER (PARTITION BY id) AS total FROM g), "
    "f AS (SELECT DISTINCT id, f FROM (SELECT id, i / (n - 1) AS f FROM s JOIN k USING (bld) WHERE n >= 2 AND streets <> 2 UNION ALL SELECT id, unnest([0.0::DOUBLE, 1.0::DOUBLE]) FROM s WHERE n >= 2)), "
    "o AS (SELECT f.id AS id, f, max(total) AS total, max({px: x + t * (x2 - x), py: y + t * (y2 - y)}) AS p FROM (SELECT f.id AS id, f, h.* EXCLUDE (id), "
    "greatest(0, least(1, coalesce((f * total - before) / nullif(len, 0), 0))) AS t FROM f JOIN h ON h.id = f.id "
    "AND f * total >= before AND (f * total < before + len OR i = n - 2)) f GROUP BY ALL), "
    "q AS (SELECT id, (lead(f) OVER w - f) * total AS net, sqrt((lead(p) OVER w).px ** 2 - 2 * (lead(p) OVER w).px * p.px + p.px ** 2 + ((lead(p) OVER w).py - p.py) ** 2) AS chord FROM o WINDOW w AS (PARTITION BY id ORDER BY f)) "
    "SELECT id % 10 AS zone, round(sum(net), 2) AS net, round(CASE WHEN sum(net) > 1000 THEN sum(net) / sum(chord) END, 6) AS circuity FROM q "
    "WHERE net IS NOT NULL AND chord >= 10 AND net >= 0.999 * chord GROUP BY ALL"
)
def circuity_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.circuity(N.circuity_pieces(segments(spark, sf_dir)).withColumn("zone", F.col("id") % 10), ["zone"])
    return out.select("zone", r6("net", 2).alias("net"), r6("circuity").alias("circuity"))


@query(
    ", e AS (SELECT p.bld AS a, q.bld AS b FROM reg p JOIN reg q ON abs(p.x - q.x) <= 60 AND abs(p.y - q.y) <= 60 WHERE sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 60), "
    "r AS (WITH RECURSIVE w(id, root) AS (SELECT bld, bld FROM reg UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id) SELECT id, min(root) AS comp FROM w GROUP BY id) "
    "SELECT comp, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM r JOIN reg ON bld = id GROUP BY comp"
)
def consolidate_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = N.consolidated(points(spark, sf_dir), 60.0)
    return c.select("comp", "n", r6("x").alias("x"), r6("y").alias("y"))


@query(
    ", b AS (SELECT s_suppkey AS box, (s_suppkey * 613) % 9000 AS x0, (s_suppkey * 877) % 9000 AS y0 FROM supplier), "
    "c AS (SELECT box, count(*) AS n FROM b JOIN reg ON x BETWEEN x0 AND x0 + 1000 AND y BETWEEN y0 AND y0 + 1000 GROUP BY box) SELECT box, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (box)"
)
def box_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    b = table(spark, sf_dir, "supplier").select(k.alias("box"), ((k * 613) % 9000).alias("x0"), ((k * 877) % 9000).alias("y0"))
    b = b.withColumn("x1", F.col("x0") + 1000).withColumn("y1", F.col("y0") + 1000)
    return N.box_counts(points(spark, sf_dir), b, 500.0)


@query("SELECT CAST(floor(x / 2000) AS BIGINT) AS ti, CAST(floor(y / 2000) AS BIGINT) AS tj, count(*) AS n FROM reg GROUP BY 1, 2")
def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.tiled(points(spark, sf_dir), 1 / 2000).groupBy("ti", "tj").agg(F.count("*").alias("n"))


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x1, y1, x2, y2): every order as a short straight street at a place of its own."""
    k = F.col("o_orderkey")
    x, y = (k * 7919) % 10007, (k * 104729) % 10009
    ends = [x, y, x + (k * 31) % 201 - 100, y + (k * 17) % 201 - 100]
    return table(spark, sf_dir, "orders").select(k.alias("id"), *(e.cast("double").alias(n) for e, n in zip(ends, ("x1", "y1", "x2", "y2"))))


LANES = (
    ", ln0 AS (SELECT o_orderkey AS id, CAST((o_orderkey * 7919) % 10007 AS DOUBLE) AS x1, CAST((o_orderkey * 104729) % 10009 AS DOUBLE) AS y1, "
    "(o_orderkey * 31) % 201 - 100 AS dx, (o_orderkey * 17) % 201 - 100 AS dy FROM orders), lanes AS (SELECT id, x1, y1, x1 + dx AS x2, y1 + dy AS y2, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy FROM ln0) "
)
#: Lattice points within 60 m of a lane.
FOOT = (
    ", lt AS (SELECT *, unnest(range(CAST(floor((least(x1, x2) - 60) / 20) AS BIGINT), CAST(floor((greatest(x1, x2) + 60) / 20) AS BIGINT) + 1)) AS a FROM lanes), "
    "lu AS (SELECT *, unnest(range(CAST(floor((least(y1, y2) - 60) / 20) AS BIGINT), CAST(floor((greatest(y1, y2) + 60) / 20) AS BIGINT) + 1)) AS b FROM lt), "
    "lv AS (SELECT *, (a + 0.5) * 20 AS px, (b + 0.5) * 20 AS py, greatest(0, least(1, coalesce((((a + 0.5) * 20 - x1) * dx + ((b + 0.5) * 20 - y1) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM lu), "
    "fp AS (SELECT DISTINCT px, py FROM lv WHERE sqrt((px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2) <= 60), "
    "ft AS (SELECT poly, count(px) * 400.0 AS street FROM sq LEFT JOIN fp ON px >= sx0 AND px < sx1 AND py >= sy0 AND py < sy1 GROUP BY poly) "
)


@query(SQ + LANES + FOOT + "SELECT poly, round(street, 2) AS area FROM ft")
def street_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground within 60 m of a street by area."""
    return P.footprint(lanes(spark, sf_dir), squares(spark, sf_dir), 20.0, 60.0).select("poly", r6("area", 2).alias("area"))


#: A building's parcel: 20 floors and more are the large ones.
PARCELS = "pa AS (SELECT poly, CASE WHEN floors >= 48 THEN 60000.0 ELSE 900.0 * floors END AS area FROM inq), "


@query(
    SQ + LANES + FOOT + ", " + PARCELS + "ow AS (SELECT poly, side * side AS area, coalesce(sum(pa.area) FILTER (WHERE pa.area < 50000), 0) AS own, coalesce(sum(pa.area), 0) AS every "
    "FROM sq LEFT JOIN pa USING (poly) GROUP BY ALL), bo AS (SELECT *, least(every / area, 1) AS cover FROM ow JOIN ft USING (poly)), "
    "ra AS (SELECT median(own / street) AS ratio FROM bo WHERE cover > 0.4 AND own > 100000 AND street > 0), "
    "re AS (SELECT poly, cover < 0.3 AND street > 0 AND ratio IS NOT NULL AS re, own, street, ratio FROM bo, ra), "
    "u AS (SELECT poly, CASE WHEN re THEN street * ratio ELSE own END AS urban, CASE WHEN re THEN 'street' ELSE 'parcels' END AS source FROM re) "
    "SELECT poly, round(urban, 2) AS urban, source FROM u WHERE urban > 20000"
)
def urban_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urban land per area from parcels, and from the calibrated street footprint where they cover little."""
    s, p = squares(spark, sf_dir), points(spark, sf_dir)
    size = F.when(F.col("floors") >= 48, 60000.0).otherwise(900.0 * F.col("floors"))
    parcels = P.points_in(p, s, 500.0).join(p.hint("merge"), "id").select("poly", size.alias("area"))
    areas = s.select("poly", (F.col("side") * F.col("side")).alias("area"))
    street = P.footprint(lanes(spark, sf_dir), s, 20.0, 60.0)
    return P.urban_land(parcels, areas, street, good=0.4, sample=1_000_000).select("poly", r6("urban", 2).alias("urban"), "source")


@query(SQ + ", c AS (SELECT poly, count(*) AS n, sum(900.0 * floors) AS ground FROM inq GROUP BY poly) SELECT poly, round(n * 1e6 / (side * side), 6) AS gross, round(n * 1e6 / ground, 6) AS net FROM c JOIN sq USING (poly)")
def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings per square kilometre of all ground and of parcel ground."""
    s, p = squares(spark, sf_dir), points(spark, sf_dir)
    met = P.points_in(p, s, 500.0).join(p.hint("merge"), "id").groupBy("poly").agg(F.count("*").alias("n"), F.sum(900.0 * F.col("floors")).alias("ground"))
    grounds = met.join(s.select("poly", (F.col("side") * F.col("side")).alias("all")), "poly")
    out = P.density(met, grounds, "n", "all", "gross").join(P.density(met, grounds, "n", "ground", "net"), "poly")
    return out.select("poly", r6("gross").alias("gross"), r6("net").alias("net"))


def outline_of_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(6000.0, 0.0), corner(6000.0, 4000.0), corner(0.0, 9000.0))
    return spark.range(1).select(F.lit(1).alias("poly"), F.array(ring).alias("rings"))


@query(
    ", z AS (SELECT bld, CASE WHEN built IS NULL THEN NULL ELSE kind END AS zone, x >= 0 AND x < 6000 AND y >= 0 AND y < 9000 - x * 5 / 6 AS inside FROM reg) "
    "SELECT coalesce(zone, CASE WHEN inside THEN 'west' END, 'na') AS zone, count(*) AS n FROM z GROUP BY 1"
)
def zones_filled_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings without a zone that lie in one big polygon get its zone; the rest are an explicit missing level."""
    p = points(spark, sf_dir).withColumn("zone", F.when(F.col("built").isNotNull(), F.col("kind")))
    out = P.filled_inside(p, outline_of_half(spark, sf_dir), "zone", "west", 500.0)
    return out.groupBy(X.or_missing("zone").alias("zone")).agg(F.count("*").alias("n"))


@query(
    SQ + LANES + ", m AS (SELECT poly, id FROM sq JOIN lanes ON greatest(x1, x2) + 50 >= sx0 AND least(x1, x2) - 50 <= sx1 AND greatest(y1, y2) + 50 >= sy0 AND least(y1, y2) - 50 <= sy1), "
    "c AS (SELECT m.poly, m.id, x1, y1, dx, dy, sx0, sx1, sy0, sy1, x1 >= sx0 AND x1 < sx1 AND y1 >= sy0 AND y1 < sy1 AS inside FROM m JOIN sq USING (poly) JOIN lanes USING (id)), "
    # Liang-Barsky clipping of the lane to the square.
    "k AS (SELECT *, CASE WHEN dx = 0 THEN CASE WHEN x1 BETWEEN sx0 AND sx1 THEN 0.0 ELSE 9 END ELSE least((sx0 - x1) / dx, (sx1 - x1) / dx) END AS xa, CASE WHEN dx = 0 THEN 1.0 ELSE greatest((sx0 - x1) / dx, (sx1 - x1) / dx) END AS xb, "
    "CASE WHEN dy = 0 THEN CASE WHEN y1 BETWEEN sy0 AND sy1 THEN 0.0 ELSE 9 END ELSE least((sy0 - y1) / dy, (sy1 - y1) / dy) END AS ya, CASE WHEN dy = 0 THEN 1.0 ELSE greatest((sy0 - y1) / dy, (sy1 - y1) / dy) END AS yb FROM c), "
    "d AS (SELECT *, list_min([sqrt(greatest(sx0 - (x1 + t * dx), 0, x1 + t * dx - sx1) ** 2 + greatest(sy0 - (y1 + t * dy), 0, y1 + t * dy - sy1) ** 2) "
    "for t in [0.0, 1.0, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((sx0 - x1) * dx + (sy0 - y1) * dy) / (dx * dx + dy * dy))) END, "
    "CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((sx1 - x1) * dx + (sy0 - y1) * dy) / (dx * dx + dy * dy))) END, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((sx0 - x1) * dx + (sy1 - y1) * dy) / (dx * dx + dy * dy))) END, "
    "CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((sx1 - x1) * dx + (sy1 - y1) * dy) / (dx * dx + dy * dy))) END]]) AS gap FROM k) "
    "SELECT poly, count(*) AS lanes FROM d WHERE inside OR gap <= 50 OR greatest(0, xa, ya) <= least(1, xb, yb) GROUP BY poly"
)
def lanes_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets within 50 m of each area."""
    return P.lines_per_polygon(lanes(spark, sf_dir), squares(spark, sf_dir), 50.0, 250.0).withColumnRenamed("n", "lanes")


@query(
    SQ + ", lot AS (SELECT poly, sum(20.0 * floors) AS a FROM (SELECT sq.poly, floors FROM reg JOIN sq ON reg.x + floors / 2 >= sx0 AND reg.x + floors / 2 < sx1 AND reg.y + 10 >= sy0 AND reg.y + 10 < sy1) GROUP BY poly), "
    "gr AS (SELECT poly, sum(50.0 * floors) AS ground FROM inq GROUP BY poly) SELECT poly, round(least(coalesce(a, 0) / ground, 1), 6) AS share FROM gr LEFT JOIN lot USING (poly)"
)
def parking_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parking lots (one beside each building, as wide as it has floors) over parcel ground, by the lots' inner points."""
    s, p = squares(spark, sf_dir), points(spark, sf_dir)
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    w = F.col("floors").cast("double")
    lots = p.select("id", F.array(F.array(corner(0.0, 0.0), corner(w, 0.0), corner(w, 20.0), corner(0.0, 20.0))).alias("rings"))
    ground = P.points_in(p, s, 500.0).join(p.hint("merge"), "id").groupBy("poly").agg(F.sum(50.0 * F.col("floors")).alias("ground"))
    return P.covered_share(lots, s, ground, 500.0).select("poly", r6("share").alias("share"))


@query(
    SQ + ", w AS (SELECT poly, sum(floors * x) / sum(floors) AS x, sum(floors * y) / sum(floors) AS y FROM inq WHERE kind = 'PROMO' GROUP BY poly) "
    "SELECT poly, round(coalesce(x, (i + 0.5) * side), 4) AS x, round(coalesce(y, (j + 0.5) * side), 4) AS y FROM sq LEFT JOIN w USING (poly)"
)
def area_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor-weighted centres of one kind of building per area, else a point inside."""
    out = P.weighted_centres(points(spark, sf_dir).where("kind = 'PROMO'"), squares(spark, sf_dir), "floors", 500.0)
    return out.select("poly", r6("x", 4).alias("x"), r6("y", 4).alias("y"))


@query(
    SQ + ", b AS (SELECT street, (max(x) - min(x)) * (max(y) - min(y)) AS area, count(*) AS n FROM reg WHERE kind = 'SMALL' GROUP BY street) "
    "SELECT street, n, round(area, 2) AS area FROM b WHERE NOT (area > 1e7 AND n < 5)"
)
def blocks_without_giants(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = points(spark, sf_dir).join(register(spark, sf_dir).select(F.col("bld").alias("id"), "street"), "id").where("kind = 'SMALL'")
    box = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    b = b.groupBy("street").agg(box.alias("area"), F.count("*").alias("n"))
    return P.without_empty_giants(b, "area", "n").select("street", "n", r6("area", 2).alias("area"))


@query(
    LANES + ", n AS (SELECT *, greatest(CAST(ceil(sqrt(dx * dx + dy * dy) / 40) AS BIGINT), 1) AS n FROM lanes), k AS (SELECT *, unnest(range(0, n)) AS k FROM n), "
    "p AS (SELECT x1 + k / n * dx AS x, y1 + k / n * dy AS y FROM k) "
    "SELECT count(*) AS n, round(sum(x), 2) AS x, round(sum(y), 2) AS y FROM p WHERE (x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 3000) OR (x BETWEEN 7000 AND 9000 AND y BETWEEN 500 AND 9500)"
)
def shore_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a point every 40 m, clipped to two boxes."""
    p = P.within_boxes(P.densified(lanes(spark, sf_dir), 40.0), [(0.0, 0.0, 5000.0, 3000.0), (7000.0, 500.0, 9000.0, 9500.0)])
    return p.agg(F.count("*").alias("n"), r6(F.sum("x"), 2).alias("x"), r6(F.sum("y"), 2).alias("y"))


@query(
    ", d AS (SELECT kind, x AS v, floors AS w FROM reg), cx AS (SELECT kind, v, sum(w) OVER (PARTITION BY kind ORDER BY v) AS u, sum(w) OVER (PARTITION BY kind) AS a FROM d), "
    "cy AS (SELECT kind, y AS v, sum(floors) OVER (PARTITION BY kind ORDER BY y) AS u, sum(floors) OVER (PARTITION BY kind) AS a FROM reg), "
    "mx AS (SELECT kind, min(v) AS x FROM cx WHERE 2 * u >= a GROUP BY kind), my AS (SELECT kind, min(v) AS y FROM cy WHERE 2 * u >= a GROUP BY kind), "
    "bx AS (SELECT kind, x - 500 AS x0, x + 500 AS x1, y - 500 AS y0, y + 500 AS y1 FROM mx JOIN my USING (kind)) "
    "SELECT bx.kind AS box, count(reg.bld) AS n FROM bx LEFT JOIN reg ON reg.x BETWEEN x0 AND x1 AND reg.y BETWEEN y0 AND y1 GROUP BY bx.kind"
)
def counts_in_median_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings in the square kilometre around each kind's weighted-median place."""
    p = points(spark, sf_dir)
    return N.box_counts(p, N.median_boxes(p, ["kind"], "floors").withColumnRenamed("kind", "box"), 500.0)


@query(SQ + " SELECT CAST(poly AS BIGINT) AS poly, round(side * side, 2) AS m2, round(4 * side, 4) AS outline FROM sq")
def areas_from_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas written as feature collections of about a thousand, and read back as polygons."""
    path = f"{shared_folder(spark)}/geojson-{uuid.uuid4().hex}"
    point = lambda p: F.array(p["x"], p["y"])
    closed = F.transform("rings", lambda r: F.concat(F.transform(r, point), F.array(point(r[0]))))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("poly").cast("string").alias("id")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates")).alias("geometry"),
    )
    q = squares(spark, sf_dir)
    files = q.withColumn("f", feature).groupBy(F.pmod(F.xxhash64("poly"), F.lit(1 + q.count() // 1000)).alias("part")).agg(F.collect_list("f").alias("features"))
    files.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    back = S.read_geojson(spark, path, ["id"]).withColumn("rings", F.transform("rings", lambda r: F.slice(r, 1, F.size(r) - 1)))
    m = P.measures(back.select(F.col("id").cast("long").alias("poly"), "rings"))
    return m.select("poly", r6("area", 2).alias("m2"), r6("perimeter", 4).alias("outline"))


@query(
    SQ + ", u AS (SELECT *, i * 2 < n AS upper FROM sq, gn), e AS (SELECT upper, unnest([{v: true, a: j, b: i}, {v: true, a: j, b: i + 1}, {v: false, a: i, b: j}, {v: false, a: i, b: j + 1}]) AS e, side FROM u), "
    "o AS (SELECT upper, e, max(side) AS side FROM e GROUP BY upper, e HAVING count(*) = 1) SELECT upper, round(sum(side), 2) AS outline FROM o GROUP BY upper"
)
def dissolved_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = squares(spark, sf_dir).withColumn("upper", F.col("rings")[0][0]["x"] * 2 + 0.001 < WIDTH)
    out = P.dissolved(s, "upper").groupBy("upper").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("outline"))
    return out.select("upper", r6("outline", 2).alias("outline"))


@query(
    ", p AS (SELECT bld AS id, bld % 100 AS block, kind AS place, street, CASE WHEN built IS NOT NULL THEN x END AS x, CASE WHEN built IS NOT NULL THEN y END AS y FROM reg), "
    "s AS (SELECT kind AS place, split_part(street, ' ', 1) AS street, x AS sx, y AS sy FROM reg), "
    "lo AS (SELECT kind AS place, median(x) AS lx, median(y) AS ly FROM reg WHERE length(split_part(kind, ' ', 1)) - 4 = 1 GROUP BY kind), "
    "ex AS (SELECT DISTINCT p.place, p.street FROM p JOIN s ON s.place = p.place AND s.street = p.street), "
    "ca AS (SELECT p.id, p.block, sx, sy FROM p JOIN s ON s.place = p.place AND (s.street = p.street OR ((p.place, p.street) NOT IN (SELECT (place, street) FROM ex) AND length(p.street) >= 3 AND length(s.street) >= 3 "
    "AND (contains(p.street, s.street) OR contains(s.street, p.street)))) WHERE p.x IS NULL), "
    "ce AS (SELECT block, median(sx) AS cx, median(sy) AS cy FROM ca GROUP BY block), "
    "c AS (SELECT id, arg_min({sx: sx, sy: sy}, ((sx - cx) ** 2 + (sy - cy) ** 2, sx, sy)) AS s FROM ca JOIN ce USING (block) GROUP BY id), "
    "bc AS (SELECT block, median(x) AS bx, median(y) AS b_y FROM p WHERE x IS NOT NULL GROUP BY block), "
    "q AS (SELECT id, coalesce(x, s.sx, bx, lx) AS x, coalesce(y, s.sy, b_y, ly) AS y, CASE WHEN x IS NOT NULL THEN 2 WHEN s IS NOT NULL THEN 3 WHEN bx IS NOT NULL THEN 4 WHEN lx IS NOT NULL THEN 5 END AS quality "
    "FROM p LEFT JOIN c USING (id) LEFT JOIN bc USING (block) LEFT JOIN lo USING (place)) SELECT id, round(x, 4) AS x, round(y, 4) AS y, quality FROM q WHERE quality IS NOT NULL"
)
def geocoding_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings of unknown year have no point of their own; streets bear the first word of their buildings' names. A
    locality is a kind; the length of its first word says how many areas it has."""
    r = register(spark, sf_dir)
    known = F.col("built").isNotNull()
    p = r.select(
        F.col("bld").alias("id"), (F.col("bld") % 100).alias("block"), F.col("kind").alias("place"), F.col("street"),
        F.when(known, F.col("x")).alias("x"), F.when(known, F.col("y")).alias("y"),
    )
    streets = r.select(F.col("kind").alias("place"), F.substring_index("street", " ", 1).alias("street"), "x", "y")
    areas = F.char_length(F.substring_index("place", " ", 1)) - 4
    localities = r.groupBy(F.col("kind").alias("place")).agg(F.median("x").alias("x"), F.median("y").alias("y")).withColumn("areas", areas)
    return N.geocoded(p, streets, localities).select("id", r6("x", 4).alias("x"), r6("y", 4).alias("y"), "quality")


@query(SQ + ", c AS (SELECT poly, kind, count(*) AS n FROM inq GROUP BY ALL) SELECT poly, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(6), 6) AS entropy FROM c GROUP BY poly")
def mix_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    inside = P.points_in(p, squares(spark, sf_dir), 500.0).join(p.select("id", "kind").hint("merge"), "id")
    return R.entropy(inside, ["poly"], "kind", 6).select("poly", r6("entropy").alias("entropy"))


@query(
    SQ + ", h AS (SELECT poly, bld FROM reg, sq WHERE sqrt(greatest(sx0 - x, 0, x - sx1) ** 2 + greatest(sy0 - y, 0, y - sy1) ** 2) <= 150) "
    "SELECT poly, count(bld) AS n FROM sq LEFT JOIN h USING (poly) GROUP BY poly"
)
def buildings_near_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings inside or within 150 m of each area."""
    return P.points_near_polygons(points(spark, sf_dir), squares(spark, sf_dir), 150.0)


@query(
    ", h AS (SELECT bld AS rid, x AS rx, y AS ry, built AS v FROM reg WHERE built IS NOT NULL), "
    "n AS (SELECT r.bld AS id, arg_min(v, (sqrt((r.x - rx) ** 2 + (r.y - ry) ** 2), rid)) AS v FROM reg r, h WHERE r.built IS NULL GROUP BY r.bld) "
    "SELECT bld AS id, coalesce(built, v) AS built FROM reg LEFT JOIN n ON n.id = bld"
)
def years_from_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown building years from the nearest building that has one."""
    return P.filled_from_nearest(points(spark, sf_dir).select("id", "x", "y", "built"), "built", 300.0).select("id", "built")


@query(
    SQ + " SELECT a.poly AS a, b.poly AS b, CAST(a.i = b.i OR a.j = b.j AS BOOLEAN) AS side FROM sq a JOIN sq b ON a.poly < b.poly AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1"
)
def touching_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that touch, and whether in a side or in a corner alone."""
    s = squares(spark, sf_dir)
    touch, half = grid_contact(s)
    return N.contacts(s, touch).select("a", "b", (F.col("shared") > half).alias("side"))


def grid_contact(s: DataFrame) -> tuple[float, float]:
    """(touch, half a side): how close borders touch, 10 m or a sixteenth of the squares' side. At a corner alone squares share
    three times ``touch``, along a side the side."""
    side = s.agg(F.max("side")).first()[0] or WIDTH
    return min(10.0, side / 16), side / 2


@query(
    SQ + ", c AS (SELECT unnest(range(1, n)) AS ci FROM gn), k AS (SELECT a.ci AS ci, b.ci AS cj FROM c a, c b), "
    "m AS (SELECT ci, cj, count(*) AS d FROM k JOIN sq ON (i = ci OR i = ci - 1) AND (j = cj OR j = cj - 1) GROUP BY ALL) SELECT CAST(CASE WHEN d = 4 THEN 4 ELSE 2 END AS BIGINT) AS degree, count(*) AS n FROM m WHERE d >= 3 GROUP BY 1"
)
def corner_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner corners of the grid as junctions of the areas that meet there: contacts at corners, cleaned."""
    s = squares(spark, sf_dir)
    touch, half = grid_contact(s)
    corners = N.contacts(s, touch).where(F.col("shared") <= half)
    axes = P.with_rectangle(s).join(P.measures(s), "poly").select("poly", "cx", "cy", "hi", "ux", "uy")
    out = N.junctions_clean(corners, axes, N.CleaningRules(cluster=min(12.5, half / 4), straight=1.0))
    return out.groupBy(F.col("degree").cast("long").alias("degree")).agg(F.count("*").alias("n"))


@query(
    ", l AS (SELECT bld, kind, floors * 3.0 AS w, 4.37 + bld % 60 AS h FROM reg), m AS (SELECT *, w * h AS area, 2 * (w + h) AS per, least(w, h) AS lo, greatest(w, h) AS hi FROM l), "
    "r AS (SELECT *, kind <> 'SMALL' AND area > 120 AND ((hi / greatest(lo, 0.1) >= 3.5 AND lo <= 40) OR (4 * pi() * area / per ** 2 < 0.16 AND 2 * area / per < 40) OR (hi / greatest(lo, 0.1) >= 5 AND 2 * area / per < 30)) AS road FROM m) "
    "SELECT kind, count(*) AS n, count(*) FILTER (WHERE road) AS roads, round(sum(area) FILTER (WHERE road), 2) AS area FROM r GROUP BY kind"
)
def road_like_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of many shapes, of which the long and thin ones without homes are roads."""
    p = points(spark, sf_dir)
    turn = F.radians(F.col("id").cast("double"))
    w, h = F.col("floors") * 3.0, 4.37 + F.col("id") % 60

    def corner(a, b):
        return F.struct((a * w * F.cos(turn) - b * h * F.sin(turn)).alias("x"), (a * w * F.sin(turn) + b * h * F.cos(turn)).alias("y"))

    lots = p.select(F.col("id").alias("poly"), F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("rings"))
    homes = p.where("kind = 'SMALL'").select(F.col("id").alias("poly"))
    out = P.road_like(lots, homes).join(p.select(F.col("id").alias("poly"), "kind").hint("merge"), "poly")
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("road").alias("roads"), r6(F.sum(F.when(F.col("road"), F.col("area"))), 2).alias("area"))
