"""Expressions, sources, relational, spatial and network operators on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgrain.functions import exprs as X
from landgrain.operators import network as N
from landgrain.operators import relational as R
from landgrain.operators import spatial as P
from landgrain.operators.components import components
from landgrain.sources import tables as S


def test_floor_texts(spark):
    cases = {
        "3": 3, "קומה 12": 12, "-1": -1, "קרקע": 0, "שניה": 2, "עשירית": 10, "אחת עשרה": 11, "שניים עשרה": 12, "עשרים": 20,
        "עשרים ושלוש": 23, "חמישים ותשע": 59, "‏שלישית‎": 3, "דופלקס": None, "": None, None: None, "מרתף": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.f for r in X.parsed_once(df, "t", "f").collect()}
    assert got == cases


def test_street_key_and_commerce(spark):
    rows = [("רחוב הרצל", "הרצל"), ("שד' רוטשילד", "רוטשילד"), ("רח", "רח"), ("דרך-יפו 3", "יפו3")]
    df = spark.createDataFrame(rows, "n string, want string").withColumn("k", X.street_key("n"))
    assert [r for r in df.collect() if r.k != r.want] == []
    c = spark.createDataFrame([("Bakery",), ("primary_school",), (None,), ("",)], "c string")
    assert [r[0] for r in c.select(X.excluded("c")).collect()] == [True, False, False, False]


def test_bins_and_scaling(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (None,), (float("nan"),)], "v double")
    right = [r[0] for r in df.select(X.binned("v", [0, 1, 2], ["a", "b"], other="na")).collect()]
    assert right == ["na", "a", "b", "na", "na", "na"]
    left = [r[0] for r in df.select(X.binned("v", [0, 1, 2], ["a", "b"], "left")).collect()]
    assert left == ["a", "b", None, None, None, None]
    assert [r[0] for r in df.select(X.finite("v")).collect()][-1] is None
    s = spark.createDataFrame([(123456.0,), (0.00123456,), (0.0,), (-98765.0,)], "v double")
    assert [r[0] for r in s.select(X.significant("v")).collect()] == pytest.approx([123500.0, 0.001235, 0.0, -98770.0])
    high, low = X.key_parts("k", 100_000)
    assert spark.sql("SELECT 1234500042L AS k").select(high, low).first()[:] == (12345, 42)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2.5\n2,x\n")
    got = S.read_text_table(spark, str(tmp_path / "a.csv"), {"k": "int", "v": "double"}, ("k",)).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 2.5), (2, None)]
    (tmp_path / "g.json").write_text(
        '{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": "p"}, "geometry": {"type":'
        ' "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}}, {"type": "Feature", "properties": {"id": "q"},'
        ' "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},'
        ' {"type": "Feature", "properties": {"id": "r"}, "geometry": null}]}'
    )
    g = S.read_geojson(spark, str(tmp_path / "g.json"), ["id"])
    assert {r.poly: round(r.area, 6) for r in P.measures(g.withColumnRenamed("id", "poly")).collect()} == {"p": 2.0, "q": 1.0}
    t = spark.createDataFrame([("a", 1, None), ("a", 2, 3.0), ("b", 5, 6.0)], "k string, x int, y double")
    back = S.unpack_rows(S.pack_rows(t, "k", ["x", "y"]), "packed", ";", ",", {"x": "int", "y": "double"})
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, t.collect()), key=str)
    tiles = S.write_tiled(spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (1.6, 0.4)], "x double, y double"), str(tmp_path / "t"), "x", "y", 1.0)
    assert sorted(map(tuple, tiles.collect())) == [(0, 0, 1), (1, 0, 2)] and spark.read.parquet(str(tmp_path / "t")).count() == 3
    S.write_json(spark.sql("SELECT 1 AS a, double('NaN') AS b"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":null}'
    assert S.stage(t, str(tmp_path / "s")).count() == 3


def test_windows_and_quantiles(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 5, 1, 9, 2, 5])], "k string, t int, v double")
    assert [r.bin for r in R.quantile_bins(df, "v", 3).orderBy("t").collect()] == [1, 1, 0, 2, 0, 1]
    m = R.moving_mean(df, ["k"], "t", "v", "s").orderBy("t").collect()
    assert m[0].s == 5 and m[1].s == pytest.approx(11 / 3) and m[-1].s == 5
    holes = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0)], "k string, t int, v double")
    assert [r.v for r in R.carried(holes, ["k"], "t", "v").orderBy("t").collect()] == [1.0, 1.0, 3.0]
    d = spark.createDataFrame([("x",), ("y",)], "name string")
    assert [r.name for r in R.undocumented(d, d.where("name = 'x'")).collect()] == ["y"]


def test_polygons(spark):
    square = lambda a, b, c, d: [{"x": float(x), "y": float(y)} for x, y in [(a, b), (c, b), (c, d), (a, d)]]
    schema = "poly int, rings array<array<struct<x:double,y:double>>>"
    hole = square(4, 4, 6, 6)[::-1]
    polys = spark.createDataFrame([(1, [square(0, 0, 10, 10), hole]), (2, [square(10, 0, 20, 10)]), (3, [square(8, 8, 12, 12)])], schema)
    m = {r.poly: r for r in P.measures(polys).collect()}
    assert m[1].area == 96 and m[1].cx == pytest.approx(5) and m[2].perimeter == 40
    rng = np.random.default_rng(3)
    xy = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2, 22, (400, 2)))] + [(900, 10.0, 5.0), (901, 5.0, 5.0)]
    got = {r.id: r.poly for r in P.points_in(spark.createDataFrame(xy, "id int, x double, y double"), polys, 3.0).collect()}

    def want(x, y):
        if 0 <= x < 10 and 0 <= y < 10 and not (4 <= x < 6 and 4 <= y < 6):
            return 1
        if 10 <= x < 20 and 0 <= y < 10:
            return 2
        return 3 if 8 <= x < 12 and 8 <= y < 12 else None

    assert got == {i: want(x, y) for i, x, y in xy if want(x, y)}
    outline = P.dissolved(polys.where("poly < 3").withColumn("u", F.lit("all")), "u")
    assert outline.agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()[0] == 60 + 8
    near = P.points_near_polygons(spark.createDataFrame([(1, 21.0, 5.0), (2, 24.0, 5.0), (3, 15.0, 5.0)], "id int, x double, y double"), polys.where("poly = 2"), 2.0)
    assert near.first().n == 2


def test_nearest_and_fill(spark):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(0, 1000, (60, 2)), rng.uniform(0, 3000, (15, 2))
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "id int, x double, y double")
    right = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "rid int, rx double, ry double")
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    got = {r.id: (r.rid, r.d) for r in P.nearest(left, right, 50.0).collect()}
    assert all(got[i][0] == d[i].argmin() and got[i][1] == pytest.approx(d[i].min()) for i in range(60))
    areas = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 5.0, 0.0, None), (3, 100.0, 0.0, "b")], "id int, x double, y double, v string")
    assert {r.id: r.v for r in P.filled_from_nearest(areas, "v", 10.0).collect()} == {1: "a", 2: "a", 3: "b"}


def test_rectangles_roads_and_contacts(spark):
    turn = lambda pts, a: [{"x": float(x * math.cos(a) - y * math.sin(a)), "y": float(x * math.sin(a) + y * math.cos(a))} for x, y in pts]
    strip = [(0, 0), (100, 0), (100, 8), (0, 8)]
    schema = "poly int, rings array<array<struct<x:double,y:double>>>"
    cross = [(101, -50), (109, -50), (109, 58), (101, 58)]
    df = spark.createDataFrame([(1, [turn(strip, 0.5)]), (2, [turn([(0, 0), (30, 0), (30, 30), (0, 30)], 0.2)]), (3, [turn(cross, 0.5)])], schema)
    r = {x.poly: x for x in P.road_like(df, df.where("poly = 9")).collect()}
    assert r[1].lo == pytest.approx(8) and r[1].hi == pytest.approx(100) and r[1].road and not r[2].road and r[3].road
    roads = df.where("poly <> 2")
    c = N.contacts(roads, 2.0)
    assert [(x.a, x.b) for x in c.collect()] == [(1, 3)]
    axes = P.road_like(roads, df.where("poly = 9"))
    j = N.junctions_clean(c, axes).collect()
    assert len(j) == 1 and j[0].kind == 1 and j[0].degree == 2
    assert N.junctions(c).count() == 1


def test_street_grid(spark):
    """A line of two segments through a mid-segment connector, a cul-de-sac and a loop."""
    schema = "id int, connectors array<struct<connector_id:string,at:double>>, points array<struct<x:double,y:double>>"
    pts = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    con = lambda *c: [{"connector_id": k, "at": float(a)} for k, a in c]
    seg = spark.createDataFrame(
        [
            (1, con(("A", 0), ("B", 0.5), ("C", 1)), pts((0, 0), (100, 0), (200, 0))),
            (2, con(("B", 0), ("D", 1)), pts((100, 0), (100, 60), (160, 60))),
            (3, con(("C", 0), ("C", 1)), pts((200, 0), (240, 0), (240, 40), (200, 0))),
        ],
        schema,
    )
    n = {r.connector_id: r.streets for r in N.street_counts(seg).collect()}
    assert n == {"A": 1, "B": 3, "C": 3, "D": 1}
    got = sorted((r.id, round(r.net, 6), round(r.chord, 6)) for r in N.circuity_pieces(seg).collect())
    assert got == [(1, 100, 100), (1, 100, 100), (2, 120, round(math.hypot(60, 60), 6))]
    p = N.pieces(seg).where("id = 2").orderBy("pos").collect()
    assert [(x.length, round(x.bearing, 6)) for x in p] == [(60, 0.0), (60, 90.0)]
    e = N.orientation_entropy(N.pieces(seg).withColumn("z", F.lit(1)), ["z"], 10).first().entropy
    assert 0 < e < 1


def test_components_on_a_long_chain(spark):
    ids = spark.range(60)
    edges = ids.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("b < 50 and b <> 30")
    got = {r.id: r.comp for r in components(ids, edges).collect()}
    assert got == {i: 0 if i < 30 else 30 if i < 50 else i for i in range(60)}


def test_footprint_and_urban_land(spark):
    sides = spark.createDataFrame([(50.0, 50.0, 150.0, 50.0)], "x1 double, y1 double, x2 double, y2 double")
    schema = "poly int, rings array<array<struct<x:double,y:double>>>"
    area = spark.createDataFrame([(1, [[{"x": float(x), "y": float(y)} for x, y in [(-100, -100), (300, -100), (300, 300), (-100, 300)]]])], schema)
    got = P.footprint(sides, area, 2.0, 20.0).first().area
    assert got == pytest.approx(100 * 40 + math.pi * 400, rel=0.02)
    # 1 is covered well and calibrates (80,000 of parcel land under 5 ha by 40,000 of footprint); 2 is covered little and has
    # streets, 3 is covered little and has none, 4 is covered well by one parcel of 9 ha, which is no urban land.
    parcels = spark.createDataFrame([(1, 45_000.0), (1, 40_000.0), (1, 60_000.0), (2, 1_000.0), (3, 25_000.0), (4, 90_000.0)], "poly int, area double")
    areas = spark.createDataFrame([(1, 150_000.0), (2, 200_000.0), (3, 200_000.0), (4, 100_000.0)], "poly int, area double")
    street = spark.createDataFrame([(1, 42_500.0), (2, 50_000.0), (3, 0.0), (4, 10_000.0)], "poly int, a double")
    got = {r.poly: (r.urban, r.source) for r in P.urban_land(parcels, areas, street, large=80_000).collect()}
    assert got == {1: (85_000.0, "parcels"), 2: (100_000.0, "street"), 3: (25_000.0, "parcels")}


def test_node_shares(spark):
    """A cul-de-sac, a bend, two three-way nodes and two four-way ones: bends count in neither share."""
    rows = [(1, k) for k in (1, 2, 3, 3, 4, 5)] + [(2, k) for k in (1, 1, 2, 3)]
    got = {r.z: r for r in N.node_shares(spark.createDataFrame(rows, "z int, streets int"), ["z"]).collect()}
    assert got[1].dead_ends == pytest.approx(1 / 5) and got[1].four_way is None and got[1].nodes == 6
    assert got[2].dead_ends is None and got[2].four_way is None
    got = N.node_shares(spark.createDataFrame([(1, k) for k in (3, 3, 3, 4, 4, 2)], "z int, streets int"), ["z"]).first()
    assert got.four_way == pytest.approx(2 / 5) and got.dead_ends == 0.0


def test_nearest_of_far_and_missing_points(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 9e5, 9e5, "a"), (3, 5.0, 5.0, "b"), (4, 5.0, 5.0, "c")], "id int, x double, y double, g string")
    right = spark.createDataFrame([(7, 3.0, 4.0, "a"), (8, -3.0, 4.0, "a"), (9, 1.0, 1.0, "b")], "rid int, rx double, ry double, g string")
    got = sorted((r.id, r.rid, r.rank, round(r.d, 3)) for r in P.nearest_in_group(left, right, "g", 2, 2.0).collect())
    far = round(math.hypot(9e5 - 3, 9e5 - 4), 3)
    assert [x[:3] for x in got] == [(1, 7, 1), (1, 8, 2), (2, 7, 1), (2, 8, 2), (3, 9, 1)] and got[2][3] == far
    assert P.nearest(left, right.where("rid = 0"), 1.0).count() == 0


def test_lines_and_inner_points(spark):
    schema = "poly int, rings array<array<struct<x:double,y:double>>>"
    pts = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    u = pts((0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30))
    poly = spark.createDataFrame([(1, [u]), (2, [pts((100, 0), (110, 0), (110, 10), (100, 10))])], schema)
    got = {r.poly: (r.x, r.y) for r in P.inner_points(poly).collect()}
    assert got[2] == (105, 5) and got[1][1] == 15 and (0 < got[1][0] < 10 or 20 < got[1][0] < 30)
    lines = [(1, -5.0, 20.0, 40.0, 20.0), (2, 5.0, 5.0, 6.0, 6.0), (3, 14.0, 20.0, 16.0, 20.0), (4, 50.0, 0.0, 90.0, 0.0), (5, 93.0, 5.0, 97.0, 5.0), (6, 0.0, 40.0, 0.0, 50.0)]
    lines = spark.createDataFrame(lines, "id int, x1 double, y1 double, x2 double, y2 double")
    found = lambda r: sorted((x.id, x.poly) for x in P.lines_meeting(lines, poly, r, 7.0).collect())
    assert found(0.0) == [(1, 1), (2, 1)] and found(3.5) == [(1, 1), (2, 1), (5, 2)]


def test_junctions_of_contacts(spark):
    """Three parcels at one place, a tip-to-tip continuation, a T, and a parallel strip."""
    found = spark.createDataFrame(
        [(1, 2, 0.0, 0.0, 5.0), (2, 3, 1.0, 0.0, 5.0), (4, 5, 500.0, 0.0, 5.0), (4, 6, 1000.0, 0.0, 5.0), (7, 8, 2000.0, 0.0, 90.0)],
        "a int, b int, x double, y double, shared double",
    )
    axes = [(1, 0.0, 50.0, 100.0, 0.0, 1.0), (2, -50.0, 0.0, 100.0, 1.0, 0.0), (3, 50.0, 0.0, 100.0, 1.0, 0.0), (4, 750.0, 0.0, 500.0, 1.0, 0.0)]
    axes += [(5, 450.0, 0.0, 100.0, -1.0, 0.0), (6, 1000.0, 50.0, 100.0, 0.0, 1.0), (7, 2000.0, 0.0, 200.0, 1.0, 0.0), (8, 2000.0, 0.0, 200.0, 1.0, 0.0)]
    axes = spark.createDataFrame(axes, "poly int, cx double, cy double, hi double, ux double, uy double")
    got = sorted((r.x, r.degree, r.kind) for r in N.junctions_clean(found, axes).collect())
    assert got == [(0.5, 3, 0), (1000.0, 2, 1)]
