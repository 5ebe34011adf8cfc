"""Steps whose work must not grow faster than their input: results against brute force, and what bounds them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgrain.operators import components as C
from landgrain.operators import network as N
from landgrain.operators import spatial as P
from landgrain.plans import catalog


def placed(spark, xy, names="id long, x double, y double"):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], names)


def test_touching_areas_of_a_fine_grid(spark, tmp_path):
    """squares of 62 m share fewer metres than a fixed bound of 100."""
    spark.range(160 * 160).select(F.col("id").alias("s_suppkey")).where("s_suppkey < 480").union(
        spark.sql("select cast(25599 as long)")
    ).write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r.a, r.b): r.side for r in catalog.QUERIES["touching_areas"](spark, str(tmp_path)).collect()}
    at = [(k % 160, k // 160, k) for k in range(480)]
    want = {
        (a, b): i == u or j == v
        for i, j, a in at for d, e in ((-1, 1), (0, 1), (1, 1), (1, 0))
        for u, v, b in [(i + d, j + e, (j + e) * 160 + i + d)] if 0 <= u < 160 and v < 3
    }
    assert got == want


def test_nearest_looks_at_small_cells_where_points_are_dense(spark, monkeypatch):
    """the cells shrink with density, copies of one place included, and the neighbours stay the same."""
    rng = np.random.default_rng(3)
    xy = np.vstack([rng.integers(0, 100, (600, 2)), np.full((300, 2), 50)])
    sizes = []
    whole = P.cell
    monkeypatch.setattr(P, "cell", lambda x, size: (sizes.append(size), whole(x, size))[1])
    left, right = placed(spark, xy[::7]), placed(spark, xy, "rid long, rx double, ry double")
    got = {(r.id, r["rank"]): r.rid for r in P.k_nearest(left, right, 3, 500.0).collect()}
    for k, p in enumerate(xy[::7]):
        d = np.hypot(*(xy - p).T)
        assert [got[k, n + 1] for n in range(3)] == sorted(range(len(xy)), key=lambda i: (d[i], i))[:3]
    assert min(sizes) < 20


@pytest.mark.parametrize("spread", [2_000])
def test_chains_of_points_without_their_pairs(spark, monkeypatch, spread):
    """nodes are linked by cells; the pairs within the distance are never built."""
    xy = np.random.default_rng(spread).integers(0, spread, (700, 2))
    label = np.arange(700)
    near = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= 60
    while True:
        new = np.where(near, label, 700).min(1)
        if (new == label).all():
            break
        label = new

    def refuse(*a):
        raise AssertionError("all pairs")

    monkeypatch.setattr(N, "pairs_within", refuse)
    rows = placed(spark, xy).union(spark.sql("select 900L, cast(null as double), 1.0D union all select 901L, cast('NaN' as double), 1.0D"))
    assert {r.id: r.comp for r in P.within_reach(rows, 60.0).collect()} == {**dict(enumerate(label.tolist())), 900: 900, 901: 901}
    got = {(r.comp, r.n) for r in N.consolidated(rows, 60.0).collect()}
    assert got == {(int(c), int(n)) for c, n in zip(*np.unique(label, return_counts=True))} | {(900, 1), (901, 1)}


@pytest.mark.parametrize("n, extra, part", [(700, 0, 500_000), (60, 900, 300), (9, 0, 3)])
def test_components_of_a_winding_chain(spark, monkeypatch, n, extra, part):
    """a chain through nodes in no order took a round of joins for each step of its labels; edges of one part take none."""
    rng = np.random.default_rng(part)
    order, cut = rng.permutation(n), n // 2
    pairs = [(int(a), int(b)) for k, (a, b) in enumerate(zip(order[:-1], order[1:])) if k != cut - 1]
    pairs += [(int(a), int(b)) for a, b in order[rng.integers(0, cut, (extra, 2))]]
    monkeypatch.setattr(C, "PART", part)
    made, whole = [], C.checkpointed
    monkeypatch.setattr(C, "checkpointed", lambda df: (made.append(1), whole(df))[1])
    got = {r.id: r.comp for r in C.components(spark.range(n + 2).select("id"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    low = {int(x): int(side.min()) for side in (order[:cut], order[cut:]) for x in side}
    assert got == {**low, n: n, n + 1: n + 1}
    assert n < 700 or len(made) == 2


def test_names_as_nodes(spark):
    nodes = spark.createDataFrame([("c",), ("b",), ("a",), ("z",)], "id string")
    got = C.components(nodes, spark.createDataFrame([("c", "b"), ("b", "a")], "a string, b string"))
    assert {tuple(r) for r in got.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("z", "z")}


def test_rectangles_of_convex_rings_at_once():
    """the same rectangles as ring by ring, which only rings that are not convex still need."""
    rng = np.random.default_rng(1)
    rings = [rng.normal(size=(int(rng.integers(1, 8)), 2)) for _ in range(300)]
    rings = [P.hull(r)[:: 1 if k % 2 else -1] if k % 3 else r for k, r in enumerate(rings)]
    star = np.array([[0, 0], [4, 3], [-1, 3], [3, 0], [1.5, 5]], float)
    columns = [np.empty(len(rings) + 1, object) for _ in "xy"]
    for k, r in enumerate([*rings, star]):
        columns[0][k], columns[1][k] = r[:, 0].copy(), r[:, 1].copy()
    np.testing.assert_allclose(P.rectangles(*columns), [P.smallest_rectangle(r) for r in [*rings, star]], rtol=1e-12, atol=1e-12)


def test_no_broadcast_of_lots_and_small_cells_for_small_areas(spark, tmp_path):
    """lots, their measures and the areas are joined without a broadcast, and areas of 1 m get cells of their size."""
    square = lambda c: F.array(F.array(*(F.struct((F.col(c) + a).cast("double").alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)))))
    areas = spark.range(3_000).select(F.col("id").alias("poly"), square("id").alias("rings"))
    lots = areas.withColumnRenamed("poly", "id")
    out = P.covered_share(lots, areas, areas.select("poly", F.lit(2.0).alias("ground")), 500.0)
    plan = P.inner_points(lots, "id").join(P.measures(lots, "id").hint("merge"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert [tuple(r) for r in out.where("poly < 2").orderBy("poly").collect()] == [(0, 0.5), (1, 0.5)]
    box = spark.range(3_000).selectExpr("cast(id as double) a", "id + 1.0D b", "0.0D c", "1.0D d")
    assert P.fitting_cells(box, 500.0) < 1.0 + 1e-9


def test_boxes_are_counted_without_their_pairs(spark):
    """counts as by brute force, borders included; a box without bounds failed before. The time is not tested here."""
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.integers(0, 40, (900, 2)), np.full((200, 2), 7), rng.uniform(0, 40, (100, 2))]).astype(float)
    low, wide = rng.integers(-9, 45, (300, 2)), rng.integers(0, 30, (300, 2))
    box = [(k, float(a), float(b), float(a + c), float(b + d)) for k, ((a, b), (c, d)) in enumerate(zip(low, wide))]
    box += [(900, 9.0, 9.0, 3.0, 12.0), (901, None, 1.0, 2.0, 3.0), (902, float("-inf"), 0.0, float("inf"), 1e300)]
    rows = placed(spark, xy).union(spark.sql("select 9000L, cast(null as double), 1.0D union all select 9001L, cast('NaN' as double), 1.0D"))
    found = N.box_counts(rows, spark.createDataFrame(box, "box int, x0 double, y0 double, x1 double, y1 double"), 5.0)
    inside = lambda a, b, c, d: int(((xy >= [a, b]) & (xy <= [c, d])).all(axis=1).sum())
    want = {k: inside(*r) if k < 900 else {902: len(xy)}.get(k, 0) for k, *r in box}
    assert {r.box: r.n for r in found.collect()} == want
    assert N.box_counts(rows.limit(0), spark.createDataFrame(box[:2], found.sparkSession.createDataFrame(box, "box int, x0 double, y0 double, x1 double, y1 double").schema), 5.0).count() == 2


def test_lines_exactly_within_reach(spark):
    """two lanes of lanes_by_area lie exactly 50 m from their area in numbers; the distance is taken from the nearest point,
    so that it is not rounded beyond. The third is off by a little more."""
    side = 10010.0 / 78
    corners = [((66 + a) * side, (46 + b) * side) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    area = spark.createDataFrame([(3654, [corners])], "poly int, rings array<array<struct<x double, y double>>>")
    ends = [(337483, 8422.0, 5884.0, 8446.0, 5852.0), (60407, 8419.0, 6100.0, 8420.0, 6010.0), (1, 8419.0, 6100.0, 8419.999, 6010.0)]
    lines = spark.createDataFrame(ends, "id int, x1 double, y1 double, x2 double, y2 double")
    assert {r.id for r in P.lines_meeting(lines, area, 50.0, 250.0).collect()} == {337483, 60407}


def test_points_near_polygons_without_their_pairs(spark, monkeypatch):
    """counts as by brute force, for large, small, concave and pierced polygons; only in cells at the edge of what is near
    does a point meet a polygon (buildings_near_areas)."""
    rng = np.random.default_rng(6)
    xy = np.vstack([rng.uniform(-20, 220, (6_000, 2)), rng.integers(0, 200, (2_000, 2)), np.full((300, 2), 77.0)])
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    shapes = [[square(float(x), float(y), float(s))] for x, y, s in rng.integers(0, 180, (60, 3)) // [1, 1, 20] + [0, 0, 1]]
    shapes += [[square(10.0, 10.0, 150.0), square(50.0, 50.0, 70.0)[::-1]], [[(5.0, 5.0), (190.0, 20.0), (60.0, 60.0), (20.0, 190.0)]], [[(3.0, 3.0), (100.0, 140.0), (3.0, 9.0)]]]
    poly = spark.createDataFrame(list(enumerate(shapes)), "poly int, rings array<array<struct<x double, y double>>>")
    rows = placed(spark, xy).union(spark.sql("select 90000L, cast(null as double), 1.0D union all select 90001L, cast('NaN' as double), 1.0D"))
    met = []
    whole = P.checkpointed
    monkeypatch.setattr(P, "checkpointed", lambda df: (met.append(whole(df)), met[-1])[1])
    # Where polygons overlap a point is inside of the first alone, so each of the last shapes is counted on its own.
    want = {}
    for k, rings in enumerate(shapes):
        near, odd = np.zeros(len(xy), bool), np.zeros(len(xy), bool)
        for r in rings:
            for a, b in zip(np.array(r), np.array(r[1:] + r[:1])):
                t = np.clip(((xy - a) @ (b - a)) / ((b - a) @ (b - a)), 0, 1)
                near |= np.hypot(*(xy - a - t[:, None] * (b - a)).T) <= 15
                cut = (a[1] > xy[:, 1]) != (b[1] > xy[:, 1])
                with np.errstate(divide="ignore", invalid="ignore"):
                    odd ^= cut & (xy[:, 0] < a[0] + (xy[:, 1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]))
        want[k] = int((near | odd).sum())
    small = poly.where("poly < 60")
    assert {r.poly: r.n for r in P.points_near_polygons(rows, small, 15.0).collect()} == {k: want[k] for k in range(60)}
    for k in range(60, len(shapes)):
        assert [tuple(r) for r in P.points_near_polygons(rows, poly.where(f"poly = {k}"), 15.0).collect()] == [(k, want[k])]
    strips = [df for df in met if "f1" in df.columns]
    assert len(strips) == 4 and strips[0].where("f2 - f1 > 3").count() > 60


def test_geocoder_looks_at_a_streets_pieces_once(spark, monkeypatch):
    """names of a block that lead to one street meet its pieces together, pieces of one place are one row, and the nearest
    is found without sorting what meets (geocoding_cascade)."""
    plans, held, whole = [], [], P.checkpointed
    monkeypatch.setattr(N, "checkpointed", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), held.append(whole(df)), held[-1])[2])
    parcels = [(k, k % 2, "p", f"oak {k % 20}", None, None) for k in range(80)]
    streets = [("p", "oak", float(k % 3), 0.0) for k in range(31)]
    got = N.geocoded(
        spark.createDataFrame(parcels, "id int, block int, place string, street string, x double, y double"),
        spark.createDataFrame(streets, "place string, street string, x double, y double"),
        spark.createDataFrame([("p", 1.0, 1.0, 3)], "place string, x double, y double, areas int"),
    )
    assert {(r.quality, r.x, r.y) for r in got.collect()} == {(3, 1.0, 0.0)}
    assert sorted((r.pieces for df in held if "pieces" in df.columns for r in df.collect())) == [10, 10, 11]
    asked = [df for df in held if set(df.columns) == {"block", "place", "match", "parcels"}]
    assert [sorted(r.parcels for r in df.collect()) for df in asked] == [[40, 40]]
    assert plans and not any("SortAggregate" in p for p in plans)


@pytest.mark.parametrize("most, tile", [(64, 50_000), (4, 7)])
def test_lines_are_counted_where_they_meet(spark, monkeypatch, most, tile):
    """the same counts as by pairs of lines and areas, which are not built for areas of few cells; before, all were."""
    rng = np.random.default_rng(most)
    ends = rng.integers(-20, 120, (150, 2))
    ends = np.hstack([ends, ends + rng.integers(-15, 16, (150, 2))])
    lines = spark.createDataFrame([(k, *map(float, e)) for k, e in enumerate(ends)], "id long, x1 double, y1 double, x2 double, y2 double")
    corner = lambda i, j, w: [[(i + a, j + b) for a, b in ((0.0, 0.0), (w, 0.0), (w, w), (0.0, w))]]
    areas = [(10 * i + j, corner(20.0 * i, 20.0 * j, 20.0)) for i in range(4) for j in range(5)] + [(99, corner(-30.0, 30.0, 60.0))]
    areas = spark.createDataFrame(areas, "poly long, rings array<array<struct<x:double,y:double>>>")
    want = {}
    for k, r in {r.poly: r.rings[0] for r in areas.collect()}.items():
        a, b, c, d = r[0].x, r[2].x, r[0].y, r[2].y
        t = np.linspace(0, 1, 2001)[:, None]
        x, y = ends[:, 0] + t * (ends[:, 2] - ends[:, 0]), ends[:, 1] + t * (ends[:, 3] - ends[:, 1])
        gap = np.hypot(np.maximum(0, np.maximum(a - x, x - b)), np.maximum(0, np.maximum(c - y, y - d))).min(0)
        assert not ((gap > 5.03) & (gap < 5.035)).any()
        want[k] = int((gap <= 5.03).sum())
    monkeypatch.setattr(P, "MOST_CELLS", most)
    monkeypatch.setattr(P, "TILE_LINES", tile)
    monkeypatch.setattr(P, "TILE_SIDES", tile)
    met, whole = [], P.lines_meeting
    monkeypatch.setattr(P, "lines_meeting", lambda *a: (met.append(1), whole(*a))[1])
    assert {r.poly: r.n for r in P.lines_per_polygon(lines, areas, 5.03, 25.0).collect()} == {k: n for k, n in want.items() if n}
    assert len(met) == (most < 9)
    twice = lines.union(lines.limit(3))
    assert {r.poly: r.n for r in P.lines_per_polygon(twice, areas.where("poly < 99"), 5.03, 25.0).collect()} == {k: n for k, n in want.items() if n and k < 99}
