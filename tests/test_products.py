"""The cross products of a model come from one pass over its rows."""

import numpy as np
import pandas as pd
import pytest

from landgrain.operators import fixed_effects as E


def table(spark, n=900):
    r = np.random.default_rng(2)
    p = pd.DataFrame({"g": r.choice(["a", None], n), "b": r.integers(0, 4, n), "t": r.integers(0, 9, n), "s": r.integers(0, 3, n)})
    p["w"], p["x"], p["y"], p["z"] = r.uniform(0.5, 2, n), r.normal(size=n), r.normal(size=n), r.normal(size=n)
    return p, spark.createDataFrame(p)


def test_rows_are_made_once(spark):
    plan = E.gram(spark.range(9).selectExpr("id y", "id b", "id t", "id s"), ["y"], ["b", "t", "s"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and "Expand" not in plan


@pytest.mark.parametrize("slope", [None, "z"])
@pytest.mark.parametrize("part", [7, 100_000])
def test_units_that_go_on_over_many_parts(spark, monkeypatch, part, slope):
    monkeypatch.setattr(E, "PART", part)
    p, d = table(spark)
    got = E.gram(d, ["y", "x"], ["b", "t", "s"], "w", ["g"], slope).toPandas()
    for g in ("a", None):
        q = p[p.g.isna()] if g is None else p[p.g == g]
        f = pd.concat([pd.get_dummies(q.t).add_prefix("0:"), pd.get_dummies(q.s).add_prefix("1:"), q[["x", "y"]].add_prefix("c:")], axis=1).astype(float)
        big = pd.get_dummies(q.b, dtype=float).to_numpy()
        big = np.hstack([big, big * q.z.to_numpy()[:, None]]) if slope else big
        w = np.sqrt(q.w.to_numpy())[:, None]
        left = w * f - (w * big) @ np.linalg.lstsq(w * big, w * f.to_numpy(), rcond=None)[0]
        want = left.T @ left
        mine = got[got.g.isna()] if g is None else got[got.g == g]
        assert set(mine.i) | set(mine.j) == set(f.columns)
        assert np.allclose([want.loc[i, j] for i, j in zip(mine.i, mine.j)], mine.v, atol=1e-8)
        assert len(mine) >= (np.abs(np.triu(want.loc[sorted(f), sorted(f)])) > 1e-9).sum()


def test_no_matrix_of_more_levels_than_most():
    """a single part may hold any number of levels; none of them gets a row of a matrix."""
    one = np.arange(200_000)
    model = E.Products(["y"], False, 5_000)
    assert not model.add(one // 4, np.ones(len(one)), [one.astype(str).astype(object)], [np.ones(len(one))], None, False)
    assert model.total.shape == (1, 1)
