"""The exact solver against dense least squares."""

import numpy as np
import pandas as pd
import pytest

from landgrain.operators import fixed_effects as E
from landgrain.operators import indices as I


@pytest.fixture(scope="module")
def panel():
    r = np.random.default_rng(1)
    n = 900
    p = pd.DataFrame({"b": r.integers(0, 60, n), "t": r.integers(0, 9, n), "s": r.integers(0, 5, n)})
    p["z"], p["z2"], p["v"], p["w"] = r.normal(size=n), r.normal(size=n), r.normal(size=n), r.uniform(0.5, 2, n)
    p["x"] = p.z + 0.5 * p.z2 + r.normal(size=n)
    p["y"] = 0.7 * p.x - 0.3 * p.v + p.b * 0.01 + p.t * 0.1 + p.s * 0.2 + r.normal(size=n)
    return p


def dummies(p, *names):
    return np.hstack([pd.get_dummies(p[c], dtype=float).to_numpy() for c in names])


def test_weighted_clustered_ols(spark, panel):
    p, w = panel, np.sqrt(panel.w.to_numpy())[:, None]
    d = dummies(p, "b", "t", "s") * w
    m = np.eye(len(p)) - d @ np.linalg.pinv(d)
    x, y = m @ (p[["x", "v"]].to_numpy() * w), m @ (p.y.to_numpy() * w[:, 0])
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    scores = np.array([(x[p.b == k] * (y - x @ beta)[p.b == k, None]).sum(0) for k in p.b.unique()])
    g = len(scores)
    fit = E.fe_ols(spark.createDataFrame(p), "y", ["x", "v"], ["b", "t", "s"], "b", "w")
    assert np.allclose(fit.beta, beta, atol=1e-8)
    assert np.allclose(fit.se, np.sqrt(np.diag(bread @ (scores.T @ scores) @ bread) * g / (g - 1)), atol=1e-8)
    assert fit.n == len(p) and fit.clusters == g


def test_two_stage(spark, panel):
    p, d = panel, dummies(panel, "b", "t")
    m = np.eye(len(p)) - d @ np.linalg.pinv(d)
    x, z, y = m @ p[["x", "v"]].to_numpy(), m @ p[["z", "z2", "v"]].to_numpy(), m @ p.y.to_numpy()
    q = z @ np.linalg.pinv(z)
    fit = E.fe_2sls(spark.createDataFrame(p), "y", ["x"], ["z", "z2"], ["v"], ["b", "t"], "b")
    assert np.allclose(fit.beta, np.linalg.solve(x.T @ q @ x, x.T @ q @ y), atol=1e-8)
    assert fit.first_stage_f["x"] > 10


def test_effects_by_group_do_not_depend_on_partitions(spark, panel):
    p = panel.assign(g=panel.b % 2)
    one = E.level_effects(spark.createDataFrame(p), "y", ["b", "t", "s"], group=["g"])
    two = E.level_effects(spark.createDataFrame(p.sample(frac=1, random_state=2)).repartition(7), "y", ["b", "t", "s"], group=["g"])
    f = lambda e: e.toPandas().pivot(index=["g", "dim"], columns="level", values="effect")
    assert np.allclose(f(one), f(two), atol=1e-8, equal_nan=True)
    own = p[p.g == 1]
    full = np.linalg.lstsq(dummies(own, "b", "t", "s"), own.y.to_numpy(), rcond=None)[0]
    k = own.b.nunique()
    want = full[k : k + 9] - full[k]
    got = f(one).loc[(1, "t")].dropna().sort_index().to_numpy()
    assert np.allclose(got - got[0], want, atol=1e-8)


def test_components_a_singleton_and_residuals(spark):
    p = pd.DataFrame({"b": [1, 1, 2, 2, 3], "t": [1, 2, 1, 2, 9], "y": [1.0, 2.0, 3.0, 4.5, 7.0]})
    r = E.residualised(spark.createDataFrame(p), ["y"], ["b", "t"]).toPandas()
    assert abs(r.groupby("b").r_y.sum()).max() < 1e-9 and abs(r.groupby("t").r_y.sum()).max() < 1e-9
    assert abs(r[r.b == 3].r_y).max() < 1e-9


def test_alternating_agrees(spark, panel):
    d = spark.createDataFrame(panel[["b", "t", "y"]])
    rows, change = E.alternating(d, "y", ["b", "t"], 25, 1e-6)
    exact = E.residualised(d, ["y"], ["b", "t"]).toPandas().r_y
    assert change < 1e-4 and np.allclose(np.sort(rows.toPandas().r_y), np.sort(exact), atol=1e-3)


def test_grouped_ols(spark, panel):
    got = E.grouped_ols(spark.createDataFrame(panel), ["s"], "y", ["x", "v"], "b").toPandas()
    own = panel[panel.s == 2]
    want = np.linalg.lstsq(np.hstack([own[["x", "v"]].to_numpy(), dummies(own, "b")]), own.y.to_numpy(), rcond=None)[0][:2]
    assert np.allclose(got[got.s == 2].set_index("term").beta[["x", "v"]], want, atol=1e-8)


def test_empty_table(spark, panel):
    d = spark.createDataFrame(panel).where("b < 0")
    assert E.level_effects(d, "y", ["b", "t"]).count() == 0
    assert I.chained_index(d, "y", ["x"], "b", "t").count() == 0
