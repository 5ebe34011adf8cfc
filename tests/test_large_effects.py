"""Conjugate gradients, slopes and components against dense least squares and the exact solver."""

import numpy as np
import pandas as pd
import pytest

from landgrain.operators import fixed_effects as E
from landgrain.operators import indices as I
from landgrain.operators import large_effects, supply


def dummies(p, *names):
    return np.hstack([pd.get_dummies(p[c], dtype=float).to_numpy() for c in names])


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(7)
    n = 4000
    p = pd.DataFrame({"g": r.integers(0, 3, n), "b": r.integers(0, 300, n), "t": r.integers(0, 60, n), "s": r.integers(0, 7, n)})
    p["w"], p["x"] = r.uniform(0.5, 2, n), r.normal(size=n)
    p["y"] = 0.7 * p.x + p.b * 0.01 + p.t * 0.1 + p.s * 0.2 + r.normal(size=n)
    return p


@pytest.mark.parametrize("group,weight", [([], None), (["g"], "w"), (["g"], None)])
def test_same_as_exact_solver(spark, rows, monkeypatch, group, weight):
    monkeypatch.setattr(large_effects, "CHUNK", 300)
    d = spark.createDataFrame(rows).repartition(3)
    args = (d, ["y", "x"], ["b", "t", "s"], weight, group)
    exact, large = E.solved(*args).toPandas(), E.solved(*args, most=10).toPandas()
    keys = [*group, "kind", "a", "b"]
    both = exact.merge(large, on=keys, suffixes=("", "_l"))
    assert len(both) == len(exact) == len(large)
    m = both[both.kind == "moment"]
    assert np.allclose(m.value, m.value_l, rtol=1e-9, atol=1e-8)
    p = both[both.kind == "proj"].assign(dim=lambda z: z.a.str[0])
    centred = lambda c: p[c] - p.groupby([*group, "b", "dim"])[c].transform("mean")
    assert np.allclose(centred("value"), centred("value_l"), atol=1e-8)
    assert (p.component == p.component_l).all()


def test_weighted_fit_through_either_solver(spark, rows, monkeypatch):
    d = spark.createDataFrame(rows)
    one = E.fe_ols(d, "y", ["x"], ["b", "t", "s"], "b", "w")
    monkeypatch.setattr(E, "MOST", 10)
    monkeypatch.setattr(E.solved, "__defaults__", tuple(10 if v == 5000 else v for v in E.solved.__defaults__))
    two = E.fe_ols(d, "y", ["x"], ["b", "t", "s"], "b", "w")
    assert np.allclose(one.beta, two.beta, atol=1e-9) and np.allclose(one.se, two.se, atol=1e-9)


def test_too_many_levels_are_refused(spark, rows, monkeypatch):
    monkeypatch.setattr(large_effects, "MOST", 20)
    with pytest.raises(ValueError, match="levels"):
        E.solved(spark.createDataFrame(rows), ["y"], ["b", "t"], most=10)


@pytest.mark.parametrize("most", [5000, 1])
def test_two_unlinked_towns(spark, most):
    """Levels of the second town are comparable with each other alone; a chain of units links the first town's."""
    chain = [(f"u{k}", f"a{k + j:02d}", 1.0 * k + 3 * j) for k in range(9) for j in (0, 1)]
    other = [("v1", "z1", 5.0), ("v1", "z2", 7.0), ("v2", "z2", 1.0), ("v2", "z3", 4.0)]
    d = spark.createDataFrame([*chain, *other], "u string, t string, y double")
    got = E.solved(d, ["y"], ["u", "t"], most=most).where("kind = 'proj'").toPandas().set_index("a")
    assert set(got.component[got.index.str.startswith("0:a")]) == {"0:a00"} and set(got.component[got.index.str.startswith("0:z")]) == {"0:z1"}
    z = got.value[["0:z1", "0:z2", "0:z3"]].to_numpy()
    assert np.allclose(np.diff(z), [2, 3])
    if most == 5000:
        index = I.fe_index(d, "y", "u", "t", [], E.F.col("t") == "a00").toPandas().set_index("t")["index"]
        assert index[["z1", "z2", "z3"]].isna().all() and np.allclose(np.log(index[["a00", "a01", "a09"]] / 100), [0, 3, 27])
        drift = I.drift(d, "y", "u", "t", []).toPandas().set_index("t").drift
        assert drift["z2":].isna().all() and abs(drift["a04"] - 12) < 1e-8
        premium = I.premiums(d, "y", "t", "z1", "u", []).toPandas().set_index("t").premium
        assert premium[:"a09"].isna().all() and np.allclose(np.log1p(premium["z1":]), [0, 2, 5])


@pytest.fixture(scope="module")
def unbalanced():
    r = np.random.default_rng(3)
    p = pd.DataFrame([(m, y) for m in range(15) for y in range(1998, 2016)], columns=["m", "y"])
    p = p[r.uniform(size=len(p)) > 0.3].reset_index(drop=True)
    p = pd.concat([p, pd.DataFrame({"m": [99], "y": [2001]})], ignore_index=True)  # a market with one period
    p["z"] = r.normal(size=len(p)).cumsum() * 0.1
    p["x"] = p.z + 0.05 * p.m * (p.y - 2000) + r.normal(size=len(p))
    p["p"] = 0.4 * p.x + 0.1 * p.m * (p.y - 2005) + 0.3 * (p.y % 5) + r.normal(size=len(p))
    return p


@pytest.mark.parametrize("iv", [False, True])
def test_trends_on_an_unbalanced_panel(spark, unbalanced, iv):
    p = unbalanced
    trend = pd.get_dummies(p.m, dtype=float).mul(p.y - 2005, axis=0).to_numpy()
    d = np.hstack([dummies(p, "m", "y"), trend])
    m = np.eye(len(p)) - d @ np.linalg.pinv(d)
    x, y, z = m @ p.x, m @ p.p, m @ (p.z if iv else p.x)
    fitted = z * (z @ x) / (z @ z)
    beta = fitted @ y / (fitted @ x)
    e = fitted * (y - beta * x)
    s = np.array([e[p.m == k].sum() for k in p.m.unique()])
    se = np.sqrt((s @ s) * len(s) / (len(s) - 1)) / (fitted @ fitted)
    fit = supply.panel_regression(spark.createDataFrame(p), "p", "x", "m", "y", "z" if iv else None, trends=True)
    assert np.allclose([fit.beta[0], fit.se[0]], [beta, se], atol=1e-7)


def test_thin_cells_leave_after_the_fit(spark, rows):
    p = rows.assign(m="a|b" + rows.g.astype(str), t=rows.t % 6, b=rows.b.astype(str) + "x" + (rows.index % 2).astype(str))
    p = pd.concat([p[~((p.m == "a|b1") & (p.t == 3))], p[(p.m == "a|b1") & (p.t == 3)].head(4), p.head(1).assign(b="single", m="a|b0", t=5)])
    got = supply.market_index(spark.createDataFrame(p), "y", ["m"], "t", "b", ["s"], 2, 5).toPandas().set_index(["m", "t"]).lp
    p = p[p.groupby("b").b.transform("size") >= 2]
    cell = pd.get_dummies(p.m + "#" + p.t.astype(str), dtype=float)
    full = pd.Series(np.linalg.lstsq(np.hstack([cell, dummies(p, "b", "s")]), p.y.to_numpy(), rcond=None)[0][: cell.shape[1]], cell.columns)
    assert ("a|b1", 3) not in got.index and len(got) == 17
    for (m, t), v in got.items():
        assert abs(v - (full[f"{m}#{t}"] - full[f"{m}#2"])) < 1e-8
