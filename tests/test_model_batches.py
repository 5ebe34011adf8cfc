"""Batches of models against the same models one by one, with as many jobs for many models as for few."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landgrain.operators import fixed_effects as E
from landgrain.operators.fixed_effects import Model


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(5)
    n = 1200
    p = pd.DataFrame({"b": r.integers(0, 50, n), "t": r.integers(0, 9, n), "s": r.integers(0, 5, n), "g": r.choice(["u", "v"], n)})
    p["z"], p["z2"], p["v"], p["w"] = r.normal(size=n), r.normal(size=n), r.normal(size=n), r.uniform(0.5, 2, n)
    p["x"] = p.z + 0.5 * p.z2 + r.normal(size=n)
    p["y"] = 0.7 * p.x - 0.3 * p.v + p.b * 0.01 * p.t + p.s * 0.2 + r.normal(size=n)
    p.loc[r.uniform(size=n) < 0.02, "v"] = None
    return spark.createDataFrame(p)


MODELS = [
    Model("plain", "y", ("x",), ("b",), "b"),
    Model("three", "y", ("x", "v"), ("b", "t", "s"), "s", "w"),
    Model("iv", "y", ("v",), ("b", "t"), "b", None, ("x",), ("z", "z2")),
    Model("trend", "y", ("x",), ("b", "t"), "b", slope="t"),
    Model("part", "y", ("v",), ("t", "s"), "b", where="s < 3"),
    Model("by row", "y", ("x", "v"), ("t",)),
]


def test_same_as_one_by_one(spark, panel):
    got = E.fitted_models(panel, MODELS).toPandas().set_index(["model", "term"])
    assert len(got) == 9
    for m in MODELS:
        d = panel.where(m.where) if m.where else panel
        f = E.fe_2sls(d, m.y, list(m.endogenous), list(m.instruments), list(m.exogenous), list(m.absorb), m.cluster, m.weight, slope=m.slope) if m.instruments else E.fe_2sls(d, m.y, [], [], m.terms, list(m.absorb), m.cluster, m.weight, slope=m.slope)
        mine = got.loc[m.name].loc[f.terms]
        assert np.allclose(mine.beta, f.beta, atol=1e-8) and np.allclose(mine.se, f.se, atol=1e-8)
        assert np.allclose(mine.r2_within, f.r2_within, atol=1e-8) and (mine.n == f.n).all() and (m.cluster is None or (mine.clusters == f.clusters).all())
        if m.instruments:
            assert np.allclose(mine.first_stage_f.iloc[0], f.first_stage_f["x"], rtol=1e-7) and np.allclose(mine.partial_r2.iloc[0], f.partial_r2["x"], atol=1e-8)
        else:
            assert mine.first_stage_f.isna().all()
    by_row = E.fe_2sls(panel, "y", [], [], ["x", "v"], ["b", "t", "s"], None, "w")
    assert np.allclose(got.loc["three"].loc[["x", "v"]].se_hc, by_row.se, atol=1e-8)


def test_models_by_group_and_number_of_jobs(spark, panel):
    sc = spark.sparkContext

    def run(models, name):
        sc.setJobGroup(name, name)
        out = E.fitted_models(panel, models, ["g"]).collect()
        jobs = len(sc.statusTracker().getJobIdsForGroup(name))
        sc.setJobGroup("", "")
        return out, jobs

    few, jobs = run(MODELS[:2], "few")
    many, jobs_too = run([*MODELS[:4], *(Model(f"m{k}", "y", ("x",), ("b", "t"), "b", where=f"s <> {k}") for k in range(5))], "many")
    assert jobs_too <= jobs + 2
    fit = E.fe_ols(panel.where("g = 'v'"), "y", ["x"], ["b"], "b")
    mine = [r for r in many if (r.g, r.model) == ("v", "plain")][0]
    assert abs(mine.beta - fit.beta[0]) < 1e-9 and abs(mine.se - fit.se[0]) < 1e-9


def test_no_rows(panel):
    assert E.fitted_models(panel.where(F.lit(False)), MODELS[:3]).count() == 0


def test_columns_far_from_zero(spark, panel):
    """residuals are told apart by the same digits wherever the columns lie, as absorbed effects take up constants."""
    far = panel.withColumns({c: F.col(c) + 10_000 for c in ("y", "x", "z")})
    models = [Model("iv", "y", (), ("b", "t"), "b", None, ("x",), ("z",)), Model("trend", "y", ("x",), ("b", "t"), "b", slope="t")]
    a, b = (E.fitted_models(d, models).toPandas().sort_values("model") for d in (panel, far))
    for c in ("beta", "se", "se_hc", "r2_within", "first_stage_f"):
        np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-9)
