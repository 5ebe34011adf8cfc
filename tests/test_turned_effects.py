"""of two dimensions the one with more levels is partialled out, whichever was named first."""

import numpy as np
import pandas as pd
import pytest

from landgrain.operators import fixed_effects as E
from landgrain.operators import large_effects


@pytest.mark.parametrize("weight", [None, "w"])
def test_more_small_levels_than_the_driver_may_hold(spark, monkeypatch, weight):
    r = np.random.default_rng(4)
    p = pd.DataFrame({"b": r.integers(0, 40, 2_000), "t": r.integers(0, 300, 2_000)})
    p["b"] += 100 * (p.t >= 290)  # a second component
    p["w"], p["y"] = r.uniform(0.5, 2, len(p)), r.normal(size=len(p)) + p.t / 9 + p.b / 7
    d = spark.createDataFrame(p)
    want = E.level_effects(d, "y", ["b", "t"], weight).toPandas()
    monkeypatch.setattr(E, "MOST", 150)
    monkeypatch.setattr(large_effects, "MOST", 150)
    got = E.level_effects(d, "y", ["b", "t"], weight).toPandas()
    both = want.merge(got, on=["dim", "level"], suffixes=("", "_n"))
    assert len(both) == len(want) == len(got) and both.groupby("component").component_n.nunique().eq(1).all() and both.component.nunique() == 2
    centred = lambda c: both[c] - both.groupby("component")[c].transform("mean")
    assert np.allclose(centred("effect"), centred("effect_n"), atol=1e-8)
    assert (both.component == both.component_n).all()
