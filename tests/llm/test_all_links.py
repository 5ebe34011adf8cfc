"""Every link of the near-duplicate join is counted, in groups of bounded size."""

import itertools
import random

import numpy as np
import pytest

from landgrain.llm import jaccard_join as J


@pytest.fixture(scope="module")
def family():
    """Near copies of one text with different words in one place each, and strays."""
    r = random.Random(3)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    near = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(0, 120, 4)]
    far = [" ".join(base[: 60 + 3 * k] + [f"x{k}y{i}" for i in range(60 - 3 * k)]) for k in range(20)]
    return [*near, *near[:3], *far, "", None, "one two"]


def brute_links(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        s = frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets.setdefault(s or i, []).append(i)
    links = {k: 0 for k in sets}
    for a, b in itertools.combinations([s for s in sets if isinstance(s, frozenset)], 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            links[a] += 1
            links[b] += 1
    return {i: links[s] for s, rows in sets.items() for i in rows}


@pytest.mark.parametrize("tile", [1 << 20, 1000])
def test_links_like_brute_force(spark, family, tile, monkeypatch):
    monkeypatch.setattr(J, "TILE", tile)
    df = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in J.joined(df).collect()}
    assert got == brute_links(family) and max(got.values()) >= 29


def test_overlaps_both_ways():
    r = np.random.default_rng(2)
    for most in (40, 400, 1 << 40):
        a, b = ([np.unique(r.integers(0, most, r.integers(1, 90))) for _ in range(n)] for n in (31, 17))
        want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
        assert J.overlaps(a, b).astype(int).tolist() == want


def test_memory_of_a_comparison():
    """Pipeline, near duplicates: two tiles of the usual size are compared in less than 150 MB."""
    import tracemalloc

    rng = np.random.default_rng(1)
    n = J.TILE // J.BLOCK
    common = rng.integers(0, 1 << 63, n * 3 // 2, dtype=np.int64)
    sets = [np.sort(np.r_[rng.choice(common, n - 20, False), rng.integers(0, 1 << 63, 20, dtype=np.int64)]) for _ in range(J.BLOCK)]
    sizes = np.full(J.BLOCK, n)
    tracemalloc.start()
    good = J.similar(sizes, sets, sizes, sets, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert good.diagonal().all() and peak < 150e6
