"""What the near-duplicate join sends: few bytes a signature, and each class to the blocks of its own kin only."""

import random

import numpy as np
import pytest

from landgrain.llm import jaccard_join as J


@pytest.mark.parametrize("parts", [1, 7, 70_000])
def test_packed_signatures(parts):
    """bytes hold what they were made of, whatever the number of parts."""
    rng = np.random.default_rng(parts)
    sig = rng.integers(0, 1 << 63, 3_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    node, n = np.sort(J.node_of(rng.integers(-(1 << 63), 1 << 63, 40))[rng.integers(0, 40, 3_000)]), rng.integers(1, 1 << 20, 3_000)
    got, low = [], np.uint64((1 << 8 * J.SIG) - 1)
    rows = J.packed(sig, node, n, parts)
    for part, data in zip(rows["part"], rows["data"]):
        got += [(part, *x) for x in zip(*(x.tolist() for x in J.unpacked(data)))]
    place = [(x >> 32) * parts >> 32 for x in sig.tolist()]
    assert sorted(got) == sorted(zip(place, (sig & low).tolist(), node.tolist(), n.tolist()))
    assert parts > 7 or sum(map(len, rows["data"])) < 10.1 * len(sig)


def test_bytes_of_a_signature(spark):
    """a row of its own took each signature 24 bytes before compression."""
    r = random.Random(1)
    texts = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = J.signed(df, "text", 5, 80, 3).collect()
    count = sum(len(J.signatures(J.shingles(t))) for t in texts)
    assert count * 9 < sum(len(x.data) for x in signed) < count * 10


def test_classes_are_sent_to_their_kin(spark, monkeypatch):
    """families of texts that are like one another but not similar; before, each was sent to most blocks."""
    r = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
        texts += [" ".join(f"y{r.randint(0, 10**6)}" if k in cut else w for k, w in enumerate(base)) for cut in (set(range(6 * i, 6 * i + 5)) for i in range(14))]
    monkeypatch.setattr(J, "TILE", 2_000)
    sizes, whole = {}, J.staged

    def staged(df, name):
        out = whole(df, name)
        sizes[name] = out.count(), out.select("cls").distinct().count() if "cls" in out.columns else 0
        return out

    monkeypatch.setattr(J, "staged", staged)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in J.joined(df).collect()}
    sets = [set(J.shingles(t).tolist()) for t in texts]
    want = {i: sum(100 * len(a & b) >= 80 * len(a | b) for b in sets) - 1 for i, a in enumerate(sets)}
    assert got == want
    assert sizes["sent"][1] > 20 and sizes["sent"][0] <= 3 * sizes["sent"][1]
