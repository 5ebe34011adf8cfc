"""Near duplicates and decontamination against brute force."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from landgrain.llm import decontamination as D
from landgrain.llm import jaccard_join as J


def shingle_set(t):
    w = (t or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))


def brute(texts):
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        c = len(x & y)
        if x and y and 100 * c >= 80 * (len(x) + len(y) - c):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block, parts", [(512, 50_000), (2, 2)])
def test_partenum_finds_every_link(spark, texts, block, parts, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "PARTS", parts)
    monkeypatch.setattr(J, "PART", 2_000_000 if parts > 2 else 300)
    monkeypatch.setattr(J, "FLUSH", 500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_set", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.joined(df).collect()}
    assert got == brute(texts)
    kept = {r.doc_id for r in J.one_each(df).collect()}
    assert kept == {i for i, (_, c) in brute(texts).items() if i == c}


def test_signatures_of_similar_sets_meet():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 6, 9, 14, 25, 60, 150, 700):
        for _ in range(60):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = r.integers(0, max(1, n // 8) + 1)
            new = r.integers(0, max(1, n // 8) + 1)
            b = np.unique(np.r_[r.permutation(a)[gone:], r.integers(0, 1 << 63, new, dtype=np.uint64)])
            c = len(np.intersect1d(a, b))
            if len(b) and 100 * c >= 80 * (len(a) + len(b) - c):
                assert len(np.intersect1d(J.signatures(a), J.signatures(b))) >= J.needed_of([a, b]).max() >= 1


def test_near_duplicates_of_odd_tables(spark):
    assert J.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B c d e f"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in J.joined(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, None), (2, 1), (3, 3)], key=str)
    assert sorted((r.doc_id or 0) for r in J.one_each(df).collect()) == [0, 1, 3]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(docs, items):
    out = {}
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for i, x in items:
            v = WORD.findall(lower(x))
            k = min(13, len(v))
            windows = {tuple(v[s : s + k]) for s in range(len(v) - k + 1)} if v else set()
            for s in range(len(w) - k + 1) if v else ():
                if tuple(w[s : s + k]) in windows:
                    hit |= set(range(s, s + k))
                    found.add(str(i))
        out[d] = (len(w), len(hit), len(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_phrases_like_brute_force(spark, texts):
    words = texts[200].split()
    items = [(1, " ".join(words[:40])), (2, " ".join(words[60:66])), (3, "one"), (4, ""), (5, None), (6, "--"), (1, " ".join(words[:40])), (7, "É é " * 7)]
    docs = [*enumerate(texts), (900, "x " + " ".join(words[5:30]).upper() + "!"), (901, "É é " * 20), (902, "..." + words[60] + "-" + "-".join(words[61:66]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in D.report(d, b).collect()}
    assert got == brute_hits(docs, items)


def brute_near(docs, items, slop):
    """(document, item) pairs with two of an item's anchors displaced by 1 to ``slop``, by the definition."""
    words = {d: WORD.findall(lower(t)) for d, t in docs}
    freq = Counter(w for v in words.values() for w in v)
    out = set()
    for i, x in items:
        v = WORD.findall(lower(x))
        k = min(13, len(v))
        anchors = set()
        for s in range(len(v) - k + 1) if v else ():
            anchors |= set(sorted(range(s, s + k), key=lambda a: (freq[v[a]], v[a], a))[:2])
        for d, w in words.items():
            moved = [(p - a, a) for a in anchors for p, t in enumerate(w) if t == v[a]]
            if any(1 <= t - s <= slop and a != b and abs(a - b) < k for s, a in moved for t, b in moved):
                out.add((d, i))
    return out


def test_proximity_like_brute_force(spark):
    r = random.Random(9)
    vocabulary = ["red", "tide", "owl", "lamp", "fen", "ash", "kit"]
    docs = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25)))) for k in range(60)]
    docs += [(100, "the quick brown old fox jumps"), (101, "quick brown fox"), (102, "a fox is quick and brown"), (103, None)]
    items = [(1, "quick brown fox"), (2, "red tide owl lamp"), (3, " ".join(vocabulary * 3)), (4, "fen"), (5, ""), (6, "kit ash kit ash")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for slop in (1, 3):
        _, near = D.search(d, b, slop=slop)
        assert {(x.doc_id, x.item_id) for x in near.collect()} == brute_near(docs, items, slop)
    got = {x.doc_id: x for x in D.report(d, b).collect()}
    assert got[100].n_near == 1 and got[101].n_items == 1 and got[101].n_near == 0


def test_empty_and_repeated_tables(spark):
    d = spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (None, "quick brown fox"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(5, "quick brown fox"), (5, "quick brown fox"), (None, "quick")], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_hit, r.n_items) for r in D.report(d, b).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 0, 0), (2, 0, 0)], key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in D.report(d, none).collect()] == [0, 0, 0, 0]
    assert D.report(d.where("doc_id = 9"), b).count() == 0
