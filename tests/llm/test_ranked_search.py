"""Ranked search against a plain computation of every score."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgrain.llm import ranked_search

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, best):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(a, b) for a, b in items}:
        scored = []
        for i, c in counts:
            m, s = 75 + 25 * sum(c.values()) * n // total, 0
            for t in words(text):
                if t in c:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abdeéilnorstß1") for _ in range(r.randint(1, 6))) for _ in range(300)]
    weight = [1 / (k + 1) for k in range(300)]
    text = lambda n: " ".join(x.upper() if r.random() < 0.1 else x for x in r.choices(vocabulary, weight, k=n))
    docs = [(i, text(r.choice((3, 20, 20, 90, 400)))) for i in range(700)]
    docs += [(5000 + i, docs[3][1]) for i in range(60)] + [docs[3], docs[3], (None, docs[3][1]), (None, None), (9, None), (10, ""), (11, "-- !"), (6000, text(40_000))]
    items = [(f"i{k}", text(r.choice((1, 5, 40, 200)))) for k in range(40)]
    items += [("rare", "zzz yyy"), ("none", None), ("empty", "..."), ("twice", "the " + docs[3][1]), ("twice", "the " + docs[3][1]), ("i1", docs[5][1]), (None, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("best,passes,rows,postings", [(20, 500_000, 8192, 2_000_000), (3, 500, 50, 600), (1, 10**9, 7, 1)])
def test_like_all_scores(spark, corpus, monkeypatch, best, passes, rows, postings):
    docs, items = corpus
    monkeypatch.setattr(ranked_search, "BLOCK_ROWS", rows)
    monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", postings)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("score", F.lit("clash")).withColumn("item", F.lit(1))
    it = spark.createDataFrame(items, "item_id string, text string").withColumn("rank", F.lit(-1))
    items = [x for x in items if x[1] is not None]
    got = ranked_search.ranked(df, it, best, pass_terms=passes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted((tuple(x) for x in got.collect()), key=str)
    want = brute(docs, items, best)
    assert got == want


def test_empty_sides(spark, corpus):
    docs = spark.createDataFrame(corpus[0][:20], "doc_id long, text string")
    items = spark.createDataFrame(corpus[1][:3], "item_id string, text string")
    assert ranked_search.ranked(docs.limit(0), items).count() == 0
    assert ranked_search.ranked(docs, items.limit(0)).count() == 0


def test_reads_end_before_the_lists_do():
    """With a score that must be reached, a block is left as soon as nothing in it can reach that score."""
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop)
            return super().__getitem__(key)

    values = np.arange(100_000, 0, -1)
    lists = [(np.random.default_rng(k).permutation(100_000).view(Counted), values) for k in range(3)]
    place, score = ranked_search.resolved(lists, 100_000, 5, 310_000)
    assert len(place) == 0 and max(reads) == ranked_search.FIRST_READ
    place, score = ranked_search.resolved(lists, 100_000, 5, 0)
    total = sum(np.bincount(np.asarray(p), v, 100_000) for p, v in lists)
    assert sorted(score)[-5:] == sorted(total)[-5:]
