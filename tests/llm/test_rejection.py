"""The rejection threshold of a language is taken from all its training texts."""

import math
from collections import Counter

import numpy as np
import pytest

from landgrain.llm import language_id


def halves(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r.text: r.half for r in df.select("text", language_id.half_of("text")).collect()}


def brute_bits(seen, text, alphabet):
    """Bits per letter of ``text`` by interpolated Kneser-Ney over the texts ``seen``, from its definition."""
    grams = lambda t: [tuple(int(k) >> 12 * i & 4095 for i in range(4, -1, -1)) for k in language_id.strings(language_id.letters(t))]
    counts = {5: Counter(g for t in seen for g in grams(t))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    after = {k: {} for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k].setdefault(g[:-1], []).append(n)

    def p(g):
        if not g:
            return 1 / alphabet
        own = after[len(g)].get(g[:-1])
        if not own:
            return p(g[1:])
        d = language_id.DISCOUNT
        return max(counts[len(g)][g] - d, 0) / sum(own) + d * len(own) / sum(own) * p(g[1:])

    found = grams(text)
    return len(found), -sum(math.log2(p(g)) for g in found) / len(found)


def test_moments_of_all_training_texts(spark):
    """Every text is scored by the model of the other half; one distinct text has no spread of its own."""
    words = "the cat sat on a mat and then it ran away from every dog in town".split()
    english = [" ".join(words[i % 9 : i % 9 + 3 + i % 5]) for i in range(40)]
    german = "der hund lief in den garten"
    rows = [*((t, "en") for t in english), *[(german, "de")] * 5]
    family = language_id.trained(spark.createDataFrame(rows, "text string, lang string"))
    de, en = family.langs.index("de"), family.langs.index("en")
    half = halves(spark, english)
    alphabet = len({int(k) & 4095 for t, _ in rows for k in language_id.strings(language_id.letters(t))}) + 1
    got = [brute_bits([u for u in english if half[u] != half[t]], t, alphabet) for t in english]
    n, bits = np.array([x[0] for x in got]), np.array([x[1] for x in got])
    mean = (bits * n).sum() / n.sum()
    spread = np.sqrt(((bits - mean) ** 2 * n).mean())
    assert family.mean[en] == pytest.approx(mean, rel=1e-5) and family.spread[en] == pytest.approx(spread, rel=1e-4)
    assert family.spread[de] == family.spread[en] and family.mean[de] == family.mean[en]


def test_bits_like_the_definition_in_any_grouping(spark, monkeypatch):
    en = ["the cat and the dog", "a long road to the sea", "the end"]
    de = ["der hund und die katze", "ein langer weg zum meer", "das ende"]
    train = spark.createDataFrame([*((t, "en") for t in en), *((t, "de") for t in de)], "text string, lang string")
    ask = ["the hund ran", "zum ende", "", None, "123", "žluťoučký", "a"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ask)], "i int, text string, _bits string")
    alphabet = len({int(k) & 4095 for t in [*en, *de] for k in language_id.strings(language_id.letters(t))}) + 1
    results = []
    for held in (8_000_000, 1):
        monkeypatch.setattr(language_id, "HELD", held)
        family = language_id.trained(train)
        assert len(family.models) == (1 if held > 1 else 2)
        out = language_id.predicted(docs, family, out="p")
        assert out.columns == [*docs.columns, "p"]
        results.append([(r.p.lang, round(r.p.score, 9), round(r.p.bits, 6), r.p.letters) for r in out.orderBy("i").collect()])
    assert results[0] == results[1]
    for t, (lang, score, bits, n) in zip(ask, results[0]):
        if not t or t == "123":
            assert (lang, score, n) == ("und", 0.0, 0)
            continue
        want = {g: brute_bits(s, t, alphabet) for g, s in (("en", en), ("de", de))}
        assert bits == pytest.approx(min(b for _, b in want.values()), rel=1e-5) and n == want["en"][0]
        assert lang == min(sorted(want), key=lambda g: round(want[g][1], 9))


def test_language_without_letters(spark):
    train = spark.createDataFrame([("the cat", "en"), ("123", "zz"), (None, "yy"), ("the cat", "en")], "text string, lang string")
    family = language_id.trained(train)
    assert family.langs == ["en"]
    got = language_id.predicted(train.drop("lang"), family, out="p").collect()
    assert sorted(r.p.lang for r in got) == ["en", "en", "und", "und"]
