"""Language-model scores, packing, sharding and token output: exact properties and brute force."""

import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landgrain.llm import lm_scoring, packing, sharding, token_output, tokens


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("slot", F.lit(1))


def test_base_score_like_brute_force(spark, docs, texts, monkeypatch):
    for name, v in (("HEAD", 60), ("SYMBOLS", 20), ("PARTIAL", 50), ("BLOCK", 40)):
        monkeypatch.setattr(lm_scoring, name, v)
    c = Counter()
    words = [(t or "").encode().lower().split() + [b""] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    for w, h in zip(words, held):
        c.update([] if h else w)
    n, v = sum(c.values()), len(c)
    for r in lm_scoring.scored(docs).collect():
        w = words[r.doc_id]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, held[r.doc_id])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


class Tiny:
    def __init__(self):
        r = np.random.default_rng(2)
        k = lm_scoring.STATES
        norm = lambda x: x / x.sum(-1, keepdims=True)
        self.emit = norm(r.random((k, 5))).T.copy()
        self.move, self.start = norm(r.random((k, k))), norm(r.random(k))


def test_forward_recursion_is_exact():
    m, k = Tiny(), lm_scoring.STATES
    chains = [np.array(x) for x in ([0, 1, 2], [4], [3, 3], [1, 0, 4])]
    got = lm_scoring.log_likelihood(chains, m, block=2)
    for x, y in zip(chains, got):
        total = sum(
            m.start[p[0]] * np.prod([m.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([m.emit[s, q] for s, q in zip(x, p)])
            for p in product(range(k), repeat=len(x))
        )
        assert y == pytest.approx(math.log10(total), rel=1e-9)
    for block in (1, 2, 4096):
        emits, moves, starts = lm_scoring.expected_counts(chains, m, block)
        assert emits.sum() == pytest.approx(9, rel=1e-5) and moves.sum() == pytest.approx(5, rel=1e-5) and starts.sum() == pytest.approx(4, rel=1e-5)
        assert emits.sum(1) == pytest.approx([2, 2, 1, 2, 2], rel=1e-5)
        # Posteriors by enumeration of all state paths.
        want_emit, want_move, want_start = np.zeros((5, k)), np.zeros((k, k)), np.zeros(k)
        for x in chains:
            paths = list(product(range(k), repeat=len(x)))
            w = np.array([m.start[p[0]] * np.prod([m.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([m.emit[s, q] for s, q in zip(x, p)]) for p in paths])
            for p, v in zip(paths, w / w.sum()):
                want_start[p[0]] += v
                for s, q in zip(x, p):
                    want_emit[s, q] += v
                for a, b in zip(p, p[1:]):
                    want_move[a, b] += v
        assert np.allclose(emits, want_emit, rtol=1e-4) and np.allclose(moves, want_move, rtol=1e-4) and np.allclose(starts, want_start, rtol=1e-4)


def test_every_round_reads_all_training_chains_and_likelihood_rises(spark, monkeypatch):
    r = np.random.default_rng(4)
    texts = [" ".join(("a b " if i % 2 else "c d ") * int(r.integers(1, 9))) + "e" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = []
    for rounds in (0, 1, 4):
        monkeypatch.setattr(lm_scoring, "ROUNDS", rounds)
        monkeypatch.setattr(lm_scoring, "PRIOR", 1.0)
        got.append(sum(x.score for x in lm_scoring.scored(df).collect() if not x.held_out))
    assert got[0] < got[1] < got[2]


def test_scores_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.scored(empty).count() == 0
    rows = lm_scoring.scored(spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert [r.train_tokens for r in rows] == [0, 0, 0] and sorted(r.n_tokens for r in rows) == [1, 3, 3] and all(np.isfinite(r.score) for r in rows)


def test_two_corpora_of_equal_size_in_one_session(spark):
    score = lambda t: [round(r.score, 9) for r in lm_scoring.scored(spark.createDataFrame([(i, t) for i in range(20)], "doc_id long, text string")).collect()]
    assert score("aa bb cc") == score("dd ee ff") == score("aa bb cc")


def test_word_ids_equal_the_library(texts):
    w = tokens.WordIds(tokens.public_path())
    library = Tokenizer.from_file(tokens.public_path())  # with its defaults
    extra = ["don't we'll I'd", "İ. ſ ß É, Ñ.", "<|endoftext|> 1²½", "a<|endoftext|>b <|ENDOFTEXT|>", "x  <|startoftext|><|endoftext|>, <|", "<|endoftext|>", "a.b,c..", "中文 🙂​ x́ ́", "\x1c\x85  z"]
    for t in [*(x for x in texts if x), *extra]:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(w.of(t), "<u4").tolist() == want


def test_packing(spark, docs, texts):
    rows = packing.packed(docs, capacity=64).collect()
    w = tokens.WordIds(tokens.public_path())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by) == len(texts)
    for d, t in enumerate(texts):
        ids = w.of(t) + b"\0\0\0\0"
        parts = sorted(by[d], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids) // 4, 64))
        assert all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in parts)
        assert sum(r.length for r in parts) == len(ids) // 4
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == -(-sum(r.length for r in rows) // 64)
    assert packing.packed(docs.limit(0)).count() == 0


def test_fullest_combination_is_optimal():
    r = np.random.default_rng(0)
    for _ in range(60):
        counts = [0] * 21
        for x in r.integers(1, 21, 6):
            counts[x] += int(r.integers(1, 3))
        first = max(x for x in range(21) if counts[x])
        got = packing.fullest(first, counts, 20)
        left = [x for x in range(1, 21) for _ in range(counts[x] - (x == first))]
        sums = {0}
        for x in left:
            sums |= {s + x for s in sums if s + x <= 20 - first}
        assert sum(k * v for k, v in got.items()) == first + max(sums) and all(v <= counts[k] for k, v in got.items())


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_shards_are_even_and_keep_copies(spark, docs, texts, shards):
    more = docs.union(spark.createDataFrame([(1000 + i, "same text") for i in range(120)], "doc_id long, text string").withColumn("slot", F.lit(1)))
    rows = sharding.sharded(more, shards).collect()
    assert len(rows) == len(texts) + 120 == len({r.doc_id for r in rows})
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == shards
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    by = {r.doc_id: r for r in rows}
    assert all(by[i].size == len((t or "").encode()) + 16 and by[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t in enumerate(texts))
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t, []).append(by[i].shard)
    small = [g for g in groups.values() if 2 <= len(g) <= 5]
    assert sum(len(set(g)) == 1 for g in small) >= 0.8 * len(small)
    assert sharding.sharded(docs.limit(0), shards).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65537])
def test_slots_are_a_permutation(n):
    got = token_output.permuted(np.arange(n), n, 99)
    assert np.array_equal(np.sort(got), np.arange(n))
    assert n < 100 or not np.array_equal(got, token_output.permuted(np.arange(n), n, 100))


def scalar_slot(index, n, key):
    """One index at a time, in whole numbers of Python."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, full = (1 << half) - 1, (1 << 64) - 1
    while True:
        left, right = index >> half, index & mask
        for r in range(token_output.ROUNDS):
            x = (right + key + 0x9E3779B97F4A7C15 * (r + 1)) & full
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
            left, right = right, left ^ ((x ^ (x >> 31)) & mask)
        index = left << half | right
        if index < n:
            return index


@pytest.mark.parametrize("n", [1, 2, 7, 100, 5000])
def test_slots_like_a_scalar_network(n):
    assert token_output.permuted(np.arange(n), n, 77).tolist() == [scalar_slot(i, n, 77) for i in range(n)]


def test_token_shards_round_trip(spark, docs, texts):
    odd = spark.createDataFrame([(None, "no id"), (None, "no id"), (3, texts[3])], "doc_id long, text string")
    table, layout = token_output.written(docs.drop("slot").union(odd), stride=32, shards=5)
    rows = token_output.stored(table, layout, 50).collect()
    assert all(r.ids_crc32 == r.stored_crc32 for r in rows)
    assert sorted({r.slot for r in rows}) == list(range(layout["sequences"]))
    ids = token_output.read(layout, 0, layout["sequences"])
    w = tokens.WordIds(tokens.public_path())
    filled = Counter()
    for r in rows:
        text = "no id" if r.doc_id is None else texts[r.doc_id]
        want = np.frombuffer(w.of(text) + b"\0\0\0\0", "<u4")[r.start : r.start + r.length]
        assert ids[r.slot][r.offset : r.offset + r.length].tolist() == want.tolist()
        filled[r.slot] += r.length
    assert all((ids[s] == token_output.PAD).sum() == 32 - k for s, k in filled.items())
    assert sum(filled.values()) == sum(len(w.of(t)) // 4 + 1 for t in [*texts, "no id", "no id", texts[3]])
    short = sum(k < 32 for k in filled.values())
    assert short <= table.rdd.getNumPartitions() * 4 + 40 and layout["sequences"] < sum(filled.values()) / 32 + short + 1
    assert np.array_equal(token_output.read(layout, 7, 40), ids[7:47])
    empty, none = token_output.written(docs.limit(0))
    assert empty.count() == 0 and none["sequences"] == 0
