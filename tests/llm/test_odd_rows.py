"""Null ids, repeated rows, empty tables and clashing columns for the operators that place or clean rows."""

import zlib
from collections import Counter

import pytest

from landgrain.llm import packing, quality, sharding

SCHEMA = "doc_id long, text string, number int, _bucket int, quality string"
ROWS = [(None, "same", 1, 2, "a"), (None, "same", 1, 2, "a"), (7, "same", 1, 2, "a"), (7, "same", 1, 2, "a"), (7, "other words", 1, 2, "a"), (8, None, 1, 2, "a"), (9, "", 1, 2, "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_sharding(odd):
    rows = sharding.sharded(odd, 3).collect()
    assert sorted((r.doc_id or -1, r.text_crc32) for r in rows) == sorted((d or -1, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(3)) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    by = {r.doc_id: r.size for r in rows}
    assert by[8] == 16 and by[9] == 16


def test_packing(odd):
    rows = packing.packed(odd, capacity=4).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(d for d, *_ in ROWS)
    places = [(r.sequence_id, r.offset + k) for r in rows for k in range(r.length)]
    assert len(places) == len(set(places)) and all(at < 4 for _, at in places)
    assert all(r.length == 1 for r in rows if r.doc_id in (8, 9))


def test_cleaning(odd):
    rows = quality.judged(odd).select("doc_id", "quality.n_words", "quality.kept", "quality.cleaned").collect()
    assert len(rows) == len(ROWS) and not any(r.kept for r in rows)
    assert {r.doc_id: r.cleaned for r in rows if r.doc_id in (8, 9)} == {8: "", 9: ""}
    assert quality.judged(odd.limit(0)).count() == 0


def test_the_pipelines_filter_judges_once(odd):
    import corpus_pipeline

    plan = corpus_pipeline.quality_rules(odd.sparkSession, odd, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
