"""A group of copies that is larger than a shard lies in as few shards as the quotas let it."""

from collections import Counter

from landgrain.llm import sharding


def test_a_third_of_all_rows_in_one_text(spark):
    rows = [(i, "same") if i % 3 == 0 else (i, f"pair {i // 6}") if i % 6 < 3 else (i, f"own {i}") for i in range(2400)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == list(range(2400))
    sizes = Counter(r.shard for r in got)
    assert set(sizes.values()) == {60} and len(sizes) == 40
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(60)) for s in range(40))
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) <= -(-800 // 60) + 1
