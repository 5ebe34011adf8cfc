"""The pipeline's stages on planted cases, and the registered names."""

import re

import corpus_pipeline
from landgrain.llm import quality, queries


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "secret scan", "packing"]


def test_stages(spark, tmp_path):
    line = lambda i: " ".join(f"word{i}x{k}" for k in range(60)) + "."
    passage = " ".join(f"bench{k}" for k in range(30))
    rows = [
        (1, line(1)), (2, line(1)), (3, line(2) + "\nHome | News | Sport | More"), (4, "too short"), (5, line(3) + " " + passage + "."),
        (6, line(4) + " password: hunter2hunter2 ok."), (7, None), (8, line(2).replace("word2x9 ", "other ")),
    ]
    full = [(i, t, "en", "s", len(t or ""), "extra") for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _quality string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids, now = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        ids.append(sorted(r.doc_id for r in now.select("doc_id").collect()))
    assert ids == [[1, 2, 3, 5, 6, 8], [1, 3, 5, 6], [1, 3, 6], [1, 3, 6]]
    text = {r.doc_id: r.text for r in now.collect()}
    assert "hunter2" not in text[6] and text[3] == line(2) and text[1] == line(1)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 3, 6}


def test_odd_tables(spark, tmp_path):
    """Empty, repeated and null rows go through all stages with the results that the module states."""
    text = " ".join(f"alpha{k}" for k in range(60)) + "."
    other = " ".join(f"beta{k}" for k in range(60)) + "."
    rows = [(5, text), (5, text), (4, text), (None, text), (None, text), (6, other), (6, other + " More."), (7, None), (8, "")]
    spark.createDataFrame([(1, "gamma delta"), (None, "alpha1")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    now, left = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        left.append(sorted((r.doc_id or 0) for r in now.select("doc_id").collect()))
    assert left == [[0, 0, 4, 5, 5, 6, 6], [0, 0, 4, 6], [0, 0, 4, 6], [0, 0, 4, 6]]
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert sorted((r.doc_id or 0) for r in pieces.collect()) == [0, 0, 4, 6]
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0


def test_stages_like_brute_force(spark, tmp_path):
    """Random documents through plain versions of the first four stages' decisions."""
    import random

    r = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(50, 90))) + "." for _ in range(12)]
    passage = " ".join(f"bench{k}" for k in range(15))
    texts = []
    for t in base:
        texts += [t, t.replace(" w1", " x1", 1), t + "\nHome | News | Sport | More", t[:150]]
    texts += [base[0] + " " + passage + ".", base[1] + f" token: {'q' * 12}.", base[2] + "\n" + "menu " * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = {}
    for i, t in enumerate(texts):  # quality: the operator's own scalar rules
        *_, kept, cleaned = quality.clean(t, 0.5, 20)
        if kept:
            now[i] = cleaned
    sets = {i: set(zip(*(t.lower().split()[k:] for k in range(5)))) for i, t in now.items()}
    group = {i: i for i in now}
    changed = True
    while changed:
        changed = False
        for a in now:
            for b in now:
                if group[a] < group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[b], changed = group[a], True
    now = {i: t for i, t in now.items() if group[i] == i}
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    v = tokens(passage)
    windows = {tuple(v[s : s + 13]) for s in range(3)}

    def hit(t):
        w = tokens(t)
        found = {s + k for s in range(len(w) - 12) if tuple(w[s : s + 13]) in windows for k in range(13)}
        return found and 20 * len(found) >= len(w)

    now = {i: re.sub(r"token: q{12}\.", "[REDACTED]", t) for i, t in now.items() if not hit(t)}
    got = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, str(tmp_path))
    assert {x.doc_id: x.text for x in got.collect()} == now
