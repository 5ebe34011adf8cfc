"""The audit against a plain count over every order, with files in any order and in any number of batches."""

import random
import re
import shutil
from collections import Counter
from itertools import permutations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from landgrain.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask int, `Part` string"


def mask_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t))


def brute(docs, labels):
    least, quality, toxic = {}, {}, {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, q, x in labels:
        quality[i], toxic[i] = max(quality.get(i, 0), q or 0), max(toxic.get(i, 0), x or 0)
    counts = Counter()
    for i, t, s, *_ in docs:
        t = t or ""
        copy = i is not None and i > least[t]
        counts[s or "", mask_of(t) + 16 * copy, quality.get(i, 0) if i is not None else 0, toxic.get(i, 0) if i is not None else 0] += 1
    out = {}
    for part in {k[0] for k in counts}:
        rows = [(m, q, x, n) for (p, m, q, x), n in counts.items() if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            before = 0
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                hit = lambda m: m & bit and not m & before
                v = [sum(r[3] for r in rows if not r[0] & (before | bit)), sum(r[3] for r in rows if hit(r[0])), sum(r[3] for r in rows if r[0] & bit and r[0] & before)]
                v += [sum(r[3] for r in rows if r[0] == bit), sum(r[3] for r in rows if hit(r[0]) and r[1]), sum(r[3] for r in rows if hit(r[0]) and r[2])]
                shapley[f] += v[1]
                out[part, "".join(order), step] = v
                before |= bit
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def made(seed=4):
    r = random.Random(seed)
    word = lambda: r.choice(["one", "Two", "THREE", "four", "x", "#y", "é"]) + str(r.randint(0, 300))
    texts = [" ".join(word() for _ in range(r.choice((0, 3, 150, 260)))) for _ in range(40)] + ["a b " * 150, "", None, " \t\x0b ", "W " * 20_000]
    docs = [(r.randint(0, 500), r.choice(texts), r.choice(["s", "t", "u|v", None])) for _ in range(500)]
    docs += [(i, texts[1], "hot") for i in range(900, 700, -1)] + [(701, texts[1], "tie"), (701, texts[1], "hot"), (None, texts[1], "s"), (None, None, None)]
    docs = [(*d, 5, "clash") for d in docs]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 900, 3)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (6, None, None)]
    return docs, labels


def rows(out):
    fields = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): tuple(r[f] for f in fields) for r in out.collect()}


@pytest.fixture(scope="module")
def planted(spark):
    docs, labels = made()
    return docs, labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), brute(docs, labels)


@pytest.mark.parametrize("falling,files,batches,texts", [(True, 6, 3, 100), (False, 1, 4, 2000)])
def test_like_all_orders(spark, planted, tmp_path, falling, files, batches, texts):
    docs, _, labels, want = planted
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0), reverse=falling)
    df = spark.createDataFrame(order, SCHEMA)
    if files == 1:  # a table that is one file
        df.coalesce(1).write.parquet(str(tmp_path / "one"))
        shutil.copy(next((tmp_path / "one").glob("*.parquet")), tmp_path / "documents.parquet")
    else:
        step = -(-len(order) // files)
        for k in range(files):
            spark.createDataFrame(order[k * step : (k + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    out = filter_audit.audited(spark, str(tmp_path / "documents.parquet"), labels, batches=batches, texts=texts)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert rows(out) == want


def test_goes_on_from_its_last_batch(spark, planted, tmp_path):
    """A folder of a stream that ended early takes up the files it has not seen, and takes back what they overturn."""
    docs, _, labels, want = planted
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0), reverse=True)
    path, at = str(tmp_path / "documents.parquet"), str(tmp_path / "at")
    spark.createDataFrame(order[:300], SCHEMA).coalesce(1).write.parquet(path)
    first = filter_audit.counters(spark, path, labels, batches=1, texts=50, at=at)
    assert first.agg(F.sum("n")).first()[0] == 300
    spark.createDataFrame(order[300:], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    assert rows(filter_audit.report(filter_audit.counters(spark, path, labels, batches=1, texts=5000, at=at))) == want
    taken_back = spark.read.parquet(f"{at}/changes/batch=1").where("change < 0")
    assert taken_back.count() > 0


def test_step_takes_back_and_keeps_ties():
    row = lambda text, part, doc, n: {"bucket": 0, "text": text, "mask": 1, "part": part, "good": 0, "toxic": 0, "doc": doc, "known": True, "n_least": 1, "n": n}
    held, change = filter_audit.stepped(filter_audit.no_holders(), pd.DataFrame([row(b"x", "p", 9, 3)]))
    assert set(map(tuple, change[["part", "mask", "n"]].to_numpy())) == {("p", 1, 1), ("p", 17, 2)}
    held, change = filter_audit.stepped(held, pd.DataFrame([row(b"x", "q", 9, 1)]))
    assert len(held) == 2 and set(map(tuple, change[["part", "mask", "n"]].to_numpy())) == {("q", 1, 1)}
    held, change = filter_audit.stepped(held, pd.DataFrame([row(b"x", "r", 4, 1), row(b"y", "p", 5, 1)]))
    got = set(map(tuple, change[["part", "mask", "n"]].to_numpy()))
    assert got == {("p", 17, 1), ("q", 1, -1), ("q", 17, 1), ("r", 1, 1)} and sorted(held["doc"]) == [4, 5]


def test_empty_table(spark, planted, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert filter_audit.audited(spark, str(tmp_path / "documents.parquet"), planted[2]).count() == 0
