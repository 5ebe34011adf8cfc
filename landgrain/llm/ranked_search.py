"""Ranked lexical search: the no-random-access algorithm over impact-sorted posting lists.

Documents are dealt in blocks of bounded size, in the tasks that read them. A block holds, for every query term, the
list of its documents by falling impact, each impact an integer from the statistics of the whole table. A search reads
the lists of an item's terms in step, from the top: a document's lower bound is the sum of the impacts read for it; its
upper bound adds, for every list in which it was not met, the next impact that list would give. Reading goes on until
no document outside the answer can reach it, ties included, and every score in it is fixed. The best of a small part of
the blocks give each item a score that it must reach, so that most blocks end after a few reads and hand on few rows;
the last step ranks what the blocks hand on. Query items go in passes of bounded total length.

Defined results: a null or empty text has no term, is not counted and is never returned; repeated documents are ranked
one by one, and so are documents that share a doc_id or have none (after those that have one, where scores tie);
repeated rows of an item count once; an item without a term that occurs gets no row; an empty table on either side
gives no rows. Very long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgrain.llm.common import staged

BEST = 20
PASS_TERMS = 500_000  # terms, repeats included, of the items of one pass
BLOCK_ROWS, BLOCK_POSTINGS = 8192, 2_000_000
FIRST_READ = 64
SEED_SHARE = 16  # one block in so many gives the first thresholds

#: The contract's terms.
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall


def terms(text: str | None) -> list[str]:
    return TERMS((text or "").encode().lower().decode())  # bytes: A-Z alone


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    damped = 75 + 25 * length * n // max(total, 1)
    return weight * (1_000_000_000 * tf // (1000 * tf + 12 * damped))


def forward(docs: DataFrame, vocabulary: dict[str, int], text: str = "text") -> DataFrame:
    """(doc, known, length, codes, tfs): of every row with a term, its length and its query terms' frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by PASS_TERMS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = shared.value
        for batch in batches:
            length, codes, tfs = [], [], []
            for x in batch[text]:
                found = Counter(terms(x))
                length.append(found.total())
                own = found.keys() & code.keys()
                codes.append([code[t] for t in own])
                tfs.append([found[t] for t in own])
            out = batch.drop(columns=text).assign(length=length, codes=codes, tfs=tfs)
            yield out[out["length"] > 0]

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.col("doc_id").isNotNull().alias("known"), text)
    return rows.mapInPandas(count, "doc long, known boolean, length long, codes array<int>, tfs array<int>")


def blocks(rows: DataFrame, weight: np.ndarray, n: int, total: int) -> DataFrame:
    """The index: per block its documents and the lists of its terms by falling impact, one after the other."""
    shared = rows.sparkSession.sparkContext.broadcast(weight)

    def block(parts: list[pd.DataFrame]) -> pd.DataFrame:
        part = pd.concat(parts)
        sizes = part["codes"].map(len).to_numpy()
        code = np.concatenate([*part["codes"], []]).astype(np.int64)
        tf = np.concatenate([*part["tfs"], []]).astype(np.int64)
        place = np.repeat(np.arange(len(part)), sizes)
        value = impacts(shared.value[code], tf, part["length"].to_numpy()[place], n, total)
        order = np.lexsort((place, -value, code))
        code, place, value = code[order], place[order], value[order]
        term, start = np.unique(code, return_index=True)
        doc = part["doc"].to_numpy()
        return pd.DataFrame(
            {
                "seed": [zlib.crc32(doc.tobytes()) % SEED_SHARE == 0],
                "docs": [doc],
                "known": [part["known"].to_numpy()],
                "terms": [term.astype(np.int32)],
                "starts": [np.append(start, len(code)).astype(np.int32)],
                "places": [place.astype(np.int32)],
                "impacts": [value],
            }
        )

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, postings, n_rows = [], 0, 0
        for batch in batches:
            ends = np.cumsum(batch["codes"].map(len).to_numpy())
            at = 0
            while at < len(batch):
                used = ends[at - 1] if at else 0
                stop = max(at + 1, min(int(np.searchsorted(ends, used + BLOCK_POSTINGS - postings, "right")), at + BLOCK_ROWS - n_rows))
                held.append(batch.iloc[at:stop])
                postings, n_rows, at = postings + int(ends[stop - 1] - used), n_rows + stop - at, stop
                if n_rows >= BLOCK_ROWS or at < len(batch):
                    yield block(held)
                    held, postings, n_rows = [], 0, 0
        if held:
            yield block(held)

    kinds = "seed boolean, docs array<long>, known array<boolean>, terms array<int>, starts array<int>, places array<int>, impacts array<long>"
    return rows.mapInPandas(deal, kinds)


def resolved(lists: list[tuple[np.ndarray, np.ndarray]], size: int, best: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of all documents that reach the ``best``-th score and ``least``, their scores fixed.

    ``lists``: per term, places by falling impact and the impacts; ``size``: documents of the block.
    """
    lower, met = np.zeros(size, np.int64), np.zeros((len(lists), size), bool)
    ahead, at, step = np.zeros(len(lists), np.int64), 0, FIRST_READ
    while True:
        for k, (places, values) in enumerate(lists):
            read = places[at : at + step]
            if len(read):
                lower[read] += values[at : at + step]
                met[k, read] = True
                ahead[k] = values[at + step] if at + step < len(values) else 0
        at, step = at + step, 2 * step
        bar = max(least, 1, int(np.partition(lower, -best)[-best]) if size >= best else 0)
        able = np.flatnonzero(lower + ahead.sum() >= bar)
        upper = lower[able] + ahead @ ~met[:, able]
        able, upper = able[upper >= bar], upper[upper >= bar]
        if (upper == lower[able]).all():
            return able, lower[able]


def found(index: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], least: np.ndarray, best: int) -> DataFrame:
    """(item, doc, known, score): of each block and item the documents that may be among the item's best."""
    shared = index.sparkSession.sparkContext.broadcast((items, least))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, bars = shared.value
        for batch in batches:
            for b in batch.itertuples():
                out = []
                for k, (codes, times) in enumerate(wanted):
                    at = np.searchsorted(b.terms, codes)
                    there = at < len(b.terms)
                    there[there] = b.terms[at[there]] == codes[there]
                    lists = [(b.places[b.starts[i] : b.starts[i + 1]], b.impacts[b.starts[i] : b.starts[i + 1]] * q) for i, q in zip(at[there], times[there])]
                    if not lists or sum(values[0] for _, values in lists) < max(1, bars[k]):
                        continue
                    place, score = resolved(lists, len(b.docs), best, int(bars[k]))
                    order = np.lexsort((b.docs[place], ~b.known[place], -score))[:best]
                    place = place[order]
                    out.append(pd.DataFrame({"item": k, "doc": b.docs[place], "known": b.known[place], "score": score[order]}))
                if out:
                    yield pd.concat(out)

    return index.mapInPandas(search, "item int, doc long, known boolean, score long")


def best_of(rows: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.desc("known"), "doc")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def one_pass(docs: DataFrame, items: list[list[str]], best: int, text: str) -> DataFrame:
    """(item, rank, doc, known, score) for the items of one pass, given by their terms."""
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({t for x in items for t in x}))}
    rows = staged(forward(docs, vocabulary, text), "forward")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # a row per query term
        df[r["code"]] = r["count"]
    index = staged(blocks(rows, weights(df, n), n, total), "impacts")
    counts = [Counter(vocabulary[t] for t in x) for x in items]
    wanted = [(np.array(list(c.keys()), np.int32), np.array(list(c.values()), np.int64)) for c in counts]
    least = np.zeros(len(items), np.int64)
    for r in best_of(found(index.where("seed"), wanted, least, best), best).where(F.col("rank") == best).collect():  # a row per item
        least[r["item"]] = r["score"]
    return best_of(found(index, wanted, least, best), best)


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, text: str = "text", pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    kind = dict(items.dtypes)["item_id"]
    # A term has at least one character and another one behind it, so half the length bounds the number of terms.
    size = F.sum(F.ceil(F.char_length(text) / 2) + 1)
    asked = items.select("item_id", text).distinct().where(F.col(text).isNotNull())
    passes = 1 + int(asked.agg(F.coalesce(size, F.lit(0))).first()[0]) // pass_terms
    out = []
    for k in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id", text), F.lit(passes)) == k).collect()  # of about ``pass_terms`` terms
        part = [(r["item_id"], x) for r in part if (x := terms(r[text]))]
        if not part:
            continue
        hits = one_pass(docs, [x for _, x in part], best, text)
        names = spark.createDataFrame([(n, x) for n, (x, _) in enumerate(part)], f"item int, item_id {kind}")
        named = hits.join(F.broadcast(names), "item")
        out.append(named.select("item_id", "rank", F.when(F.col("known"), F.col("doc")).alias("doc_id"), "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)
