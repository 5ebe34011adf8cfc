"""Benchmark decontamination over a distributed positional inverted index.

The training side is tokenised into positional postings (term, document, positions) of the terms that a search
asks for; a search takes the rarest positions of every 13-word test window, shifts their lists by the offset
inside the item, and intersects the shifted lists. What is left are (document, item, shift) triples, along which
the whole item is compared word by word. Postings whose shifts are close without being equal are proximity matches.
All steps are DataFrame operations.

Defined results: a null text has no words and matches nothing; an item without words is ignored; an item of
fewer than 13 words is one window; repeated items count once by item_id; rows that share a doc_id are one
document's texts and share its hits; a null doc_id or item_id is never matched; equal rows give equal rows; other
columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrain.llm.common import maybe_broadcast, staged

WINDOW, SLOP = 13, 3
#: Everything that is not part of a word, after A-Z were lowered.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Pure ASCII takes the faster of two equal ways."""
    text = F.coalesce(text, F.lit(""))
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def split_words(text: Column) -> Column:
    """Words in order; the first and last element may be empty, which shifts positions but hides no match."""
    return F.split(lowered(text), BREAK)


def count_words(words: Column) -> Column:
    n = F.size(words)
    ends = (F.get(words, F.lit(0)) == "").cast("int") + (F.get(words, n - 1) == "").cast("int")
    return F.greatest(n - ends, F.lit(0)).cast("long")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(key, item_id, words, n, width): one row per distinct item text that has words."""
    rows = benchmark.where("item_id is not null").select("item_id", "text").distinct()
    return (
        rows.select(
            F.xxhash64("item_id", "text").alias("key"),
            "item_id",
            F.filter(split_words(F.col("text")), lambda w: w != "").alias("words"),
        )
        .withColumn("n", F.size("words"))
        .where("n > 0")
        .withColumn("width", F.least("n", F.lit(WINDOW)))
    )


def positions(docs: DataFrame) -> DataFrame:
    words = docs.where("doc_id is not null").select("doc_id", split_words(F.col("text")).alias("words"))
    return words.select("doc_id", F.posexplode("words").alias("pos", "term"))


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """How often each of ``terms`` occurs in all training texts."""
    seen = positions(docs).select("term").join(maybe_broadcast(terms, n_terms), "term")
    return seen.groupBy("term").agg(F.count("*").alias("freq"))


def rarest_positions(items: DataFrame, counts: DataFrame, per_window: int = 2) -> DataFrame:
    """(key, at, term): of each window of each item the positions with the rarest terms."""
    words = items.select("key", "n", "width", F.posexplode("words").alias("at", "term"))
    words = words.join(counts, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    first, last = F.greatest(F.col("at") - F.col("width") + 1, F.lit(0)), F.least("at", F.col("n") - F.col("width"))
    windows = words.withColumn("w", F.explode(F.sequence(first, last)))
    rank = F.row_number().over(Window.partitionBy("key", "w").orderBy("freq", "term", "at"))
    return windows.withColumn("rank", rank).where(F.col("rank") <= per_window).select("key", "at", "term").distinct()


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The stored index: (term, doc_id, positions) for each of the distinct ``terms``, as a stage table.

    A posting list is split by document, so a term that is in every document is no single row or task.
    """
    hits = positions(docs).join(maybe_broadcast(terms, n_terms), "term")
    lists = hits.groupBy("term", "doc_id").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    return staged(lists.sortWithinPartitions("term", "doc_id"), "postings")


def shifted(index: DataFrame, anchors: DataFrame, n_anchors: int) -> DataFrame:
    """(doc_id, key, at, shift): every posting of an anchor, moved to where its item would start."""
    found = index.join(maybe_broadcast(anchors, n_anchors), "term")
    starts = F.transform("positions", lambda p: p - F.col("at"))
    return found.select("doc_id", "key", "at", F.explode(starts).alias("shift"))


def candidates(moved: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, key, shift) at which at least two anchors of the item meet, or its only one."""
    need = anchors.groupBy("key").agg(F.least(F.count("*"), F.lit(2)).alias("need"))
    met = moved.groupBy("doc_id", "key", "shift").agg(F.count_distinct("at").alias("met"))
    return met.join(need, "key").where("met >= need").select("doc_id", "key", "shift")


def proximity(moved: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """(doc_id, item_id, key): texts in which two anchors of an item, less than a window apart in it, are displaced
    against each other by 1 to ``slop`` words.

    Every pair of postings is considered: postings are joined by document, item and neighbouring ranges of ``slop``
    shifts, so that a term that is everywhere meets a few postings of its surroundings only.
    """
    at = moved.withColumn("block", F.floor(F.col("shift") / slop)).join(items.select("key", "item_id", "width"), "key")
    left = at.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1)))
    right = at.select("doc_id", "key", "block", F.col("at").alias("at2"), F.col("shift").alias("shift2"))
    met = left.join(right, ["doc_id", "key", "block"])
    met = met.where((F.col("shift2") - F.col("shift")).between(1, slop)).where((F.col("at") != F.col("at2")) & (F.abs(F.col("at") - F.col("at2")) < F.col("width")))
    return met.select("doc_id", "item_id", "key").distinct()


def phrases(docs: DataFrame, items: DataFrame, found: DataFrame, n_found: int) -> DataFrame:
    """(doc_id, item_id, shift, hits): candidates of which at least one whole window is in the text.

    ``hits`` are the positions in the text that some window covers. Only texts with candidates are split again.
    """
    by_doc = found.groupBy("doc_id", "key").agg(F.collect_set("shift").alias("shifts"))
    texts = docs.select("doc_id", "text").join(maybe_broadcast(by_doc, n_found), "doc_id")
    pairs = texts.withColumn("ws", split_words(F.col("text"))).drop("text").join(items, "key")
    pairs = pairs.withColumn("shift", F.explode("shifts")).drop("shifts")
    same = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.coalesce(F.get("ws", F.col("shift") + i) == F.get("words", i), F.lit(False)),
    )
    whole = F.filter(
        F.sequence(F.lit(0), F.col("n") - F.col("width")),
        lambda w: F.forall(F.slice("same", w + 1, F.col("width")), lambda x: x),
    )
    hits = F.array_distinct(
        F.flatten(
            F.transform(
                "whole", lambda w: F.sequence(F.col("shift") + w, F.col("shift") + w + F.col("width") - 1)
            )
        )
    )
    return (
        pairs.withColumn("same", same)
        .drop("ws", "words")
        .withColumn("whole", whole)
        .where(F.size("whole") > 0)
        .select("doc_id", "item_id", "shift", hits.alias("hits"))
    )


def search(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """Exact phrase matches (doc_id, item_id, shift, hits) and proximity matches (doc_id, item_id, key)."""
    items = staged(items_of(benchmark), "items")
    terms = staged(items.select(F.explode("words").alias("term")).distinct(), "terms")
    counts = staged(term_counts(docs, terms, terms.count()), "term-counts")
    anchors = staged(rarest_positions(items, counts), "anchors")
    asked = anchors.select("term").distinct()
    index = build_index(docs, asked, asked.count())
    moved = staged(shifted(index, anchors, anchors.count()), "moved-postings")
    found = staged(candidates(moved, anchors), "candidates")
    exact = staged(phrases(docs, items, found, found.count()), "phrases")
    return exact, proximity(moved, items, slop)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: its words, the words hit, the items found, whether it is contaminated (5 % of its words), and the items
    that are near without being found."""
    exact, near = search(docs, benchmark)
    near = near.join(exact.select("doc_id", "item_id").distinct(), ["doc_id", "item_id"], "left_anti")
    near = near.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_near"))
    words = exact.select("doc_id", F.explode("hits").alias("pos")).distinct()
    hit = words.groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    items = (
        exact.select("doc_id", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    )
    counted = docs.select("doc_id", count_words(split_words(F.col("text"))).alias("n_words"))
    out = counted.join(hit, "doc_id", "left").join(items, "doc_id", "left").join(near, "doc_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
