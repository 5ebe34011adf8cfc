"""Exact near-duplicate join on word shingles with PartEnum signatures.

Sets are banded by size. In a band whose largest set has r elements, two sets of Jaccard similarity t differ in at
most k = 2r(1 - t) / (1 + t) elements. The hashed feature domain is cut into groups of three partitions, more than
k / 2 groups, so that in at least one group the two sets differ by one element at most. In each group all subsets of
two partitions are enumerated, and each subset's content is one signature: the subset that leaves out the partition
with the difference is the same in both sets. A set near the end of its band also signs for the next one.

Subsets without elements say nothing and are left out, as long as a set has so many groups with elements in two
partitions at least that one of them must be the same. Otherwise (short sets mostly) the partitioning is repeated with
another hash under the name of each empty subset, which similar sets have in common.

Equal sets are one class. Signature groups are joined to one representative each (pre-combined in every task), the
pairs are verified by exact intersection, and linked classes become components. What remains are signatures that
two or more components share; their members are compared across components only, until none is left. As every link
is then inside one component, the links of a class are counted there, over all pairs of each component's classes.

Defined results: a text without words has no shingles and is its own component; with fewer words than a shingle the
whole sequence is one; rows with equal sets (repeated rows among them) are one class; rows that share a doc_id but not
a text are versions of one document, linked by the links of each; a row without doc_id has no component; other columns
pass through. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from landgrain.llm.common import components, fresh, maybe_broadcast, staged

WORDS, PERCENT = 5, 80
BAND = 1.7  # largest by smallest size of a band
FLUSH, CHUNK = 1_000_000, 100  # signatures that a task combines at once, and sets whose signatures it computes at once
CHAINS = 2  # rounds of neighbour pairs before the last step
CHAIN = 50_000  # members of a signature among which neighbours are looked for
PART, PARTS = 2_000_000, 50_000  # signatures that are grouped at once, and tasks
SIG, NODE = 5, 6  # bytes of a signature beside its part, and of a node
DEPTH = 6  # times that a partitioning is repeated under empty subsets
BLOCK, TILE = 1024, 1 << 19  # sets, and shingles, that one side of a comparison holds on average
U = np.uint64

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of x."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


#: Odd multipliers of the words in a shingle, without any linear relation; the words' own hashes are uniform.
ODD = mix(np.arange(1, 65, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a whole text."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(xxh3_64_intdigest, parts), U, n)
    width = min(words, n)
    acc = np.full(n - width + 1, width, U)
    for k in range(width):
        acc += h[k : n - width + 1 + k] * ODD[k]
    acc = np.sort(mix(acc))
    return acc[np.r_[True, acc[1:] != acc[:-1]]]


def bands(most: int) -> list[tuple[int, int]]:
    out = [(1, 1)]
    while out[-1][1] < most:
        low = out[-1][1] + 1
        out.append((low, max(low, int(low * BAND))))
    return out


ENDS = np.array([r for _, r in bands(1 << 40)])


def groups_of(k: int) -> int:
    """Groups of three partitions for k differences: k / 2 + 1, and some more against empty partitions."""
    return k // 2 + 1 + (1 + k // 40 if k > 1 else 0)


def tags_of(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, the most differences in it) for each band that a set of n elements signs for."""
    own = int(np.searchsorted(ENDS, n))
    tags = [own] + ([own + 1] if 100 * n > percent * int(ENDS[own]) else [])
    return [(tag, int(2 * ENDS[tag] * (100 - percent)) // (100 + percent)) for tag in tags]


def most_differences(n: int, k: int, percent: int) -> int:
    """A set of n elements is at most n (1 - t) / t elements away from a similar one."""
    return min(k, n * (100 - percent) // percent)


class Partitioned:
    """Sets in the groups of their bands, many at once: an item is a set in one band, with its most differences k."""

    def __init__(self, items: list[tuple[np.ndarray, int, int]]):
        """``items``: (sorted hashes, k, most differences), k > 0."""
        sizes = np.array([len(h) for h, _, _ in items])
        self.groups = np.array([groups_of(k) for _, k, _ in items])
        self.base = np.r_[0, np.cumsum(self.groups)]
        self.h = np.concatenate([h for h, _, _ in items])
        place = ((self.h >> U(32)) * np.repeat((3 * self.groups).astype(U), sizes)) >> U(32)
        place = place.astype(np.int64) + np.repeat(3 * self.base[:-1], sizes)
        self.first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        self.at = place[self.first]
        full = np.zeros(3 * self.base[-1], bool)
        full[self.at] = True
        self.full = full.reshape(-1, 3)
        # Signatures that a set shares with one that differs in ``most`` elements, by the groups that have elements in two
        # partitions: the first difference in a group spoils two of its three signatures, the second one the last.
        sure = np.add.reduceat((self.full.sum(1) > 1).astype(np.int64), self.base[:-1])
        most = np.array([m for _, _, m in items])
        self.shared = np.where(most <= sure, 3 * sure - 2 * most, 2 * sure - most)

    def signatures(self, labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signatures, their items, names of all subsets): contents of two of the three partitions of each group, where
        there are any. Column j leaves out partition j."""
        sums = np.zeros(self.full.size, U)
        sums[self.at] = np.add.reduceat(mix(self.h), self.first)
        sums = sums.reshape(-1, 3)
        content = sums.sum(1, keepdims=True, dtype=U) - sums
        inside = np.arange(self.full.size) - np.repeat(3 * self.base[:-1], 3 * self.groups)
        names = mix(inside.astype(U) + np.repeat(np.array(labels, U), 3 * self.groups)).reshape(-1, 3)
        some = self.full.sum(1, keepdims=True) > self.full
        item = np.repeat(np.arange(len(self.groups)), self.groups)
        return mix(content[some] + names[some]), np.repeat(item, some.sum(1)), names


def enumerated(h: np.ndarray, k: int, most: int, label: int, depth: int) -> list[np.ndarray]:
    """The signatures of one set, partitioned by another hash at each depth, under the name of an empty subset."""
    h = np.sort(mix(h ^ U(0xA24BAED4963EE407 + depth)))
    part = Partitioned([(h, k, most)])
    found, _, names = part.signatures([label])
    out = [found]
    if part.shared[0] <= 0:
        empty = names[part.full.sum(1, keepdims=True) <= part.full]
        if depth == DEPTH:
            return [*out, mix(empty)]
        for name in empty.tolist():
            out += enumerated(h, k, most, name, depth + 1)
    return out


def signatures_of(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, the place of their set) of many sets of sorted distinct hashes."""
    items, owners, labels, out, of = [], [], [], [], []
    for i, h in enumerate(sets):
        for tag, k in tags_of(len(h), percent) if len(h) else ():
            label = (tag + 1) << 40
            if k:
                items.append((h, k, most_differences(len(h), k, percent)))
                owners.append(i)
                labels.append(label)
            else:
                out.append(mix(mix(h).sum(keepdims=True, dtype=U) + U(label)))
                of.append(np.array([i]))
    if items:
        part = Partitioned(items)
        found, item, names = part.signatures(labels)
        out.append(found)
        of.append(np.array(owners)[item])
        for j in np.flatnonzero(part.shared <= 0):
            h, k, most = items[j]
            own = slice(part.base[j], part.base[j + 1])
            empty = names[own][part.full[own].sum(1, keepdims=True) <= part.full[own]]
            for name in empty.tolist():
                more = np.concatenate(enumerated(h, k, most, name, 1))
                out.append(more)
                of.append(np.full(len(more), owners[j]))
    if not out:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def signatures(h: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The PartEnum signatures of one set."""
    return signatures_of([h], percent)[0]


def needed_of(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """How many signatures each set shares at least with a similar one; 0 for an empty set."""
    out = np.array([1 if len(h) else 0 for h in sets])
    items, owners = [], []
    for i, h in enumerate(sets):
        tags = tags_of(len(h), percent) if len(h) else []
        if all(k for _, k in tags):
            items += [(h, k, most_differences(len(h), k, percent)) for _, k in tags]
            owners += [i] * len(tags)
    if items:
        least = np.full(len(sets), np.iinfo(np.int64).max)
        np.minimum.at(least, owners, Partitioned(items).shared)
        own = np.unique(owners)
        out[own] = np.maximum(least[own], 1)
    return out


def set_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    both = np.array([mix(h).sum(dtype=U), mix(h ^ U(0x9E3779B97F4A7C15)).sum(dtype=U)]) + U(len(h))
    return tuple(int(x) for x in mix(both).view(np.int64))


SET = "doc_id long, n long, k1 long, k2 long, need int"


def described(docs: DataFrame, words: int, percent: int, hashes: bool = False) -> DataFrame:
    """(doc_id, n, k1, k2, need and, on demand, the hashes h) of each row of (doc_id, text)."""
    names = [x.split()[0] for x in SET.split(", ")]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), CHUNK):
                some = batch.iloc[lo : lo + CHUNK]
                sets = [shingles(x, words) for x in some["text"]]
                rows = [
                    (doc, len(h), *(set_key(h) if len(h) else (0, 0)), need, *([h.view(np.int64)] if hashes else []))
                    for doc, h, need in zip(some["doc_id"], sets, needed_of(sets, percent).tolist())
                ]
                yield pd.DataFrame(rows, columns=[*names, "h"][: 5 + hashes]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(describe, SET + ", h array<long>" * hashes)


def node_of(key):
    """The node that stands for a set, from its first key: as many bits as are sent with its signatures."""
    most = (1 << 8 * NODE) - 1
    return key.bitwiseAND(F.lit(most)) if isinstance(key, Column) else key & most


def combined(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sig, node, n): one of each per signature; a later set under a signature leaves as a group of two with the first
    set, with the number of signatures that the two share so."""
    order = np.argsort(sig, kind="stable")
    ordered = sig[order]
    same = np.r_[False, ordered[1:] == ordered[:-1]]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(sig))))
    late = np.flatnonzero(same)
    a, b = node[order[late]], node[order[start[late]]]
    a, b = a[a != b], b[a != b]
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(a)])
    a, b = a[first], b[first]
    own = mix(mix(a.astype(U)) + b.astype(U))
    heads = np.ones(len(sig), bool)
    heads[order[late]] = False
    return (
        np.concatenate([sig[heads], own, own]),
        np.concatenate([node[heads], a, b]),
        np.concatenate([np.ones(heads.sum(), np.int64), count, count]),
    )


def planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32, lowest bytes first: the higher ones are mostly 0 and compress to nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def packed(sig: np.ndarray, node: np.ndarray, n: np.ndarray, parts: int) -> pd.DataFrame:
    """(part, data): signatures dealt to parts by their highest bits, one row of bytes per part: the nodes, each with the number
    of its signatures, then n and the lowest bits of each signature. A node goes once for all its signatures of a part."""
    part = (((sig >> U(32)) * U(parts)) >> U(32)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    part, sig, node, n = part[order], sig[order], node[order], n[order]
    run = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (node[1:] != node[:-1])])
    long = np.diff(np.r_[run, len(sig)])
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends, sizes = np.searchsorted(run, np.r_[first, len(sig)]), np.r_[first, len(sig)]
    sigs = np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIG])
    nodes = np.ascontiguousarray(node[run].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :NODE])
    out = []
    for a, b, lo, hi in zip(ends[:-1], ends[1:], sizes[:-1], sizes[1:]):
        head = np.array([b - a, hi - lo], "<u4").tobytes()
        out.append(head + nodes[a:b].tobytes() + planes(long[a:b]) + planes(n[lo:hi]) + sigs[lo:hi].tobytes())
    return pd.DataFrame({"part": part[first].astype(np.int32), "data": out})


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sig, node, n) of one row of ``packed``; the signatures without what their part says of them."""
    runs, size = (int(x) for x in np.frombuffer(data, "<u4", 2))
    at = 8

    def taken(count: int, width: int) -> np.ndarray:
        nonlocal at
        at += count * width
        return np.frombuffer(data, np.uint8, count * width, at - count * width)

    def filled(x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), 8), np.uint8)
        wide[:, : x.shape[1]] = x
        return wide.view("<u8").reshape(-1)

    number = lambda count: filled(taken(count, 4).reshape(4, -1).T).astype(np.int64)
    node = filled(taken(runs, NODE).reshape(-1, NODE)).astype(np.int64)
    long, n = number(runs), number(size)
    return filled(taken(size, SIG).reshape(-1, SIG)), np.repeat(node, long), n


def signed(docs: DataFrame, text: str, words: int, percent: int, parts: int) -> DataFrame:
    """(part, data): the signatures of all sets with their nodes, combined and packed in each task."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        held, sets, nodes, size = [], [], [], 0

        def enumerate_sets():
            nonlocal size
            sig, owner = signatures_of(sets, percent)
            held.append((sig, np.array(nodes, np.int64)[owner]))
            size += len(sig)
            sets.clear()
            nodes.clear()

        def flushed() -> pd.DataFrame:
            nonlocal size
            out = combined(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            size = 0
            return packed(*out, parts)

        for batch in batches:
            for x in batch[text]:
                h = shingles(x, words)
                if not len(h) or (key := set_key(h)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                sets.append(h)
                nodes.append(node_of(key[0]))
                if len(sets) == CHUNK:
                    enumerate_sets()
                    if size >= FLUSH:
                        yield flushed()
        if sets:
            enumerate_sets()
        if size:
            yield flushed()

    return docs.where("doc_id is not null").select(text).mapInPandas(sign, "part int, data binary")


def paired(sig: np.ndarray, node: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """(a, b, n): what ``first_pairs`` says of whole signature groups."""
    order = np.argsort(sig)
    ordered = sig[order]
    same = ordered[1:] == ordered[:-1]
    order = order[np.r_[False, same] | np.r_[same, False]]  # few signatures occur twice
    sig, node, n = sig[order], node[order], n[order]
    order = np.lexsort((node, sig))
    sig, node, n = sig[order], node[order], n[order]
    start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, np.int64)
    end = np.r_[start[1:], len(sig)][: len(start)]
    keep = np.repeat(node[start] != node[end - 1], end - start)
    return pd.DataFrame({"a": node[keep], "b": np.repeat(node[start], end - start)[keep], "n": n[keep]})


def parts_of(shingles_signed: int) -> int:
    """So many parts, by the counted shingles, that each holds about ``PART`` signatures."""
    return 1 + shingles_signed // PART


def first_pairs(rows: DataFrame, parts: int) -> DataFrame:
    """(a, b, n): each node with the smallest node of its signature groups, which may be itself, and how often.

    ``rows`` are (part, data) of ``signed``; a task groups its parts one after the other. A frequent signature is there once
    for each flush of a signing task only. What of a signature is not its part's has 40 bits, so that of the signatures of
    a part one in half a million may meet another by chance; such pairs are looked at and found to be none.
    """

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            for part, data in zip(batch["part"], batch["data"]):
                if part != now and held:
                    yield paired(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                now = part
                held.append(unpacked(data))
        if held:
            yield paired(*(np.concatenate(x) for x in zip(*held)))

    dealt = rows.repartitionById(min(parts, PARTS), "part").sortWithinPartitions("part")
    return dealt.mapInPandas(pair, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of classes that are similar enough, by exact intersection."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ha", "hb"))
    union = F.col("na") + F.col("nb") - common
    return both.where(100 * common >= percent * union).select("a", "b")


def joined(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT, links_too: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id, n_links (other classes found similar), component_id.
    Where only components are asked for, ``links_too`` is false and the links of a class are not counted (n_links is 0)."""
    slim = docs.select("doc_id", F.col(text).alias("text"))
    meta = staged(described(slim, words, percent), "shingle-sets")
    classes = meta.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n", "need").agg(F.min("doc_id").alias("cls"))
    classes = staged(classes, "shingle-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = parts_of(total)
    first = staged(first_pairs(signed(slim, "text", words, percent, parts), parts), "first-pairs")
    # A set that shares fewer signatures with all others together than with one similar set has none.
    enough = first.groupBy("a").agg(F.sum("n").alias("shared")).join(classes.withColumn("a", node_of(F.col("k1"))), "a")
    enough = staged(enough.where("shared >= need").select("k1", "k2", "n", "need", "cls"), "candidates")
    key_of = enough.select(node_of(F.col("k1")), "cls", "n")
    near = (
        first.where("a <> b")
        .join(key_of.toDF("a", "ca", "na"), "a")
        .join(key_of.toDF("b", "cb", "nb"), "b")
        .select(F.col("ca").alias("a"), F.col("cb").alias("b"), "na", "nb", F.col("n").alias("shared"))
    )
    sets = staged(candidate_sets(slim, meta, enough, words, percent), "candidate-sets")
    sized = near.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    best = sized.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    links = [staged(linked(best, sets, percent), "links")]
    comp = rest(sets, links, percent)
    found = classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left")
    found = found.join(degrees(sets, comp, percent), "cls", "left") if links_too else found.withColumn("links", F.lit(0).cast("long"))
    found = found.select("k1", "k2", "n", "cls", F.coalesce("comp", "cls").alias("comp"), "links")
    rows = meta.join(found, ["k1", "k2", "n"], "left")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        own("cls").alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        own("comp").alias("component_id"),
    )


def candidate_sets(slim: DataFrame, meta: DataFrame, wanted: DataFrame, words: int, percent: int) -> DataFrame:
    """(cls, n, need, h): the shingle hashes of the ``wanted`` classes; only their texts are read again."""
    n_ids = wanted.count()
    ids = maybe_broadcast(wanted.select(F.col("cls").alias("doc_id"), "k1", "k2"), n_ids)
    rows = slim.join(ids.select("doc_id"), "doc_id", "left_semi")
    rows = described(rows, words, percent, hashes=True)
    rows = rows.join(ids, ["doc_id", "k1", "k2"], "left_semi")
    if meta.join(ids, ["doc_id", "k1", "k2"], "left_semi").count() > n_ids:  # repeated rows
        rows = rows.dropDuplicates(["doc_id", "k1", "k2"])
    return rows.select(F.col("doc_id").alias("cls"), "n", "need", "h")


def united(links: list[DataFrame]) -> DataFrame:
    """All links so far, each once, with the smaller class first."""
    pairs = reduce(DataFrame.union, links)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def one_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the one with the smallest doc_id stays.

    Rows without doc_id stay; of rows that share a doc_id the one whose text has the smallest hash stays.
    """
    found = staged(joined(docs, text, links_too=False), "near-rows")
    gone = staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-gone")
    again = staged(
        found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"),
        "near-again",
    )
    kept = docs.join(maybe_broadcast(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
    if again.isEmpty():
        return kept
    again, place = maybe_broadcast(again, again.count()), fresh(docs, "_place")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(text), F.xxhash64(*docs.columns))
    once = kept.join(again, "doc_id", "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def rest(sets: DataFrame, links: list[DataFrame], percent: int) -> DataFrame:
    """(node, comp) of all classes; adds to ``links``.

    Compares, across components only, the members of signatures that several components share, until none is left.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), CHUNK):
                part = batch.iloc[lo : lo + CHUNK]
                sig, owner = signatures_of([np.asarray(h, np.int64).view(U) for h in part["h"]], percent)
                rows = part[["cls", "n", "need", "comp"]].iloc[owner]
                yield rows.assign(sig=sig.view(np.int64))[["sig", "cls", "n", "need", "comp"]]

    owned = lambda rows, c: rows.join(c.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "comp", F.coalesce("comp", "cls")
    )

    def shared_by_many(rows: DataFrame) -> DataFrame:
        """The rows of signatures that several components have, of classes that have enough of such signatures."""
        mixed = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
        kept = staged(rows.drop("size").join(mixed.where("lo <> hi").select("sig", "size"), "sig"), "kept")  # read twice
        enough = kept.groupBy("cls", "need").agg(F.count("*").alias("m")).where("m >= need").select("cls")
        return kept.join(enough, "cls", "left_semi")

    comp = staged(components(united(links)), "components")
    members = owned(sets, comp).mapInPandas(sign, "sig long, cls long, n long, need int, comp long")
    before = None
    for _ in range(4):
        members = staged(shared_by_many(members), "members")
        size = members.count()
        if before is not None and size > 0.9 * before:
            break
        before = size
    members = members.drop("comp")
    for turn in range(CHAINS):
        now = owned(members, comp)
        # Neighbours in a shuffled order of each signature's members: one pair per member, the best one per class. A
        # large signature is split into parts; what links across them is found in the last step.
        part = F.pmod(F.xxhash64("cls", F.lit(turn + 100)), F.expr(f"1 + size div {CHAIN}"))
        order = Window.partitionBy("sig", part).orderBy(F.xxhash64("cls", F.lit(turn)), "cls")
        near = [F.lag(c).over(order).alias(f"{c}_b") for c in ("cls", "n", "comp")]
        chain = now.select("cls", "n", "comp", *near).where("comp <> comp_b")
        chain = chain.where(f"100 * least(n, n_b) >= {percent} * greatest(n, n_b)")
        counted = chain.groupBy(F.col("cls").alias("a"), F.col("cls_b").alias("b")).agg(F.count("*").alias("m"))
        best = counted.groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b"))
        links.append(staged(linked(best, sets, percent), "links"))
        comp = staged(components(united(links)), "components")
    links.append(staged(compared(owned(members, comp), sets, percent), "links"))
    return staged(components(united(links)), "components")


def weight() -> Column:
    """What a set counts for in a tile: its shingles, and enough that no tile has many more than BLOCK sets."""
    return F.greatest("n", F.lit(max(1, TILE // BLOCK)))


def tiles_of(weights: int | Column) -> Column:
    return F.greatest(F.ceil(F.lit(weights) / TILE), F.lit(1)).cast("int")


def dealt(tiles: Column) -> Column:
    return F.pmod(F.xxhash64("cls", F.lit(7)), tiles).cast("int")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each left and each right set (distinct elements)."""
    flat_a, flat_b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(left), len(right)), np.float64)
    if not len(both):
        return out

    def placed(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(element, set) of all common elements in order of element, and where each element starts."""
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        at, owner = at[hit], np.repeat(np.arange(len(sets)), [len(h) for h in sets])[hit]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order], np.searchsorted(at[order], np.arange(len(both) + 1))

    at_a, own_a, start_a = placed(flat_a, left)
    at_b, own_b, start_b = placed(flat_b, right)
    many = np.diff(start_a)[at_b]
    # Products of elements in turn, or of whole matrices over the common elements, which is far quicker a product.
    if many.sum() * 64 > len(both) * out.size:
        for lo in range(0, len(both), 2048):
            hi = min(lo + 2048, len(both))
            a, b = np.zeros((len(left), hi - lo), np.float32), np.zeros((len(right), hi - lo), np.float32)
            a[own_a[start_a[lo] : start_a[hi]], at_a[start_a[lo] : start_a[hi]] - lo] = 1
            b[own_b[start_b[lo] : start_b[hi]], at_b[start_b[lo] : start_b[hi]] - lo] = 1
            out += a @ b.T
        return out
    ends = np.cumsum(many)
    lo = 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TILE, "right")))
        m = many[lo:hi]
        at = np.repeat(start_a[at_b[lo:hi]] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
        pair, n = np.unique(own_a[at] * len(right) + np.repeat(own_b[lo:hi], m), return_counts=True)
        out.reshape(-1)[pair] += n
        lo = hi
    return out


def similar(n: np.ndarray, hs, n_m: np.ndarray, hs_m, percent: int) -> np.ndarray:
    """Which of the left sets are similar to which of the right ones."""
    common = overlaps(list(hs), list(hs_m))
    return 100 * common >= percent * (n[:, None] + n_m[None, :] - common)


def degrees(sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(cls, links): how many other classes each class of a component is similar to.

    All pairs of a component's classes are compared in tiles. Components of one tile are packed together; a larger one
    is dealt into tiles, and each pair of its tiles is one group. A group is as large as two tiles at most, or as two
    texts that are larger. Only counts leave a task.
    """
    # The smallest class of a component is no node of its own.
    owned = comp.select(F.col("node").alias("cls"), "comp").union(comp.select("comp", "comp")).distinct()
    rows = sets.select("cls", "n", "h").join(owned, "cls")
    sizes = rows.groupBy("comp").agg(F.sum(weight()).alias("w"))
    sizes = staged(sizes.select("comp", "w", tiles_of(F.col("w")).alias("tiles")), "component-sizes")
    small = sizes.where("tiles = 1").agg(F.sum("w")).first()[0] or 0
    packs = max(1, -(-2 * small // TILE))
    one = F.col("tiles") == 1
    pack = F.when(one, F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.lit(-1)).alias("pack")
    own = F.when(one, F.lit(0)).otherwise(F.col("comp")).alias("own")
    rows = rows.join(sizes.select("comp", "tiles"), "comp").select("cls", "n", "h", pack, own, "tiles", dealt(F.col("tiles")).alias("tile"))
    pair = lambda k: F.struct(F.least("tile", k).alias("i"), F.greatest("tile", k).alias("j"))
    rows = rows.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), pair)))
    rows = rows.select("pack", "own", "pair.i", "pair.j", "tile", "cls", "n", "h")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        a, b = group[group["tile"] == i], group[group["tile"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"cls": [], "links": []}).astype("int64")
        good = similar(a["n"].to_numpy(), a["h"], b["n"].to_numpy(), b["h"], percent)
        if i == j:
            np.fill_diagonal(good, False)
            return pd.DataFrame({"cls": a["cls"].to_numpy(), "links": good.sum(1)})
        both = np.concatenate([good.sum(1), good.sum(0)])
        return pd.DataFrame({"cls": np.concatenate([a["cls"], b["cls"]]), "links": both})

    counted = rows.groupBy("pack", "own", "i", "j").applyInPandas(count, "cls long, links long")
    return counted.groupBy("cls").agg(F.sum("links").alias("links"))


def blocks_of(queries: DataFrame) -> DataFrame:
    """(cls, block) of all ``queries`` (cls, sig, n, size): by the signature of a class that has most members. The classes of one
    such signature are in one block, or in as many as they have tiles; small ones are packed together."""
    own = queries.groupBy("cls", "n").agg(F.max_by("sig", F.struct("size", "sig")).alias("key"))
    heavy = own.groupBy("key").agg(F.sum(weight()).alias("w"))
    heavy = staged(heavy.select("key", "w", tiles_of(F.col("w")).alias("tiles")), "keys")
    blocks = max(1, -(-(heavy.where("tiles = 1").agg(F.sum("w")).first()[0] or 0) // TILE))
    alone = F.xxhash64("key", dealt(F.col("tiles"))).bitwiseOR(F.lit(-(1 << 63)))  # below 0
    block = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("key"), F.lit(blocks))).otherwise(alone)
    return own.join(heavy.select("key", "tiles"), "key").select("cls", block.alias("block"))


def compared(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all links between members of one signature and different components.

    Of such a pair at least one is not in the component that most of the signature's members have. These classes are
    the query sets; they are dealt into blocks of about a tile, and every class that shares a signature with a block's
    query is sent there. Queries go by the signature of theirs that has most members, so that those with the same
    members lie in one block and these are sent once. For half at least of the signatures that two similar sets share, it
    is the same one of them that is a query; a class that shares fewer than half of what it needs with a block stays
    away. What is sent to a block is dealt into as many parts as its counted size has tiles, and each part is compared
    with the block in a group of its own. Only links leave a task.
    """
    sizes = members.groupBy("sig", "comp").agg(F.count("*").alias("m"))
    home = sizes.groupBy("sig").agg(F.max_by("comp", F.struct("m", "comp")).alias("home"))
    queries = staged(members.join(home, "sig").where("comp <> home").select("cls", "sig", "n", "size").distinct(), "queries")
    asked = staged(blocks_of(queries), "asked")
    held = queries.select("cls", "sig").join(asked, "cls").select("sig", "block").distinct()
    sent = members.join(held, "sig").groupBy("cls", "n", "need", "block").agg(F.count("*").alias("m"))
    sent = staged(sent.where("2 * m >= need").select("cls", "n", "block"), "sent")
    parts = sent.groupBy("block").agg(tiles_of(F.sum(weight())).alias("salts"))
    parts = staged(parts, "parts")  # one row per block
    comps = members.groupBy("cls").agg(F.max("comp").alias("comp"))
    rows = sets.select("cls", "n", "h").join(comps, "cls")
    left = rows.join(asked.join(parts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), "cls")
    right = rows.join(sent.join(parts, "block").select("cls", "block", dealt(F.col("salts")).alias("salt")), "cls")

    def compare(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(m):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        good = similar(q["n"].to_numpy(), q["h"], m["n_m"].to_numpy(), m["h_m"], percent)
        x, y = np.nonzero(good & (q["comp"].to_numpy()[:, None] != m["comp_m"].to_numpy()[None, :]))
        return pd.DataFrame({"a": m["cls_m"].to_numpy()[y], "b": q["cls"].to_numpy()[x]})

    left = left.select("cls", "n", "h", "comp", "block", "salt")
    right = right.select("cls", "n", "h", "comp", "block", "salt").toDF("cls_m", "n_m", "h_m", "comp_m", "block_m", "salt_m")
    groups = left.groupBy("block", "salt").cogroup(right.groupBy("block_m", "salt_m"))
    return groups.applyInPandas(compare, "a long, b long")
