"""Packing by minimum bin slack.

Only the number of pieces of each length matters, and there are at most ``capacity`` lengths. For each bin the
longest piece left is fixed, a bitset subset-sum over the lengths that are left finds the fullest feasible
combination, and that combination is removed as often as the counts allow. The plan is a list of combinations and
repetitions, bounded by the number of lengths, not of documents; numbered pieces look their place up in it.

Defined results: a null or empty text is the end token alone; only texts longer than the capacity are cut, and only
their last piece may be shorter; equal rows are packed one by one; an empty table gives no pieces; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from landgrain.llm.common import numbered, staged
from landgrain.llm.tokens import public_path, word_ids

CAPACITY = 2048
END = b"\0\0\0\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_ids(path)
        for batch in batches:
            rows = []
            for doc, x in zip(batch["doc_id"], batch[text]):
                ids = encode.of(x) + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", text).mapInPandas(cut, PIECES)


def fullest(first: int, counts: list[int], capacity: int) -> Counter:
    """The fullest combination with one piece of length ``first``: length -> pieces."""
    room, reach, steps = capacity - first, 1, []
    limit = (1 << room + 1) - 1
    for length in range(min(room, first), 0, -1):
        left = min(counts[length] - (length == first), room // length)
        size = 1
        while left > 0 and not reach >> room & 1:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & limit
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    goal, out = reach.bit_length() - 1, Counter({first: 1})
    for length, take, before in reversed(steps):
        if not before >> goal & 1:
            out[length] += take
            goal -= length * take
    return out


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """(combination, repetitions) until no piece is left; ``lengths``: length -> pieces."""
    counts = [0] * (capacity + 1)
    for length, n in lengths.items():
        counts[length] = n
    out = []
    for first in range(capacity, 0, -1):
        while counts[first]:
            used = fullest(first, counts, capacity)
            times = min(counts[x] // n for x, n in used.items())
            for x, n in used.items():
                counts[x] -= n * times
            out.append((used, times))
    return out


def places(steps: list[tuple[Counter, int]]) -> np.ndarray:
    """Columns: length << 40 | first number, first bin, pieces in a bin, offset of the first; sorted."""
    rows, used, bins = [], Counter(), 0
    for combination, times in steps:
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            rows.append((length << 40 | used[length], bins, n, offset))
            used[length] += n * times
            offset += n * length
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4).T


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset."""
    cut = staged(pieces(docs, path or public_path(), capacity, text), "pieces")
    # At most ``capacity`` rows come to the driver.
    lengths = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = places(plan(lengths, capacity))
    shared = cut.sparkSession.sparkContext.broadcast(table)

    @pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        key, first, n, offset = shared.value
        for length, number in batches:
            length, number = length.to_numpy(), number.to_numpy()
            at = np.searchsorted(key, length << 40 | number, "right") - 1
            past = number - (key[at] & (1 << 40) - 1)
            yield pd.DataFrame(
                {"sequence_id": first[at] + past // n[at], "offset": offset[at] + past % n[at] * length}
            )

    buckets = max(64, sum(lengths.values()) // 2_000_000)
    rows = numbered(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "number", buckets)
    rows = rows.withColumn("place", place("length", "number"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
