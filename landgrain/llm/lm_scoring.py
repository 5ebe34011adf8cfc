"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihood by scaled forward recursion.

The states emit symbols: the ``SYMBOLS`` most frequent words, ``CLASSES`` suffix classes for all other words, and the
end of a text. A word inside a class has the probability (c + 0.5) / (C + 0.5 (V + 1)) with its training count c, the
class's tokens C and words V, so the model covers every string. Word counts are taken over the whole training corpus
in Spark. Texts become chains of symbols once, which are staged; each of the ``ROUNDS`` Baum-Welch rounds reads the chains
of all training texts, sums the expected counts over partitions, and starts its counts anew.

Only the model is broadcast, and its size is bounded by the constants below. Words beyond the ``HEAD`` most frequent
ones get their counts by a join.

Defined results: a null text is empty; an empty text is one end token; a row without doc_id is scored and not learnt
from; repeated rows are learnt and scored one by one; with no training text every count is 0; other columns are not
read. No text is cut: a long chain is worked through in blocks of ``BLOCK`` steps, of which the forward recursion keeps the
first state and is repeated on the way back.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from landgrain.llm.common import staged

STATES, SYMBOLS, CLASSES, HEAD = 8, 16_384, 2_048, 200_000
ROUNDS, BLOCK = 3, 4096
CELLS, PARTIAL = 500_000, 400_000
END = b""
PRIOR = 200.0  # strength of the corpus distribution in each state's emissions


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def token_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, class, c) over all training texts, with the empty word for ends; each task sends partial counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        frame = lambda: pd.DataFrame(
            {"word": list(seen), "class": [class_of(w) for w in seen], "c": list(seen.values())}
        )
        for batch in batches:
            for x in batch[text]:
                seen.update(words_of(x))
                seen[END] += 1
                if len(seen) > PARTIAL:
                    yield frame()
                    seen.clear()
        if seen:
            yield frame()

    part = train.select(text).mapInPandas(count, "word binary, class int, c long")
    return part.groupBy("word", "class").agg(F.sum("c").alias("c"))


class Model:
    """What the tasks need: the head of the vocabulary, the class totals and the chain's parameters."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c"), F.count("*")).first()
        self.tokens, self.types = int(total[0] or 0), int(total[1])
        self.norm = math.log10(self.tokens + 0.5 * (self.types + 1))
        size = F.floor(F.log2("c") * 16).cast("int")
        steps = counts.where(F.col("word") != END).groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect()
        room, least = HEAD, None
        for r in steps:  # some hundred rows at most
            room -= r["count"]
            if room < 0:
                break
            least = r["size"]
        # At most HEAD rows come to the driver.
        head = [] if least is None else counts.where((F.col("word") != END) & (size >= least)).collect()
        head.sort(key=lambda r: (-r["c"], r["word"]))
        self.words = [bytes(r["word"]) for r in head]
        self.key = hashlib.sha256(b" ".join(self.words)).digest()  # no word holds a blank
        self.c = np.array([r["c"] for r in head], float)
        own = self.words[:SYMBOLS]
        self.n_own = len(own)
        sums = counts.where(F.col("word") != END).groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v"))
        tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in sums.collect():
            tokens[r["class"]], types[r["class"]] = r["c"], r["v"]
        for w, c in zip(own, self.c):
            tokens[class_of(w)] -= c
            types[class_of(w)] -= 1
        self.log_class = np.log10(tokens + 0.5 * (types + 1))
        ends = counts.where(F.col("word") == END).first()
        self.end_count = float(ends["c"]) if ends else 0.0
        #: The symbols: own words, classes, the end.
        self.symbol = np.array(
            [i if i < self.n_own else self.n_own + class_of(w) for i, w in enumerate(self.words)], np.int64
        )
        weight = np.r_[self.c[: self.n_own] + 0.5, tokens + 0.5 * (types + 1), self.end_count + 0.5]
        self.corpus = weight / weight.sum()
        noise = np.random.default_rng(8).normal(0, 1, (STATES, len(self.corpus)))
        emit = self.corpus * np.exp(noise)
        emit[:, -1] = self.corpus[-1]
        self.emit = (emit / emit.sum(1, keepdims=True)).T.copy()
        self.move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        self.start = np.full(STATES, 1 / STATES)

    def update(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> None:
        """The M step from the expected counts so far, smoothed towards the corpus."""
        emit = emit.T + PRIOR * self.corpus
        self.emit = (emit / emit.sum(1, keepdims=True)).T.copy()
        self.move = (move + 1) / (move + 1).sum(1, keepdims=True)
        self.start = (start + 1) / (start + 1).sum()


class Lookup(dict):
    """word -> place in the head, or -1."""

    def __missing__(self, word: bytes) -> int:
        return -1


_LOOKUPS: dict[bytes, Lookup] = {}


def lookup(model: Model) -> Lookup:
    """One per Python worker and vocabulary."""
    if model.key not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[model.key] = Lookup((w, i) for i, w in enumerate(model.words))
    return _LOOKUPS[model.key]


def symbols(words: list[bytes], at: np.ndarray, model: Model) -> np.ndarray:
    """The symbols of a text, its end included."""
    out = np.empty(len(words) + 1, "<u2")
    out[-1] = len(model.corpus) - 1
    known = at >= 0
    out[:-1][known] = model.symbol[at[known]]
    out[:-1][~known] = [model.n_own + class_of(words[i]) for i in np.flatnonzero(~known)]
    return out


def grouped(chains: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of chains, longest first, so many at once that they make up CELLS steps or are one chain."""
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    at = 0
    while at < len(order):
        size = max(1, CELLS // max(1, len(chains[order[at]])))
        yield order[at : at + size]
        at += size


def padded(chains: list[np.ndarray], lo: int, hi: int) -> np.ndarray:
    """Steps by chains, so that what belongs to one step lies together."""
    out = np.zeros((hi - lo, len(chains)), np.int64)
    for k, x in enumerate(chains):
        part = x[lo:hi]
        out[: len(part), k] = part
    return out


def active(sizes: np.ndarray, lo: int, hi: int) -> list[int]:
    """For each step how many of the chains, longest first, have it."""
    return np.searchsorted(-sizes, -np.arange(lo, hi), "left").tolist()


def forward(a: np.ndarray | None, emit: np.ndarray, n: list[int], move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scaled forward recursion over one block: (state probabilities, scales); ``a``: the states before the block."""
    one, f = np.ones((emit.shape[2], 1), emit.dtype), emit.dtype
    out, scale = np.zeros(emit.shape, f), np.ones((*emit.shape[:2], 1), f)
    for t, k in enumerate(n):
        own = out[t, :k]
        if a is None:
            own[:] = start
        else:
            np.matmul(a[:k], move, out=own)
        own *= emit[t, :k]
        np.matmul(own, one, out=scale[t, :k])
        own /= scale[t, :k]
        a = own
    return out, scale


def log_likelihood(chains: list[np.ndarray], model: Model, block: int = 512) -> np.ndarray:
    """log10 probability of each symbol chain: forward recursion, rescaled at every step, in blocks of time."""
    out = np.zeros(len(chains))
    for own in grouped(chains):
        group = [chains[i] for i in own]
        sizes = np.array([len(x) for x in group])
        total, a = np.zeros(len(group)), None
        for lo in range(0, sizes[0], block):
            hi = min(lo + block, sizes[0])
            n = active(sizes, lo, hi)
            states, scale = forward(a, model.emit[padded(group[: n[0]], lo, hi)], n, model.move, model.start)
            total[: n[0]] += np.log10(scale[:, :, 0]).sum(0)
            a = states[-1]
        out[own] = total
    return out


def expected_counts(chains: list[np.ndarray], model: Model, block: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: the expected emissions, moves and starts over the chains, in single precision per chain."""
    block, f = block or BLOCK, np.float32
    table, move, start = model.emit.astype(f), model.move.astype(f), model.start.astype(f)
    emits, moves, starts = np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros(len(move))
    for own in grouped(chains):
        group = [chains[i] for i in own]
        sizes = np.array([len(x) for x in group])
        blocks = [(lo, min(lo + block, sizes[0])) for lo in range(0, sizes[0], block)]
        before: list[np.ndarray | None] = [None]
        for lo, hi in blocks[:-1]:
            n = active(sizes, lo, hi)
            before.append(forward(before[-1], table[padded(group[: n[0]], lo, hi)], n, move, start)[0][-1].copy())
        behind, ahead = np.ones((len(group), len(move)), f), None
        for (lo, hi), a in zip(reversed(blocks), reversed(before)):
            n = active(sizes, lo, hi)
            symbol = padded(group[: n[0]], lo, hi)
            emit = table[symbol]
            states, scale = forward(a, emit, n, move, start)
            emit /= scale
            for t in range(hi - lo - 1, -1, -1):
                k = n[t]
                if ahead is not None:
                    gone = len(ahead)
                    moves += states[t, :gone].T @ ahead
                    behind[:gone] = ahead @ move.T
                states[t, :k] *= behind[:k]
                ahead = emit[t, :k] * behind[:k]
            real = (np.arange(lo, hi)[:, None] < sizes[: n[0]]).ravel()
            flat, weights = symbol.ravel()[real], states.reshape(-1, len(move))[real]
            for k in range(len(move)):
                emits[:, k] += np.bincount(flat, weights[:, k], len(emits))
        starts += states[0].sum(0)
    return emits, moves * model.move, starts


STATS = [f"s{k}" for k in range(STATES)]


def chains_of(batch: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in batch["chain"]]


def learnt(chains: DataFrame, model: Model) -> Model:
    """``ROUNDS`` of Baum-Welch over all ``chains`` (chain)."""
    size = len(model.corpus)
    for _ in range(ROUNDS):
        shared = chains.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            model, sums, held, n = shared.value, None, [], 0

            def add():
                nonlocal sums
                new = expected_counts(held, model)
                sums = new if sums is None else tuple(a + b for a, b in zip(sums, new))

            for batch in batches:
                for x in chains_of(batch):
                    held.append(x)
                    n += len(x)
                    if n > 4 * CELLS:
                        add()
                        held, n = [], 0
            if held:
                add()
            if sums is not None:
                rows = np.r_[sums[0], sums[1], sums[2][None]]
                full = np.flatnonzero(rows.sum(1))
                yield pd.DataFrame(rows[full], columns=STATS).assign(place=full)

        emits, moves, starts = np.zeros((size, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
        part = chains.select("chain").mapInPandas(expect, ", ".join(f"{s} double" for s in STATS) + ", place long")
        # One row per symbol and state comes back: bounded by the model's size.
        for r in part.groupBy("place").agg(*(F.sum(s).alias(s) for s in STATS)).collect():
            at, x = r["place"], np.array(r[1:])
            if at < size:
                emits[at] += x
            elif at < size + STATES:
                moves[at - size] += x
            else:
                starts += x
        model.update(emits, moves, starts)
        shared.unpersist()
    return model


SCHEMA = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, tail array<binary>, chain binary"
HEAD_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def head_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Per text everything but the chain's probability and the counts of its words beyond the head, listed in ``tail``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        places, logs = lookup(model), np.log10(model.c + 0.5)
        end = math.log10(model.end_count + 0.5)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part, rows = batch.iloc[lo : lo + 500], []
                for doc, held, x in zip(part["doc_id"], part["held_out"], part[text]):
                    words = words_of(x)
                    n = len(words)
                    at = np.fromiter(map(places.__getitem__, words), np.int64, n)
                    chain = symbols(words, at, model)
                    known = at[at >= 0]
                    classed = chain[:-1][(at < 0) | (at >= model.n_own)].astype(np.int64) - model.n_own
                    base = logs[known].sum() + end - (n + 1) * model.norm
                    inside = logs[known[known >= model.n_own]].sum() - model.log_class[classed].sum()
                    tail = [words[i] for i in np.flatnonzero(at < 0)]
                    rows.append((rid, doc, held, n + 1, len(known) + (model.end_count > 0), base, inside, tail, chain.tobytes()))
                    rid += 1
                yield pd.DataFrame(rows, columns=HEAD_COLUMNS).astype({"doc_id": "Int64"})

    return docs.mapInPandas(score, SCHEMA)


def chain_scores(main: DataFrame, model: Model) -> DataFrame:
    """``main`` with score, the log10 probability of its chain, in the chain's place."""
    shared = main.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            parts = [batch.iloc[lo : lo + 2000].to_frame("chain") for lo in range(0, len(batch), 2000)]
            yield pd.Series(np.concatenate([log_likelihood(chains_of(x), model) for x in parts]) if parts else np.zeros(0))

    return main.withColumn("score", F.col("inside") + score("chain")).drop("chain", "inside")


def scored(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    train = rows.where("not held_out and doc_id is not null")
    counts = staged(token_counts(train), "token-counts")
    model = Model(counts)
    main = staged(head_scores(rows, model), "head-scores")
    model = learnt(main.where("not held_out and doc_id is not null"), model)
    tail = main.select("rid", F.explode("tail").alias("word")).groupBy("rid", "word").agg(F.count("*").alias("n"))
    c = F.coalesce("c", F.lit(0))
    found = tail.join(counts.select("word", "c"), "word", "left").groupBy("rid")
    found = found.agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
    logs = F.coalesce("logs", F.lit(0.0))
    return chain_scores(main.drop("tail"), model).join(found, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
