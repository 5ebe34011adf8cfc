"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is read as its letters in lower case with one blank between words. Counts of 5-letter strings come from all
training texts in one Spark pass; the counts of shorter strings, which Kneser-Ney takes from the number of different
letters before them, follow from the distinct longer strings. All strings that any language knows lie in one sorted
array of hashes per order with a row of log probabilities, and a text's cross-entropy per letter is a sum of lookups.
The language with the lowest one wins. A text whose cross-entropy is beyond what texts of its language show (their mean
plus ``REJECT`` deviations, for the text's length) is marked as rejected. These moments come from all training texts, each
scored by a model of its language that has not seen it: the texts are split in two by their hash, and each half is scored
by the model of the other.

A letter keeps 12 bits of its code point: Latin, Greek, Cyrillic, Hebrew and Arabic letters are all told apart,
others are folded. Every counted string is in the model. The languages do not depend on each other, so the model is made
and broadcast in groups of languages with ``HELD`` strings together, at most; a language that has more is a group of its
own. How many strings a language can have is bounded by its letters, not by its texts.

Defined results: a null text or one without letters is ``und`` with score 0; so is everything if there is no training
text; a language whose training texts have no letters is never predicted; repeated rows get equal results; other columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from landgrain.llm.common import fresh, staged

ORDER, BITS = 5, 12
MASK = (1 << BITS) - 1
HELD = 8_000_000  # strings of one group of languages
DISCOUNT, REJECT, CHUNK = 0.75, 4.0, 1 << 19
NO_LANGUAGE = "und"


def letter_table() -> np.ndarray:
    """Code point -> 12 bits of the small letter, 0 for what is no letter."""
    codes = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            codes[c] = ord(x.lower()[0]) % MASK + 1
    return codes


_TABLE: list[np.ndarray] = []


def letters(text: str | None) -> np.ndarray:
    """The letters' codes with a 0 between words, before the first and after the last; empty without letters."""
    if not _TABLE:
        _TABLE.append(letter_table())
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _TABLE[0][points]
    keep = x > 0
    if not keep.any():
        return x[:0]
    keep[1:] |= x[:-1] > 0
    x = x[keep]
    return np.r_[np.int64(0), x] if x[-1] == 0 else np.r_[np.int64(0), x, np.int64(0)]


def strings(x: np.ndarray, order: int = ORDER) -> np.ndarray:
    """One key per letter or word end: it and the ``order`` - 1 codes before it, started with blanks."""
    y = np.r_[np.zeros(order - 2, np.int64), x]
    key = np.zeros(len(x) - 1, np.int64)
    for k in range(order):
        key = key << BITS | y[k : k + len(x) - 1]
    return key


def string_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(lang, half, key, c) over all training texts; each task sends partial counts. Equal texts are in one half."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        n = 0

        def frame() -> Iterator[pd.DataFrame]:
            for (lang, half), parts in held.items():
                key, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "half": half, "key": key, "c": c})

        for batch in batches:
            for lang, half, x in zip(batch["lang"], batch["half"], batch[text]):
                x = letters(x)
                if len(x):
                    held.setdefault((lang, half), []).append(strings(x))
                    n += len(x)
                    if n > 4 * CHUNK:
                        yield from frame()
                        held, n = {}, 0
        yield from frame()

    part = train.select("lang", half_of(text), text).mapInPandas(count, "lang string, half int, key long, c long")
    return part.groupBy("lang", "half", "key").agg(F.sum("c").alias("c"))


def half_of(text: str) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half")


class Model:
    """Per order from 1: the sorted keys of all languages' strings and their log2 probabilities per language; the
    sorted contexts and their log2 weight of the next lower order."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]], alphabet: int):
        self.langs = langs
        self.keys, self.logs, self.contexts, self.weights = [], [], [], []
        n_langs = len(langs)
        lower_keys = lower = None
        by_order = [tables]
        for order in range(ORDER - 1, 0, -1):
            longer = by_order[-1]
            tail = (1 << BITS * order) - 1
            by_order.append([np.unique(keys & tail, return_counts=True) for keys, _ in longer])
        for order, own in zip(range(1, ORDER + 1), reversed(by_order)):
            keys = np.unique(np.concatenate([k for k, _ in own]))
            contexts = np.unique(keys >> BITS)
            counts = np.zeros((len(keys), n_langs))
            for j, (k, c) in enumerate(own):
                counts[np.searchsorted(keys, k), j] = c
            place = np.searchsorted(contexts, keys >> BITS)
            total, kinds = np.zeros((len(contexts), n_langs)), np.zeros((len(contexts), n_langs))
            np.add.at(total, place, counts)
            np.add.at(kinds, place, counts > 0)
            weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            if order == 1:
                back = np.full((len(keys), n_langs), 1 / alphabet)
            else:
                back = lower[np.searchsorted(lower_keys, keys & (1 << BITS * (order - 1)) - 1)]
            seen = np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[place]
            lower_keys, lower = keys, seen + weight[place] * back
            self.keys.append(keys)
            self.logs.append(np.log2(lower).astype(np.float32))
            self.contexts.append(contexts)
            self.weights.append(np.log2(weight).astype(np.float32))
        self.floor = -np.log2(alphabet)

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """log2 probability of each key's last letter after the others, per language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        rows = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            own = self.keys[order - 1]
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            hit = own[at] == keys
            out[rows[hit]] += self.logs[order - 1][at[hit]]
            rows, keys = rows[~hit], keys[~hit]
            if not len(rows):
                return out
            context, known = keys >> BITS, self.contexts[order - 1]
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            hit = known[at] == context
            out[rows[hit]] += self.weights[order - 1][at[hit]]
            keys = keys & (1 << BITS * (order - 1)) - 1
        out[rows] += self.floor
        return out

    def entropies(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(letters, cross-entropy in bits per letter and language) of each text, several texts at a time."""
        sizes, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        held: list[tuple[int, np.ndarray]] = []
        n = 0

        def add():
            bounds = np.cumsum([0, *(len(k) for _, k in held[:-1])])
            sums = np.add.reduceat(self.log_probs(np.concatenate([k for _, k in held])), bounds, axis=0)
            for (i, _), s in zip(held, sums):
                out[i] += s

        for i, x in enumerate(texts):
            x = letters(x)
            if len(x):
                key = strings(x)
                sizes[i] = len(key)
                for lo in range(0, len(key), CHUNK):
                    held.append((i, key[lo : lo + CHUNK]))
                    n += len(held[-1][1])
                    if n >= CHUNK:
                        add()
                        held, n = [], 0
        if held:
            add()
        return sizes, -out / np.maximum(sizes, 1)[:, None]


class Family:
    """The models of all languages, in groups, and the moments of each language's texts."""

    def __init__(self, models: list[Model]):
        self.models = models
        self.langs = [lang for m in models for lang in m.langs]
        self.mean, self.spread = np.zeros(len(self.langs)), np.full(len(self.langs), np.inf)


def modelled(counts: pa.Table, langs: list[str], alphabet: int) -> Model | None:
    """The model of ``langs`` from (lang, key, c); None without any."""
    if not langs:
        return None
    tables = []
    for lang in langs:
        own = counts.filter(pc.equal(counts["lang"], lang)).sort_by("key")
        tables.append((own["key"].to_numpy(), own["c"].to_numpy()))
    return Model(langs, tables, alphabet)


def grouped(sizes: dict[str, int]) -> list[list[str]]:
    """The languages in order, in groups of at most ``HELD`` strings."""
    out: list[list[str]] = []
    room = 0
    for lang in sorted(sizes):
        if sizes[lang] > room:
            out.append([])
            room = HELD
        out[-1].append(lang)
        room -= sizes[lang]
    return out


def own_bits(rows: DataFrame, halves: list[Model], text: str) -> DataFrame:
    """(lang, n, bits): each text's letters and bits per letter by its language's model of the other half."""
    shared = rows.sparkSession.sparkContext.broadcast(halves)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (lang, half), some in batch.groupby(["lang", "half"]):
                model = shared.value[1 - half]
                if model and lang in model.langs:
                    n, bits = model.entropies(some[text].tolist())
                    at = n > 0
                    yield pd.DataFrame({"lang": lang, "n": n[at], "bits": bits[at, model.langs.index(lang)]})

    return rows.select("lang", half_of(text), text).mapInPandas(own, "lang string, n long, bits double")


def trained(train: DataFrame, text: str = "text") -> Family | None:
    """Counts over all ``train`` rows (lang not null), then a model for each group of languages, made on the driver."""
    counts = staged(string_counts(train, text), "letter-strings")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.count_distinct("key").alias("n")).collect()}
    if not sizes:
        return None
    # As many rows as there are letters.
    alphabet = counts.select(F.col("key").bitwiseAND(F.lit(MASK)).alias("k")).distinct().count() + 1
    models, rows = [], []
    for langs in grouped(sizes):
        own = counts.where(F.col("lang").isin(langs))
        # One group's strings come to the driver: at most HELD, or one language's.
        table = own.toArrow()
        whole = table.group_by(["lang", "key"]).aggregate([("c", "sum")]).rename_columns(["lang", "key", "c"])
        models.append(modelled(whole, langs, alphabet))
        halves = [table.filter(pc.equal(table["half"], h)) for h in (0, 1)]
        halves = [modelled(x, [g for g in langs if g in set(pc.unique(x["lang"]).to_pylist())], alphabet) for x in halves]
        rows += moments_of(own_bits(train.where(F.col("lang").isin(langs)), halves, text)).collect()
    family = Family(models)
    for r in rows:
        i = family.langs.index(r["lang"])
        family.mean[i] = r["first"] / r["n"]
        if r["varied"]:
            family.spread[i] = np.sqrt(max(r["second"] - r["first"] ** 2 / r["n"], 0.0) / r["texts"])
    # One distinct text has no spread of its own: the widest of the other languages stands in, if there is one.
    known = np.isfinite(family.spread)
    if known.any():
        family.spread[~known] = family.spread[known].max()
        family.mean[family.mean == 0] = family.mean[known].max()
    return family


def moments_of(held: DataFrame) -> DataFrame:
    """Per language. A text's mean over n letters strays by 1 / sqrt(n): deviations are kept for one letter."""
    n, bits = F.col("n"), F.col("bits")
    return held.groupBy("lang").agg(
        F.count("*").alias("texts"),
        F.sum(n).alias("n"),
        F.sum(n * bits).alias("first"),
        F.sum(n * bits * bits).alias("second"),
        (F.min("bits") < F.max("bits")).alias("varied"),
    )


SCHEMA = "lang string, score double, bits double, rejected boolean, letters long"


def measure(shared: Broadcast):
    """The function that gives a text's letters and its bits per letter in each language of the broadcast model."""

    @pandas_udf("n long, bits array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, bits = shared.value.entropies(texts)
            yield pd.DataFrame({"n": n, "bits": list(bits)})

    return measured.asNondeterministic()


def entropies(docs: DataFrame, models: list[Model], text: str, letters_out: str, bits_out: str) -> DataFrame:
    """``docs`` with the number of letters and the bits per letter of every language. One model is broadcast at a time;
    after each but the last the rows are staged."""
    for k, model in enumerate(models):
        made = fresh(docs, "_measured")
        docs = docs.withColumn(made, measure(docs.sparkSession.sparkContext.broadcast(model))(F.col(text)))
        more = F.col(f"{made}.bits")
        bits = F.concat(bits_out, more) if k else more
        docs = docs.withColumn(letters_out, F.col(f"{made}.n")).withColumn(bits_out, bits).drop(made)
        if k < len(models) - 1:
            docs = staged(docs, "language-bits")
    return docs


def predicted(docs: DataFrame, family: Family | None, out: str = "language", text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``out``: the language, its share of the likelihood, the bits per letter, the rejection."""
    if family is None:
        none = F.struct(F.lit(NO_LANGUAGE).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"), F.lit(True).alias("rejected"), F.lit(0).cast("long").alias("letters"))
        return docs.withColumn(out, none)
    langs, mean, spread = family.langs, family.mean, family.spread

    def decided(n: np.ndarray, bits: np.ndarray) -> pd.DataFrame:
        best = bits.argmin(1)
        own = bits[np.arange(len(n)), best]
        # The odds against the others, for at most 20 letters, so that long texts keep a scale.
        share = 1 / np.exp2(np.minimum(n, 20)[:, None] * (own[:, None] - bits)).sum(1)
        stray = (own - mean[best]) * np.sqrt(n)
        none = n == 0
        return pd.DataFrame(
            {
                "lang": np.where(none, NO_LANGUAGE, np.array(langs, object)[best]),
                "score": np.where(none, 0.0, share),
                "bits": own,
                "rejected": none | (stray > REJECT * spread[best]),
                "letters": n,
            }
        )

    if len(family.models) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(family.models[0])

        @pandas_udf(SCHEMA)
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield decided(*shared.value.entropies(texts))

        return docs.withColumn(out, predict.asNondeterministic()(F.col(text)))

    @pandas_udf(SCHEMA)
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for n, bits in batches:
            yield decided(n.to_numpy(), np.stack(bits.to_numpy()) if len(n) else np.zeros((0, len(langs))))

    n, bits = fresh(docs, "_letters"), fresh(docs, "_bits")
    rows = entropies(docs, family.models, text, n, bits)
    return rows.withColumn(out, decide(n, bits)).drop(n, bits)
