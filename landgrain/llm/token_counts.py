"""Token counts of whole texts without ids: pieces are counted once per distinct pre-token.

The vocabulary never merges across pre-tokens, so a text has as many tokens as its pre-tokens have pieces, plus one for
each special string in it. Pre-tokens are gathered with the number of documents that hold them; each distinct one is
encoded once; the table of pieces is then joined to the documents' pre-token frequencies. The join has two ways at
every size: the frequent pre-tokens (at most ``HEAD``, so their table can be sent to all tasks) are summed where a text
is read, and the rest, of which none is frequent, meet the table in a shuffle. A pre-token in a third of all documents
is always among the frequent ones, as a text of ordinary length cannot hold more than some hundred such.

Defined results: a null or empty text has no tokens and no bytes; repeated rows, and rows that share a doc_id or have
none, are counted one by one; an empty table gives no rows; other columns are not read. Very long texts are split and
counted whole. Special strings of the vocabulary's file inside texts are one token each, as the library does by default.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrain.llm.common import staged

HEAD = 100_000  # pre-tokens whose pieces every task holds
GATHERED = 300_000  # distinct pre-tokens that a task gathers before it passes them on
STEPS = 8  # classes of frequency to each doubling
LIMIT = 1024

# Letters, numbers and blanks among the characters up to U+024F, and further signs that are none of these.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"
BLANKS = r"\t\n\v\f\r \x85\xa0"
SIGNS = "‐-‧‰-⁞€"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"

PLAIN = re.compile(rf"[\x00-ɏ{SIGNS}]*").fullmatch
#: The vocabulary's split of texts of plain characters.
SPLIT = re.compile(
    rf"{SHORT}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
).findall


def byte_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pretokens:
    """Splits texts as a byte-level vocabulary file does: texts of plain characters by one pattern, others by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        longest = sorted(special, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest))).split if special else lambda text: [text]

    def of(self, text: str | None) -> tuple[list[str], int]:
        """(pre-tokens, special strings)."""
        parts = self.cut(text or "")
        out: list[str] = []
        for part in parts:
            if PLAIN(part):
                out += SPLIT(part)
            else:
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out, len(parts) - 1

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch(pretokens, add_special_tokens=False)]


def distinct_pretokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(piece, n_docs): the distinct pre-tokens of all texts and how many rows hold each; gathered within tasks first."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, seen = Pretokens(path), Counter()
        for batch in batches:
            for x in batch[text]:
                seen.update(set(split.of(x)[0]))
                if len(seen) > GATHERED:
                    yield pd.DataFrame({"piece": list(seen.keys()), "n_docs": list(seen.values())})
                    seen = Counter()
        if seen:
            yield pd.DataFrame({"piece": list(seen.keys()), "n_docs": list(seen.values())})

    found = docs.select(text).mapInPandas(gather, "piece string, n_docs long")
    return found.groupBy("piece").agg(F.sum("n_docs").alias("n_docs"))


def counted_pieces(found: DataFrame, path: str) -> DataFrame:
    """``found`` with n_pieces, encoded once per distinct pre-token."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = Pretokens(path)
        for batch in batches:
            yield batch.assign(n_pieces=split.pieces(batch["piece"].tolist()))

    return found.mapInPandas(count, "piece string, n_docs long, n_pieces long")


def frequent_from(pieces: DataFrame, head: int) -> int:
    """The lowest number of rows from which on at most ``head`` pre-tokens are held by so many; from counts per class."""
    rank = F.floor(F.log2("n_docs") * STEPS).cast("int").alias("rank")
    classes = pieces.groupBy(rank).agg(F.count("*").alias("n"), F.min("n_docs").alias("least"))
    total, least = 0, 1 << 62
    for r in classes.orderBy(F.desc("rank")).collect():  # at most STEPS x 63 rows
        total += r["n"]
        if total > head:
            break
        least = r["least"]
    return least


def counted(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, text: str = "text", head: int = HEAD
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    path = path or byte_path()
    pieces = staged(counted_pieces(distinct_pretokens(docs, path, text), path), "pieces")
    least = frequent_from(pieces, head)
    frequent = {r["piece"]: r["n_pieces"] for r in pieces.where(F.col("n_docs") >= least).select("piece", "n_pieces").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most ``head`` entries

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, known = Pretokens(path), shared.value
        for batch in batches:
            row, piece, n, own = [], [], [], []
            for r, x in zip(batch["row"].tolist(), batch[text]):
                pretokens, total = split.of(x)
                for p, times in Counter(pretokens).items():
                    if p in known:
                        total += times * known[p]
                    else:
                        row.append(r)
                        piece.append(p)
                        n.append(times)
                own.append(total)
            yield batch.drop(columns=text).assign(piece=None, n=own)
            if row:
                yield pd.DataFrame({"row": row, "doc": 0, "known": False, "n_bytes": 0, "piece": piece, "n": n})

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
        F.col("doc_id").isNotNull().alias("known"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        text,
    )
    schema = "row long, doc long, known boolean, n_bytes long, piece string, n long"
    parts = staged(rows.mapInPandas(frequencies, schema), "frequencies")  # the numbers of rows are fixed from here on
    rare = pieces.where(F.col("n_docs") < least).select("piece", "n_pieces")
    rest = parts.where("piece is not null").join(rare, "piece").withColumn("n", F.col("n") * F.col("n_pieces"))
    fields = ["row", "doc", "known", "n_bytes", "n"]
    every = parts.where("piece is null").select(fields).union(rest.select("row", *(F.lit(None) for _ in range(3)), "n"))
    sums = every.groupBy("row").agg(*(F.max(x).alias(x) for x in fields[1:4]), F.sum("n").alias("n_tokens"))
    return sums.select(
        F.when(F.col("known"), F.col("doc")).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
