"""Token counts against the vocabulary's own library on whole texts."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landgrain.llm import token_counts

BITS = ["the", " the", "it's", "they'LL", "'sx", "don’t", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\x1c", "\x85", "<|endoftext|>", " <|endoftext|>", "<|", "|>", "12", "½", "x²", "٣", "é", "ß", "straße", "ü1", "中文", "한국", "🙂", "é", "​", "　", "«", "“a”", "...", "!?", "_", "A_b", "\x00", "ǅ", "ꙮ", "𝔘𝔫", "Ⅷ", "a" * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.byte_path())


def made(n, seed=11):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 16))) for _ in range(n)]


def test_split_like_library(library):
    split = token_counts.Pretokens(token_counts.byte_path())
    for t in made(6000):
        pretokens, special = split.of(t)
        assert "".join(pretokens) + "<|endoftext|>" * special == t or special
        assert sum(split.pieces(pretokens)) + special == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_every_plain_character_like_library(library):
    split = token_counts.Pretokens(token_counts.byte_path())
    plain = [chr(c) for c in range(1, 0x3000) if token_counts.PLAIN(chr(c))]
    for c in plain:
        for t in (f"a{c}b", f" {c} 1{c}", f"{c}{c}", f"'{c}s  {c}"):
            assert split.of(t)[0] == [t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)], repr(t)


@pytest.mark.parametrize("head", [0, 40, 100_000])
def test_counts_like_library(spark, library, texts, head):
    long = " ".join(f"word{k % 977}" for k in range(60_000)) + "z" * 20_000
    rows = list(enumerate([*texts, *made(400, 3), long])) + [(7, "same id"), (7, "same id"), (None, "no id"), (None, None), (2**60 + 1, "large id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("row", F.lit("clash")).withColumn("piece", F.lit(1)).withColumn("N_Bytes", F.lit(2)).repartition(5)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counted(df, head=head).collect())
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i is None, i or 0, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)


def test_empty_table(spark):
    out = token_counts.counted(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0


def test_frequent_ones_fit_the_bound(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("piece"), (1 + F.lit(1000) / (F.col("id") + 1)).cast("long").alias("n_docs"))
    for head in (0, 1, 10, 300, 5000):
        least = token_counts.frequent_from(rows, head)
        assert rows.where(F.col("n_docs") >= least).count() <= head
