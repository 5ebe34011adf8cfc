"""Line-first cleaning.

Every line is judged alone by punctuation, navigation and boilerplate rules; failing lines go, and a document
that lost too much of its text, or kept too few words, is rejected.

Defined results: a null or empty text has no words, fails the base rules and is rejected with an empty cleaned
text; a text without line breaks is one line; equal rows get equal results; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A line that ends so is a sentence; closing quotes and brackets may follow.
ENDS = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")
#: A sentence that ends inside a line: prose whose last words were cut off.
STOP = re.compile(r"[^\W\d_][.!?…。！？] ?\S")
#: Fixed phrases of page furniture, in lower case.
BOILERPLATE = re.compile(
    r"all rights reserved|cookie (?:policy|settings)|privacy policy|terms of (?:use|service)|"
    r"enable javascript|click here|subscribe to our|sign in to|skip to (?:main )?content|lorem ipsum"
)
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = STATS + ", base_failed boolean, lost double, kept boolean, cleaned string"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pair = w[:-2] * len(ids) + w[1:-1]
    if len(ids) > 1_500_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair * len(ids) + w[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def line_fails(line: str) -> bool:
    """One line's verdict: navigation, symbols, shouting, boilerplate or a missing sentence end."""
    words = line.split()
    n = len(words)
    if line.count("|") >= 3 and 4 * line.count("|") >= n:
        return True
    if 10 * sum(line.count(x) for x in SYMBOLS) >= 3 * n:
        return True
    if n >= 4 and (5 * line.count("!") >= 2 * n or line.isupper()):
        return True
    if BOILERPLATE.search(line.lower()):
        return True
    return n >= 4 and not ENDS.search(line) and not STOP.search(line)


def clean(text: str | None, most_lost: float, least_words: int) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    seen: set[str] = set()
    kept, dup, lost, total = [], 0, 0, 0
    for line in text.split("\n"):
        size = len(line.strip(BLANK))
        if not size:
            kept.append(line)
            continue
        total += size
        again = line in seen
        dup += again
        seen.add(line)
        if again or line_fails(line.strip()):
            lost += size
        else:
            kept.append(line)
    cleaned = "\n".join(kept)
    repeats = repeat_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    share = lost / total if total else 0.0
    ok = not failed and share <= most_lost and len(cleaned.split()) >= least_words
    return (
        n,
        len(text) - sum(text.count(x) for x in BLANK),
        sum(text.count(x) for x in SYMBOLS),
        dup,
        repeats,
        failed,
        share,
        ok,
        cleaned,
    )


def judged(
    docs: DataFrame, text: str = "text", out: str = "quality", most_lost: float = 0.5, least_words: int = 20
) -> DataFrame:
    """``docs`` with a struct column ``out``: the base counts, the share of text lost, the verdict and the cleaned text.

    Nothing is shuffled: one pass, each text in one piece.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    @pandas_udf(SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([clean(x, most_lost, least_words) for x in texts], columns=names)

    # Spark evaluates a deterministic function again for each filter on its result; this one is to run once.
    return docs.withColumn(out, judge.asNondeterministic()(F.col(text)))
