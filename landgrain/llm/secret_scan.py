"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query: an OR of ANDs that every match satisfies.
The trigrams of all queries are indexed once over all texts, their posting lists are intersected in Spark, and
only the documents left are verified with the rule itself. A rule without mandatory trigrams scans every text.

Defined results: a null text is empty and has no spans; equal rows get equal spans; rows that share a doc_id share
candidates, not spans; a row without doc_id is verified with every rule; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _constants as K
from re import _parser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from landgrain.llm.common import fresh, maybe_broadcast, staged


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters that the group must have
    base: bool = False


#: What follows the first line of a private key: all up to its END line or, where another key begins before that or
#: the text ends, the headers and base64 lines, of which the last may be short. Line ends may be written as \n.
KEY_BODY = r"""(?x:
    (?:[^-]++|-(?!----(?:BEGIN\x20|END\x20[A-Z\x20]{0,30}PRIVATE\x20KEY-----)))*+
    -----END\x20[A-Z\x20]{0,30}PRIVATE\x20KEY-----
    |
    (?:(?:[\s>|"',]|\\[rn])+[A-Z][A-Za-z-]*:\x20(?:[^\r\n\\]|\\(?![rn]))*+)*+
    (?:(?:[\s>|"',]|\\[rn])+[A-Za-z0-9+/]{16,}+={0,2})*+
    (?:(?:[\s>|"',]|\\[rn])+[A-Za-z0-9+/]+={0,2}(?=["']|[\x20\t,]*(?:[\r\n]|\\[rn]|\Z)))?
)"""
#: The base kinds in their fixed order, then public credential formats.
RULES = (
    Rule(
        "assign",
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----" + KEY_BODY),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]*:[^\s:/@]+@"),
)
#: An OR of ANDs of trigrams; the empty AND is true.
Query = frozenset
TRUE: Query = frozenset({frozenset()})
MOST = 64  # strings that are followed at once while a regex is read


def grams(strings: set[str]) -> Query:
    return absorbed({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def absorbed(query: set[frozenset]) -> Query:
    return frozenset(q for q in query if not any(o < q for o in query))


def both(a: Query, b: Query) -> Query:
    out = absorbed({x | y for x in a for y in b})
    return out if len(out) <= MOST else a


def read(nodes) -> tuple[set[str] | None, Query]:
    """(all strings that the nodes match, or None; a query that every match satisfies), in lower case."""
    run: set[str] | None = {""}
    query, exact = TRUE, True
    for op, arg in nodes:
        strings, needs = read_one(op, arg)
        query = both(query, needs)
        if strings is None or len(run) * len(strings) > MOST:
            query, exact, run = both(query, grams(run)), False, {""}
            if strings is not None:
                run = strings
        else:
            run = {a + b for a in run for b in strings}
    return (run, query) if exact else (None, both(query, grams(run)))


def read_one(op, arg) -> tuple[set[str] | None, Query]:
    if op is K.LITERAL:
        return {chr(arg).lower()}, TRUE
    if op is K.IN and all(o is K.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(x).lower() for _, x in arg}, TRUE
    if op is K.SUBPATTERN:
        return read(arg[3])
    if op is K.BRANCH:
        parts = [read(x) for x in arg[1]]
        union = set().union(*(s for s, _ in parts if s is not None))
        if all(s is not None for s, _ in parts) and len(union) <= MOST:
            return union, TRUE
        return None, absorbed(set().union(*(q if s is None else both(q, grams(s)) for s, q in parts)))
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        least, most, body = arg
        strings, needs = read(body)
        if strings is not None and least == most <= 8 and len(strings) == 1:
            return {next(iter(strings)) * least}, needs
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, TRUE
        return None, (needs if strings is None else both(needs, grams(strings))) if least else TRUE
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return {""}, TRUE
    return None, TRUE


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regex; ``TRUE`` if no trigram is mandatory."""
    strings, query = read(_parser.parse(pattern))
    out = query if strings is None else both(query, grams(strings))
    return TRUE if frozenset() in out else out


def build_index(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """(trigram, doc_id) for the ``trigrams`` over whole texts in lower case, split by document; a stage table."""
    codes = [(t, t.encode()) for t in sorted(set(trigrams))]

    @pandas_udf("array<string>")
    def present(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place = np.zeros(1 << 24, np.uint8 if len(codes) < 255 else np.uint16)
        for i, (_, b) in enumerate(codes, 1):
            place[b[0] << 16 | b[1] << 8 | b[2]] = i
        for texts in batches:
            out = []
            for x in texts:
                a = np.frombuffer((x or "").lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
                hit = place[a[:-2] << 16 | a[1:-1] << 8 | a[2:]]
                out.append([codes[i - 1][0] for i in np.flatnonzero(np.bincount(hit, minlength=1)) if i])
            yield pd.Series(out)

    lists = docs.where("doc_id is not null").select("doc_id", present.asNondeterministic()(F.col(text)).alias("trigrams"))
    return staged(lists.select("doc_id", F.explode("trigrams").alias("trigram")), "trigrams")


def candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """(doc_id, rules): the documents whose postings satisfy a rule's query; rules is a bit mask."""
    spark = index.sparkSession
    terms = [
        (r, c, t, len(conj)) for r, q in enumerate(queries) if q != TRUE for c, conj in enumerate(q) for t in conj
    ]
    asked = spark.createDataFrame(terms, "rule int, conj int, trigram string, need int")
    # The rule set is fixed, and so is the size of what is broadcast.
    met = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "rule", "conj", "need")
    met = met.agg(F.count_distinct("trigram").alias("met")).where("met = need")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def verify(text: str, rules: int, compiled: list) -> list[tuple[int, int, int]]:
    """(start, rule, end) of every match, in order of start, then rule."""
    spans = []
    for i, (rule, regex) in enumerate(compiled):
        if rules >> i & 1:
            for m in regex.finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    spans.append((m.start(), i, m.end()))
    return sorted(spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"


def scanned(docs: DataFrame, out: str = "scan", rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``out``: counts, the digest of the base spans, all spans, the redacted text."""
    queries = [trigram_query(r.pattern) for r in rules]
    always = sum(1 << i for i, q in enumerate(queries) if q == TRUE)
    index = build_index(docs, [t for q in queries if q != TRUE for conj in q for t in conj], text)
    found = staged(candidates(index, queries), "secret-candidates")
    key, mask = fresh(docs, "_doc"), fresh(docs, "_rules")
    found = found.select(F.col("doc_id").alias(key), F.col("rules").alias(mask))
    joined = docs.join(maybe_broadcast(found, found.count()), F.col("doc_id") == F.col(key), "left")
    asked = F.when(F.col("doc_id").isNull(), F.lit((1 << len(rules)) - 1)).otherwise(
        F.coalesce(mask, F.lit(0)).bitwiseOR(F.lit(always))
    )

    @pandas_udf(SCHEMA)
    def scan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        compiled = [(r, re.compile(r.pattern)) for r in rules]
        for texts, masks in batches:
            rows = [summary(x or "", verify(x or "", int(m), compiled), rules) for x, m in zip(texts, masks)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return joined.withColumn(out, scan.asNondeterministic()(F.col(text), asked)).drop(key, mask)


def summary(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> tuple:
    said = [(f"{rules[i].kind}:{s}:{e}", i) for s, i, e in spans]
    counts = [sum(i == k for _, i, _ in spans) for k, r in enumerate(rules) if r.base]
    base = ",".join(x for x, i in said if rules[i].base)
    parts, at = [], 0
    for s, _, e in spans:
        if e > at:
            parts += [text[at:s], "[REDACTED]"] if s >= at else []
            at = e
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for x, _ in said), "".join([*parts, text[at:]]))
