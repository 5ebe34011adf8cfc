"""The registered queries of the corpus operators: thin projections of each operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrain.llm import (
    chat,
    decontamination,
    filter_audit,
    jaccard_join,
    language_id,
    lm_scoring,
    packing,
    quality,
    ranked_search,
    secret_scan,
    sharding,
    token_counts,
    token_output,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    train = docs.where(~held & F.col("lang").isNotNull()).select("text", "lang")
    out = language_id.predicted(docs.select("doc_id", "text"), language_id.trained(train))
    return out.select(
        "doc_id",
        held.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        "language.score",
        F.col("language.bits").alias("bits_per_letter"),
        "language.rejected",
    )


def op3_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, layout = token_output.written(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_output.stored(rows, layout)


def op4_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') AS g
  FROM (SELECT *, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, s, array_to_string(w[s + 1 : s + k], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s
        FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, dw.k AS k, s FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY 1),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1),
dp AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS p FROM d),
fq AS (SELECT term, count(*) AS freq FROM dp GROUP BY 1),
ip AS (SELECT DISTINCT item_id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
ia AS (SELECT item_id, w, k, unnest(w) AS term, unnest(range(0, len(w))) AS a FROM ip),
iv AS (SELECT *, unnest(range(greatest(a - k + 1, 0), least(a, len(w) - k) + 1)) AS s FROM ia),
an AS (SELECT DISTINCT item_id, w, k, term, a FROM (SELECT iv.*, row_number() OVER (PARTITION BY item_id, w, s ORDER BY coalesce(freq, 0), term, a) AS r
  FROM iv LEFT JOIN fq USING (term)) WHERE r <= 2),
mv AS (SELECT doc_id, item_id, w, k, a, p - a AS sh FROM dp JOIN an USING (term)),
nr AS (
  SELECT DISTINCT x.doc_id AS doc_id, x.item_id AS item_id FROM mv x JOIN mv z ON x.doc_id = z.doc_id AND x.item_id = z.item_id AND x.w = z.w
    AND z.sh - x.sh BETWEEN 1 AND 3 AND x.a <> z.a AND abs(x.a - z.a) < x.k),
nn AS (SELECT doc_id, count(*) AS n_near FROM nr WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = nr.doc_id AND m.item_id = nr.item_id) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN nn USING (doc_id)
"""


def op5_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost"]
    return out.select("doc_id", *(F.col(f"quality.{x}").alias(x) for x in fields))


def op7_event_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long"), "id", role, F.lit(said))
    back = chat.read_back(chat.formatted(chat.logged(rows.union(extra))))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h') AS t,
    replace(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c'), chr(10), '\n') AS r
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(r) + length(t)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return out.select("doc_id", *(F.col(f"scan.{x}").alias(x) for x in fields))


def op10_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.joined(docs).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op11_retraction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM t),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(x, b)),
o AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits
  FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31 AND f1.b | f2.b | f3.b | f4.b | f5.b = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, list_sum(bits[1:k]) - bits[k] AS before FROM (SELECT *, unnest(range(1, 6)) AS k FROM o)),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & bit = 0 AND mask & CAST(before AS INT) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & CAST(before AS INT) = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & CAST(before AS INT) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & CAST(before AS INT) = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & CAST(before AS INT) = 0), 0) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


def op12_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
q AS (SELECT item_id, t, count(*) AS times FROM i GROUP BY 1, 2),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (
  SELECT doc_id, len, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
f AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
v AS (
  SELECT p.doc_id, p.t, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * n) // l))) AS part
  FROM p JOIN f USING (t) CROSS JOIN s),
r AS (
  SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM v JOIN q USING (t) GROUP BY 1, 2 HAVING sum(times * part) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 20
"""


def op13_distinct_pretokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_label_propagation, op2_kneser_ney, op3_feistel_order, op4_positional_index, op5_minimum_bin_slack, op6_line_cleaning, op7_event_chat, op8_hidden_markov, op9_trigram_secrets, op10_partenum_join, op11_retraction_audit, op12_nra_search, op13_distinct_pretokens)}
ORACLES: dict[str, str] = {"op4_positional_index": OP4_SQL, "op7_event_chat": OP7_SQL, "op11_retraction_audit": OP11_SQL, "op12_nra_search": OP12_SQL}
