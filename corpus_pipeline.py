"""The corpus pipeline: documents through quality rules, near duplicates, decontamination, secrets and packing.

Defined results, stage by stage (each is judged on what the stage before it wrote; an empty table gives an empty one):

* quality rules: a null or empty text has no words and goes; a text loses its failing lines and goes if it lost more than
  half or keeps too few words; repeated rows are judged alike, and all stay or all go. Very long texts are judged whole.
* near duplicates: of a component one row stays, that of the smallest doc_id; of repeated rows with that doc_id, or of
  different texts under it, the one whose text has the smallest hash. A row without doc_id stays, as it is linked to none.
* decontamination: rows whose doc_id has a contaminated text go; a row without doc_id matches nothing and stays.
* secret scan: every row stays, with each secret replaced by a mark; a null text becomes an empty one.
* packing: one row per piece of every row; repeated rows are packed one by one; a null doc_id stays null.

Further columns pass through the first four stages whatever their names are; ``n_chars``, where a table has it, follows the
text that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrain.llm import decontamination, jaccard_join, packing, quality, secret_scan
from landgrain.llm.common import fresh, maybe_broadcast, staged


def with_text(docs: DataFrame, text) -> list:
    """The columns of ``docs`` with the text replaced and its length renewed."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return [new[c].alias(c) if c in new else F.col(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the line rules keep, with the text that is left after the failing lines went."""
    del spark, sf_dir
    out = fresh(docs, "_quality")
    kept = quality.judged(docs, out=out).where(F.col(f"{out}.kept"))
    return kept.select(*with_text(docs, F.col(f"{out}.cleaned")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest doc_id."""
    del spark, sf_dir
    return jaccard_join.one_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated by the benchmark."""
    report = decontamination.report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = staged(report.where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(maybe_broadcast(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark."""
    del spark, sf_dir
    out = fresh(docs, "_scan")
    return secret_scan.scanned(docs, out=out).select(*with_text(docs, F.col(f"{out}.redacted")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    del spark, sf_dir
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secret scan", secrets_redacted),
    ("packing", packed),
]
#: The stages hash, match and pack texts; no SQL expresses them, so tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
