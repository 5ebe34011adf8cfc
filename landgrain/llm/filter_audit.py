"""Audit of five filters in every order, as an incremental stream with retraction.

All files of a table run through a stream in available-now micro-batches. Per document, four failures follow from its
text; the fifth, a copy of a text with a smaller doc_id, is known only when the whole table was seen. So the stream
keeps, per text, the smallest doc_id so far and who holds it. A new document counts at once in its part's counters, as
a copy or not; when a smaller id arrives later, the earlier holders' masks are taken back from the counters and counted
again as copies. Each batch adds its changes to the counters as a file of its own, written over if the batch is
repeated, and the stream's checkpoint lets a lost run go on from its last batch. The counters (parts by masks) give all
120 orders.

State is keyed by buckets of texts (by digest), about ``TEXTS`` in each, as Python's cost of a key is some
milliseconds: one call updates all texts of a bucket. Copies in a task are added up before they travel, so that a text
with a third of all rows reaches its bucket as a few rows from each task.

Defined results: a null text is an empty one, a null source an empty part; an empty text has no words and fails A; a
document without doc_id is never a copy and makes no other one a copy; rows with equal text and equal smallest doc_id
are all originals; of repeated labels the larger values count, and a document without a label counts in neither; an
empty table gives no rows. Texts are equal if their SHA-256 are. Other columns are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrain.llm.common import shared_dir

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
COPY = BIT["E"]
BATCHES = 4  # micro-batches that the files are dealt to
TEXTS = 2000  # rows to each key of the state, before copies are added up
WHO = ["part", "good", "toxic"]
ROW = "bucket long, text binary, mask int, part string, good int, toxic int, doc long, known boolean, n_least long, n long"
CHANGE = "part string, mask int, good int, toxic int, change long"
COUNTER = "part string, mask int, n long, good long, toxic long"


def failures(text: Column) -> Column:
    """The bits of A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    each = {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(v, BIT[f]).otherwise(0) for f, v in each.items()), F.lit(0))


def described(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """One row per document: bucket, digest, mask, part, labels, doc."""
    rows = docs.select(
        F.coalesce("text", F.lit("")).alias("t"),
        F.coalesce("source", F.lit("")).cast("string").alias("part"),
        F.col("doc_id").cast("long").alias("doc"),
    ).select("part", "doc", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("text"), failures(F.col("t")).cast("int").alias("mask"))
    # Rows without doc_id match no label; a number from their text keeps them from meeting in one task.
    rows = rows.withColumn("apart", F.when(F.col("doc").isNull(), F.xxhash64("text", "part")).otherwise(0))
    judged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc"), F.lit(0).cast("long").alias("apart"))
    judged = judged.agg(*(F.max((F.col(a) == 1).cast("int")).alias(b) for a, b in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(judged, ["doc", "apart"], "left")
    return rows.select(
        F.pmod(F.xxhash64("text"), F.lit(buckets)).alias("bucket"),
        "text",
        "mask",
        "part",
        *(F.coalesce(x, F.lit(0)).alias(x) for x in WHO[1:]),
        F.coalesce("doc", F.lit(0)).alias("doc"),
        F.col("doc").isNotNull().alias("known"),
        F.lit(1).cast("long").alias("n_least"),
        F.lit(1).cast("long").alias("n"),
    )


def added_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one text, part and labels as one: all of them and those at their smallest doc_id."""
    keys = ["bucket", "text", "mask", *WHO, "known"]
    least = rows.groupby(keys, sort=False)["doc"].transform("min")
    rows = rows.assign(n_least=rows["n_least"].where(rows["doc"] == least, 0))
    return rows.groupby(keys, as_index=False, sort=False).agg(doc=("doc", "min"), n_least=("n_least", "sum"), n=("n", "sum"))


def within_tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    order = [x.split()[0] for x in ROW.split(", ")]
    for batch in batches:
        if len(batch):
            yield added_up(batch)[order]


def stepped(held: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(holders from now on, changes of the counters) of one bucket.

    ``held``: text, mask, part, labels, doc, n of the documents with the smallest doc_id of their texts; ``new``: rows
    of ``described``, added up.
    """
    columns = ["mask", *WHO]
    free, new = new[~new["known"]], new[new["known"]]
    least = pd.concat([held[["text", "doc"]], new[["text", "doc"]]]).groupby("text", sort=False)["doc"].min()
    first = new["doc"].to_numpy() == new["text"].map(least).to_numpy()
    late = held["doc"].to_numpy() > held["text"].map(least).to_numpy()
    originals = new[first].assign(n=new.loc[first, "n_least"])
    copies = new.assign(n=new["n"] - new["n_least"] * first, mask=new["mask"] | COPY)
    lost = held[late]
    again = lost.assign(mask=lost["mask"] | COPY)
    parts = [free, originals, copies, lost.assign(n=-lost["n"]), again]
    change = pd.concat([p[[*columns, "n"]] for p in parts]).groupby(columns, as_index=False, sort=False)["n"].sum()
    keys = ["text", *columns, "doc"]
    stay = pd.concat([held[~late][[*keys, "n"]], originals[[*keys, "n"]]])
    return stay.groupby(keys, as_index=False, sort=False)["n"].sum(), change[change["n"] != 0]


def no_holders() -> pd.DataFrame:
    numbers = {c: pd.Series(dtype="int64") for c in ("mask", "good", "toxic", "doc", "n")}
    return pd.DataFrame({"text": pd.Series(dtype=object), "part": pd.Series(dtype=object), **numbers})


def packed(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def updated(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    before = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else no_holders()
    new = added_up(pd.concat(batches))
    after, change = stepped(before, new)
    state.update((packed(after),))
    yield change.rename(columns={"n": "change"})[["part", "mask", "good", "toxic", "change"]]


def keys_of(spark: SparkSession, at: str, buckets: int) -> int:
    """The number of keys of the stream in ``at``: as it began with, else ``buckets``."""
    try:
        return spark.read.parquet(f"{at}/keys").first()["buckets"]
    except AnalysisException:
        spark.createDataFrame([(buckets,)], "buckets long").write.parquet(f"{at}/keys")
        return buckets


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, texts: int = TEXTS, at: str | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): streams the Parquet table at ``path``; ``at`` is the stream's folder, to go on with a
    run that was lost."""
    table = spark.read.parquet(path)
    at = at or f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    buckets = keys_of(spark, at, 1 + table.count() // texts)  # rows from the footers
    spark.createDataFrame([], CHANGE).write.mode("overwrite").parquet(f"{at}/changes/batch=-1")
    # As a pattern, a path may be a single file too.
    stream = (
        spark.readStream.schema(table.schema)
        .option("maxFilesPerTrigger", -(-max(1, len(table.inputFiles())) // batches))
        .parquet(f"{path[:-1]}[{path[-1]}]")
    )
    rows = described(stream.select("doc_id", "text", "source"), labels, buckets).mapInPandas(within_tasks, ROW)
    changes = rows.groupBy("bucket").applyInPandasWithState(updated, CHANGE, "held binary", "append", "NoTimeout")

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("change").alias("change"))
        sums.write.mode("overwrite").parquet(f"{at}/changes/batch={number}")

    query = changes.writeStream.foreachBatch(add).option("checkpointLocation", f"{at}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema(f"{CHANGE}, batch long").parquet(f"{at}/changes")
    sums = done.groupBy("part", "mask").agg(
        F.sum("change").alias("n"), *(F.sum(F.col("change") * F.col(x)).alias(x) for x in WHO[1:])
    )
    return sums.where("n <> 0")


def orders() -> list[tuple[int, int, str, int]]:
    """(filter's bit, bits before it, order, step) of every order and step: 600 rows."""
    return [
        (BIT[f], sum(BIT[x] for x in order[:k]), "".join(order), k + 1)
        for order in permutations(FILTERS)
        for k, f in enumerate(order)
    ]


def report(sums: DataFrame) -> DataFrame:
    """The audit's rows from the counters of the parts."""
    places = [(BIT[f], sum(BIT[x] for x in s), factorial(k) * factorial(4 - k)) for f in FILTERS for k in range(5) for s in combinations(FILTERS.replace(f, ""), k)]
    place = F.array(*(F.struct(F.lit(a).alias("bit"), F.lit(b).alias("before"), F.lit(c).cast("long").alias("weight")) for a, b, c in places))
    rows = sums.withColumn("p", F.explode(place)).select(*sums.columns, "p.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda when, x: F.coalesce(F.sum(F.when(when, F.col(x))), F.lit(0)).cast("long")
    per = rows.groupBy("part", "bit", "before", "weight").agg(
        total(~fails & ~earlier, "n").alias("kept"),
        total(fails & ~earlier, "n").alias("removed"),
        total(fails & earlier, "n").alias("redundant"),
        total(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum(F.col("removed") * F.col("weight")).over(Window.partitionBy("part", "bit"))
    steps = sums.sparkSession.createDataFrame(orders(), "bit int, before int, filter_order string, step int")
    out = per.withColumn("shapley", shapley).join(F.broadcast(steps), ["bit", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    return report(counters(spark, path, labels, **options))
