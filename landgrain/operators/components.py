"""Connected components: spanning forests of bounded parts, then min-label propagation with pointer jumping on what is left."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 500_000  # edges that a task joins at once
#: Spark's own setting by which a query's shuffle files go when the query has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="landgrain-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir``; only a local session may lack one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: for many rows, which a checkpoint would write as they lie in memory. Its
    shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the smallest node that the edges (a, b) lead to) of all nodes that have edges. Roots are hooked to smaller ones."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = place[: len(a)], place[len(a) :], np.arange(len(names))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return names, names[label]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per part (a, b): stars that link what its edges link, around the smallest node."""
    held, size = [], 0

    def joined() -> pd.DataFrame:
        edges = pd.concat(held, ignore_index=True)
        node, root = roots(edges["a"].to_numpy(), edges["b"].to_numpy())
        return pd.DataFrame({"a": node[node != root], "b": root[node != root]})

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= PART:
            yield joined()
            held, size = [], 0
    if size:
        yield joined()


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp): the smallest id reachable over the undirected ``edges`` (a, b); nodes without edges are their own.

    The edges of a part shrink to a spanning forest, as long as that halves them; edges of one part are done so. What is
    left goes by rounds: each takes the least label among neighbours and then jumps to the label's label, so a chain of
    length L needs about log L rounds. Labels are as many as nodes and are never broadcast.
    """
    kind = dict(edges.dtypes)["a"]
    edges = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    size = edges.count()
    while size:
        parts = 1 + size // PART
        dealt = edges.coalesce(1) if parts == 1 else edges.repartitionByRange(parts, "b")
        edges = checkpointed(dealt.mapInPandas(forests, f"a {kind}, b {kind}"))
        if size < PART:
            stars = edges.select(F.col("a").alias("id"), F.col("b").alias("_c"))
            return nodes.join(stars.hint("merge"), "id", "left").select("id", F.coalesce("_c", "id").alias("comp"))
        before, size = size, edges.count()
        if size > before / 2:
            break
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(nodes.select("id", F.col("id").alias("comp")))
    for _ in range(rounds):
        near = both.join(labels.toDF("b", "_c").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("_c").alias("_c"))
        new = labels.join(near.hint("merge"), "id", "left").select("id", F.least("comp", "_c").alias("new"), "comp")
        jump = new.select(F.col("id").alias("_id"), F.col("new").alias("_to"))
        new = new.join(jump.hint("merge"), F.col("new") == F.col("_id"), "left")
        new = checkpointed(new.select("id", F.least("new", "_to").alias("new"), "comp"))
        moved = new.where("new <> comp").limit(1).count()
        labels = new.select("id", F.col("new").alias("comp"))
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
