"""Balanced label propagation: linked documents move to the shard where their neighbours are, under row quotas.

Documents with equal texts are linked. They start in hashed shards; the copies of a text in one shard move together
as a node. In every round each node may ask for the shard with most of its text's copies among those with room, or,
where one shard cannot hold them all, for one of the first few; the requests with the greatest weight are accepted as
far as the room goes, the last of them in part. No list of links is ever formed: a text's
copies are counted by shard. At the end every shard is filled up to its quota with the documents that have no links,
so that row counts differ by at most one and slots have no gaps. A group that is larger than a shard is spread over
as few shards as the quotas let it.

Defined results: a null text has no bytes, a CRC of 0, and is linked with other null texts; rows that are equal are
placed one by one; a null doc_id is placed like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgrain.llm.common import bucket_of, maybe_broadcast, numbered, staged

SHARDS, ROUNDS, LEVELS = 40, 12, 256


def described(docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    raw = F.col(text).cast("binary")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"")).alias("g"),
        bucket_of(shards, "doc_id").alias("start"),
    )


def linked_nodes(base: DataFrame) -> DataFrame:
    """(g, start, lo, n, shard, all): the copies of each text that occurs more than once, by starting shard. A node holds
    the n copies from number lo on, so that it can be split."""
    cells = base.groupBy("g", "start").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("g"))
    found = cells.withColumn("all", total).where("all > 1")
    return found.select("g", "start", F.lit(0).cast("long").alias("lo"), "n", F.col("start").alias("shard"), "all")


def loads(nodes: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in nodes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def requests(nodes: DataFrame, free: DataFrame) -> DataFrame:
    """``nodes``, split where needed, with the shard ``to`` that each asks for and its ``level``, or nulls.

    A text's shards are ranked by their copies. The first of them whose copies and room hold all copies are its
    targets: nodes elsewhere ask for the targets' rooms in turn. A group that fits into one shard has one target.
    """
    cells = nodes.groupBy("g", "shard").agg(F.sum("n").alias("w")).join(F.broadcast(free), "shard")
    before = Window.partitionBy("g").orderBy(F.desc("w"), F.desc(F.xxhash64("g", "shard"))).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "g",
        "shard",
        "w",
        "room",
        F.sum("w").over(Window.partitionBy("g")).alias("all"),
        F.coalesce(F.sum(F.col("w") + F.col("room")).over(before), F.lit(0)).alias("held"),
        F.coalesce(F.sum("room").over(before), F.lit(0)).alias("ahead"),
    )
    target = F.col("held") < F.col("all")
    marked = nodes.join(cells.select("g", "shard", target.alias("target")), ["g", "shard"])
    stay = marked.where("target").select("g", "start", "lo", "n", "shard", F.lit(None).cast("int").alias("to"), F.lit(None).cast("long").alias("level"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("shard", "start", "lo").rowsBetween(Window.unboundedPreceding, 0))
    asks = marked.where("not target").withColumn("end", upto).withColumn("begin", F.col("end") - F.col("n"))
    rooms = cells.where(target & (F.col("room") > 0)).select("g", F.col("shard").alias("to"), "w", "ahead", (F.col("ahead") + F.col("room")).alias("full"))
    low, high = F.greatest("begin", "ahead"), F.least("end", "full")
    level = -F.floor(F.log2("w") * 4) * LEVELS + bucket_of(LEVELS, "g", "start")
    parts = asks.join(rooms, "g").where("begin < full and ahead < end").select(
        "g", "start", (F.col("lo") + low - F.col("begin")).alias("lo"), (high - low).alias("n"), "shard", "to", level.alias("level")
    )
    return stay.unionByName(parts)


def one_round(nodes: DataFrame, room: list[int]) -> DataFrame:
    """``nodes`` after the accepted moves, with a column ``moved``. A request that the room cuts is accepted in part."""
    spark = nodes.sparkSession
    free = spark.createDataFrame([(s, max(r, 0)) for s, r in enumerate(room)], "shard int, room long")  # one row per shard
    asked = staged(requests(nodes, free), "requests")
    # A few thousand rows per shard: weights by quarter powers of two, times LEVELS.
    sums = asked.where("level is not null").groupBy("to", "level").agg(F.sum("n").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy("to").orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    granted = sums.withColumn("upto", upto).join(F.broadcast(free.withColumnRenamed("shard", "to")), "to")
    granted = granted.select("to", "level", "sum", (F.col("room") - F.col("upto") + F.col("sum")).alias("left")).where("left > 0")
    met = asked.join(granted, ["to", "level"], "left")
    fields = ["g", "start", "lo", "n", "shard", "moved"]
    cut = F.coalesce(F.col("left") < F.col("sum"), F.lit(False))
    moved = F.col("left").isNotNull()
    whole = met.where(~cut).withColumn("shard", F.when(moved, F.col("to")).otherwise(F.col("shard"))).withColumn("moved", moved).select(*fields)
    # At most one level of a shard is cut; its nodes are served in turn.
    turn = Window.partitionBy("to", "level").orderBy("g", "start", "lo").rowsBetween(Window.unboundedPreceding, 0)
    took = F.least(F.greatest(F.col("left") - F.sum("n").over(turn) + F.col("n"), F.lit(0)), F.col("n"))
    served = met.where(cut).withColumn("took", took)
    goes = served.select("g", "start", "lo", F.col("took").alias("n"), F.col("to").alias("shard"), F.lit(True).alias("moved"))
    rest = served.select("g", "start", (F.col("lo") + F.col("took")).alias("lo"), (F.col("n") - F.col("took")).alias("n"), "shard", F.lit(False).alias("moved"))
    return whole.unionByName(goes.unionByName(rest).where("n > 0"))


def propagated(nodes: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """``nodes`` after all rounds, under the ``quota`` of each shard."""
    for _ in range(rounds):
        room = [q - n for q, n in zip(quota, loads(nodes, len(quota)))]
        nodes = staged(one_round(nodes, room), "shard-nodes")
        again = nodes.where("moved").limit(1).count()
        nodes = nodes.drop("moved")
        if not again:
            break
    return nodes


def labelled(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """``base`` with the shard of each row's node, or null. Only rows of split nodes are numbered."""
    parts = F.sort_array(F.collect_list(F.struct("lo", F.col("shard").alias("s")))).alias("parts")
    cells = staged(nodes.groupBy("g", "start").agg(parts), "shard-parts")
    placed = base.join(maybe_broadcast(cells, cells.count(), 100_000), ["g", "start"], "left")
    split = F.coalesce(F.size("parts") > 1, F.lit(False))
    single = placed.where(~split).withColumn("shard", F.get("parts", F.lit(0))["s"])
    if not nodes.where("lo > 0").limit(1).count():
        return single.drop("parts")
    many = numbered(staged(placed.where(split), "shard-split"), ["g", "start"], ["doc_id", "text_crc32"], "at", 256)
    many = many.withColumn("shard", F.element_at(F.filter("parts", lambda p: p["lo"] <= F.col("at")), -1)["s"])
    return single.unionByName(many.drop("at")).drop("parts")


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, linked of every row of ``docs``."""
    base = staged(described(docs, shards, text), "shard-rows")
    rows = base.count()
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    nodes = staged(linked_nodes(base), "shard-nodes")
    large = nodes.where(F.col("all") > max(quota)).drop("all")
    small = nodes.where(F.col("all") <= max(quota)).drop("all")
    taken = loads(large, shards)
    if any(taken):
        # Groups larger than a shard first; the others start where these leave room, each group in one shard.
        large = propagated(large, quota, rounds)
        taken = loads(large, shards)
        closed = [s for s in range(shards) if 2 * taken[s] > quota[s]]
        other = [s for s in range(shards) if s not in closed]
        if closed and other:
            seed = F.get(F.array(*(F.lit(s) for s in other)), bucket_of(len(other), "g"))
            small = small.withColumn("shard", F.when(F.col("shard").isin(closed), seed).otherwise(F.col("shard")))
    small = propagated(small, [q - n for q, n in zip(quota, taken)], rounds)
    nodes = staged(large.unionByName(small), "shard-nodes")
    placed = staged(labelled(base, nodes).drop("g", "start"), "shard-labels")
    order = ["doc_id", "text_crc32"]
    linked = staged(numbered(placed.where("shard is not null"), ["shard"], order, "slot", 256), "shard-linked")
    quotas = F.array(*(F.lit(q) for q in quota))
    fits = F.col("slot") < F.get(quotas, F.col("shard"))
    kept = [min(q, n) for q, n in zip(quota, loads(nodes, shards))]
    ends, at = [], 0
    for q, n in zip(quota, kept):
        at += q - n
        ends.append(at)
    loose = placed.where("shard is null").select("doc_id", "size", "text_crc32", F.lit(False).alias("linked"))
    over = linked.where(~fits).select("doc_id", "size", "text_crc32", F.lit(True).alias("linked"))
    loose = numbered(staged(loose.unionByName(over), "shard-loose"), [], order, "u", max(4096, rows // 2_000_000))
    lits = lambda x: F.array(*(F.lit(int(v)) for v in x))
    shard = F.size(F.filter(lits(ends), lambda e: e <= F.col("u")))
    filled = loose.withColumn("shard", shard).withColumn(
        "slot",
        F.get(lits(kept), F.col("shard")) + F.col("u") - F.get(lits([0, *ends[:-1]]), F.col("shard")),
    )
    fields = ["doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "linked"]
    return linked.where(fits).withColumn("linked", F.lit(True)).select(*fields).union(filled.select(*fields))
