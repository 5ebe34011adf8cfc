"""Training-order materialisation: a keyed permutation gives every sequence its global slot.

The token ids of a task's texts, each with an end token, follow each other and are cut every ``stride`` ids, so that
only a task's last sequence is short. Sequences are indexed without a shuffle (the counts of the tasks before, plus the
place inside the task), and a keyed Feistel network over the next even power of two, with cycle-walking back into range,
turns the index into a slot: a permutation that needs no table and no sort of random numbers. Slots are dealt to shards
by range; each shard is one file of records of equal size, so that record r of a run is at a known place of a known
file, and reading resumes anywhere.

A file holds unsigned 16-bit little-endian ids; a short record is filled up with ``PAD``. It is written under a name of
its own and then renamed; a task that runs again writes the same bytes and leaves a file that is there as it is. The
shards are written in ``WAVES`` jobs over ranges of shards, which bounds the shuffle files on disk at a time. Folders are
opened through ``pyarrow.fs``.

Defined results: a null or empty text is the end token alone; equal rows are placed one by one; a null doc_id is kept
as null; an empty table writes no shard; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from landgrain.llm.common import maybe_broadcast, shared_dir, staged
from landgrain.llm.tokens import public_path, word_ids

STRIDE, PAD, ROUNDS = 512, 0xFFFF, 6
SHARD_BYTES, LEAST_SHARDS, WAVES = 256 << 20, 64, 4
U = np.uint64


def round_value(x: np.ndarray, key: int, number: int) -> np.ndarray:
    x = x + U((key + 0x9E3779B97F4A7C15 * (number + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each index below ``n``: Feistel rounds on two halves, walked until the value is below ``n``."""
    half = U(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (U(1) << half) - U(1)
    out, todo = index.astype(U), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (round_value(right, key, r) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


PIECES = "task int, place long, doc_id long, start long, offset int, length int, ids_crc32 long, ids binary"


def sequences(docs: DataFrame, path: str, stride: int, text: str = "text") -> DataFrame:
    """One row per piece of a text inside a sequence: the task, the sequence's place in it, doc_id, the document's ids
    before the piece, its offset in the sequence, its length, and its ids, compressed, as they are stored and shuffled."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task, place, filled = word_ids(path), TaskContext.get().partitionId(), 0, 0
        if encode.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: its ids do not fit the 16 bits of a stored token")
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for lo in range(0, len(batch), 400):
                some, rows = batch.iloc[lo : lo + 400], []
                for doc, x in zip(some["doc_id"], some[text]):
                    ids, at = np.frombuffer(encode.of(x) + b"\0\0\0\0", "<u4").astype("<u2").tobytes(), 0
                    while at < len(ids):
                        part = ids[at : at + 2 * (stride - filled)]
                        n = len(part) // 2
                        rows.append((task, place, doc, at // 2, filled, n, zlib.crc32(part), pack(part)))
                        at, filled = at + len(part), filled + n
                        if filled == stride:
                            place, filled = place + 1, 0
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])
                yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", text).mapInPandas(cut, PIECES)


def indexed(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with their sequence's gapless index from 0, and the number of sequences. One row per task is shuffled."""
    sizes = rows.groupBy("task").agg((F.max("place") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = staged(sizes.select("task", "n", F.coalesce(before, F.lit(0)).alias("before")), "task-starts")
    total = starts.agg(F.count("*"), F.sum("n")).first()
    joined = rows.join(maybe_broadcast(starts.drop("n"), total[0]), "task")
    return joined.withColumn("index", F.col("before") + F.col("place")), int(total[1] or 0)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def finished(store: fs.FileSystem, tmp: str, final: str) -> None:
    """Gives a whole file its name, unless an earlier run of the same task has written it."""
    if store.get_file_info(final).type == fs.FileType.NotFound:
        store.move(tmp, final)
    else:
        store.delete_file(tmp)


def written(
    docs: DataFrame,
    folder: str | None = None,
    key: int = 0x5EED,
    path: str | None = None,
    stride: int = STRIDE,
    shards: int | None = None,
    text: str = "text",
) -> tuple[DataFrame, dict]:
    """Writes the shards; the pieces' table (doc_id, start, length, ids_crc32, slot, offset, shard, record) and the layout."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/token-shards-{uuid.uuid4().hex}"
    rows, n = indexed(staged(sequences(docs, path or public_path(), stride, text), "sequences"))
    shards = shards or max(LEAST_SHARDS, -(-n * stride * 2 // SHARD_BYTES))
    per_shard = max(1, -(-n // shards))

    @pandas_udf("long")
    def slot_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for index in batches:
            yield pd.Series(permuted(index.to_numpy(), n, key))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        current, out, tmp, at = -1, None, "", 0

        def finish():
            if out is not None:
                out.write(b"\xff\xff" * (-at % stride))
                out.close()
                finished(store, tmp, f"{root}/{current:08d}.bin")

        try:
            for batch in batches:
                for shard, record, offset, length, ids in zip(*(batch[c] for c in ("shard", "record", "offset", "length", "ids"))):
                    if shard != current:
                        finish()
                        current, at, tmp = shard, 0, f"{root}/{shard:08d}-{uuid.uuid4().hex}.part"
                        out = store.open_output_stream(tmp)
                    place = record * stride + offset
                    out.write(b"\xff\xff" * (place - at) + unpack(ids))
                    at = place + length
                yield batch.drop(columns="ids")
            finish()
            out = None
        finally:
            if out is not None:  # the task failed
                out.close()
                store.delete_file(tmp)

    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    slots = rows.select("doc_id", "start", "offset", "length", "ids_crc32", "ids", slot_of("index").alias("slot"))
    dealt = slots.withColumn("shard", F.expr(f"slot div {per_shard}")).withColumn("record", F.expr(f"slot % {per_shard}"))
    schema = "doc_id long, start long, offset int, length int, ids_crc32 long, slot long, shard long, record long"
    names = [x.split()[0] for x in schema.split(", ")]
    used, tables = -(-n // per_shard), []
    for wave in range(WAVES):
        lo, hi = used * wave // WAVES, used * (wave + 1) // WAVES
        if lo < hi or not tables and wave == WAVES - 1:
            part = dealt.where(F.col("shard").between(lo, hi - 1)).repartition("shard").sortWithinPartitions("slot", "offset")
            tables.append(staged(part.select(*names, "ids").mapInPandas(write, schema), "sequence-table"))
    for info in store.get_file_info(fs.FileSelector(root)):  # what lost tasks left
        if info.path.endswith(".part"):
            store.delete_file(info.path)
    layout = {"folder": folder, "stride": stride, "per_shard": per_shard, "sequences": n, "pad": PAD, "key": key}
    return reduce(DataFrame.union, tables), layout


def read(layout: dict, first: int, count: int) -> np.ndarray:
    """``count`` records from slot ``first`` on, as ids with padding: sequential and resumable."""
    store, root = opened(layout["folder"])
    stride, per_shard, parts = layout["stride"], layout["per_shard"], []
    while count > 0 and first < layout["sequences"]:
        shard, record = divmod(first, per_shard)
        n = min(count, per_shard - record, layout["sequences"] - first)
        with store.open_input_file(f"{root}/{shard:08d}.bin") as f:
            f.seek(record * stride * 2)
            parts.append(np.frombuffer(f.read(n * stride * 2), "<u2").reshape(-1, stride))
        first, count = first + n, count - n
    return np.concatenate(parts) if parts else np.empty((0, stride), "<u2")


def stored(table: DataFrame, layout: dict, block: int = 512) -> DataFrame:
    """``table`` with stored_crc32, the checksum of each piece as the files have it. The table lies in order of slots, so
    that the files are read in blocks, one after the other."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, ids = 0, np.empty((0, layout["stride"]), "<u2")
        for batch in batches:
            crc = []
            for slot, offset, length in zip(batch["slot"], batch["offset"], batch["length"]):
                if not first <= slot < first + len(ids):
                    first, ids = slot, read(layout, int(slot), block)
                crc.append(zlib.crc32(ids[slot - first, offset : offset + length].tobytes()))
            yield batch.assign(stored_crc32=crc)

    return table.mapInPandas(check, ", ".join(f"{c} {t}" for c, t in table.dtypes) + ", stored_crc32 long")
