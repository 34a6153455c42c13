"""Sharding by jump consistent hashing (Lamping and Veach 2014): a key's shard follows from key and shard count alone,
without a ring table, and one more shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_offsets, role, store

#: The generator of the published algorithm: its multiplier (fixed value).
JUMP_MULTIPLIER = 2862933555777941757


def mix64(keys: np.ndarray) -> np.ndarray:
    """Spread integer keys over 64 bits, so that consecutive ids do not fall into step (splitmix64 finaliser)."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key among `shards`."""
    state = keys.astype(np.uint64).copy()
    at, ahead = np.zeros(len(state), dtype=np.int64), np.zeros(len(state), dtype=np.int64)
    while (going := ahead < shards).any():
        at[going] = ahead[going]
        state[going] = state[going] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        step = ((state[going] >> np.uint64(33)).astype(np.float64)) + 1.0
        ahead[going] = ((at[going] + 1) * (float(1 << 31) / step)).astype(np.int64)
    return at


def _place(shards: int):
    def run(batches):
        pid, filled = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        for b in batches:
            ids = b.column(0)
            keys = mix64(ids.fill_null(-1).to_numpy(zero_copy_only=False))
            shard = jump_hash(keys, shards)
            order = np.argsort(shard, kind="stable")
            held = np.bincount(shard, minlength=shards)
            index = np.empty(len(shard), dtype=np.int64)
            index[order] = np.arange(len(shard)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(filled, held)
            filled += held
            yield pa.RecordBatch.from_arrays([ids, b.column(1), b.column(2), pa.array(shard.astype(np.int32)), pa.array(jump_hash(keys, shards + 1).astype(np.int32)), pa.array(np.full(len(shard), pid, dtype=np.int32)), pa.array(index)], names=["doc_id", "size", "text_crc32", "shard", "grown_shard", "_pid", "_idx"])

    return run


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): each row's shard under the law `key`.

    size: UTF-8 bytes of the text plus 1, a null text having none. slot numbers a shard's rows from 0 without gaps:
    each writing task numbers its own rows, and the counts of earlier tasks are added, so no task holds a shard.
    grown_shard: the shard among one more. A null doc_id has the key -1. Rows that repeat a doc_id share its shard and
    have slots of their own. An empty table gives an empty result."""
    text = role(docs, text_col, "string")
    slim = docs.select(role(docs, id_col, "long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    placed = store(slim.mapInArrow(_place(shards), "doc_id long, size long, text_crc32 long, shard int, grown_shard int, _pid int, _idx long"), "placed")
    out = placed.join(dense_offsets(placed, "shard"), ["_pid", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_base") + F.col("_idx")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", shard_name: str = "_shard") -> None:
    """Write docs as one folder of files per shard, columns as they came, plus the shard in the folder's name.

    Rows with a null id go to the shard of -1, repeated rows all to theirs; an empty table writes no rows. A column of
    docs with the name shard_name is refused: its values would be lost."""
    if shard_name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {shard_name} already; give another shard_name")
    key = F.coalesce(role(docs, id_col, "long"), F.lit(-1))
    found = assign_shards(docs, shards, id_col, text_col).select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "shard").distinct()
    rows = docs.select(F.struct(*(role(docs, c) for c in docs.columns)).alias("row"), key.alias("id"))
    rows.join(found, "id").select("row.*", F.col("shard").alias(shard_name)).write.partitionBy(shard_name).parquet(path)
