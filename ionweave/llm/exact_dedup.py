"""Exact dedup over an extendible-hash index on shared files. DataFrame operations only.

* Insert: each text gets a 64-bit hash; (doc_id, hash, digest) rows are written as the index's log.
* Directory: counts of different hashes per prefix, of which there are at most 2^MAX_DEPTH, decide the splits. An
  overfull bucket splits on its next bit; where its local depth equals the global depth, the directory doubles. A
  bucket at MAX_DEPTH grows instead: nothing is dropped.
* Owners: every text is sent through its slot to the task that owns its bucket, which holds a key range. There texts
  are compared byte by byte, those that collide in the hash are chained, and the bucket's file is written, sorted by
  hash. Only texts whose hash has many rows are combined in the map tasks first, so that a text with a third of all
  rows reaches its owner as one row.
* Lookup: each row of the log finds its chain entry through slot and bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, id_text, role, sized, store

#: Keys that a bucket may hold before it splits, and the deepest prefix; a bucket at that depth grows instead.
BUCKET_CAPACITY, MAX_DEPTH = 4_096, 16
#: Rows of one hash beyond which its texts are combined before they are sent to the owner.
HOT_ROWS = 64


def grow_directory(counts: dict[int, int], capacity: int, depth: int) -> tuple[int, list[int]]:
    """(global depth, directory): the bucket number of each slot. counts: keys per prefix of `depth` bits.

    Starts with one bucket at depth zero and splits overfull buckets until all fit or are at `depth`."""
    global_depth, buckets = 0, [(0, 0)]  # (local depth, prefix)
    held = [0] * (1 << depth)
    for prefix, n in counts.items():
        held[prefix] = n
    level = [held]
    while len(level[-1]) > 1:
        below = level[-1]
        level.append([below[i] + below[i + 1] for i in range(0, len(below), 2)])
    keys = lambda d, p: level[depth - d][p]
    done = []
    while buckets:
        local, prefix = buckets.pop()
        if keys(local, prefix) <= capacity or local == depth:
            done.append((local, prefix))
            continue
        if local == global_depth:
            global_depth += 1  # the directory doubles
        buckets += [(local + 1, 2 * prefix), (local + 1, 2 * prefix + 1)]
    directory = [0] * (1 << global_depth)
    for number, (local, prefix) in enumerate(sorted(done, key=lambda b: b[1] << (global_depth - b[0]))):
        span = 1 << (global_depth - local)
        directory[prefix * span : (prefix + 1) * span] = [number] * span
    return global_depth, directory


def _slot(depth: int):
    return F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")


def build_index(texts: DataFrame, capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH, hash_bits: int = 64, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(log, index) of (doc_id, text) rows. log: doc_id, hash, digest, bucket. index: bucket, hash, chain, digest, keep_id, group_size.

    hash_bits under 64 is for tests: it makes different texts collide."""
    spark = texts.sparkSession
    low = texts.select("doc_id", ascii_lower(F.col("text")).alias("t"))
    hashed = low.withColumn("hash", F.shiftleft(F.xxhash64("t"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("t"))
    log = store(hashed.select("doc_id", "hash", F.sha2(F.col("t").cast("binary"), 256).alias("digest")), "index-log")
    rows = store(log.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "index-keys")
    prefix = F.shiftrightunsigned("hash", 64 - max_depth)
    counts = {r[0]: r[1] for r in rows.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2^max_depth rows
    depth, directory = grow_directory(counts, capacity, max_depth)
    slots = F.broadcast(spark.createDataFrame([(s, b) for s, b in enumerate(directory)], "slot long, bucket int"))  # at most 2^max_depth rows

    many = sized(rows.where(F.col("n") > hot_rows).select("hash"))
    combined = hashed.join(many, "hash", "left_semi").groupBy("hash", "t").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    single = hashed.join(many, "hash", "left_anti").select("hash", "t", F.col("doc_id").alias("top"), F.lit(1).cast("long").alias("n"))
    sent = single.union(combined).withColumn("slot", _slot(depth)).join(slots, "slot").drop("slot")
    owners = max(1, min(len(set(directory)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    equal = sent.repartition(owners, "bucket").groupBy("bucket", "hash", "t").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))  # compared by the owner: no further shuffle
    slim = equal.select("bucket", "hash", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), "keep_id", "group_size")
    chained = slim.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("digest")))
    located = log.withColumn("slot", _slot(depth)).join(slots, "slot").drop("slot")
    return located, store(chained.sortWithinPartitions("bucket", "hash", "chain"), "index-buckets", "bucket")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of docs.

    Texts are equal when identical after lower-casing A-Z; a null text is empty; the largest doc_id of a group is
    kept. Rows that repeat a doc_id with the same text count singly and share `kept`. A null doc_id is never the
    largest; a group of null ids only keeps its rows. An empty table gives an empty result."""
    log, entries = build_index(id_text(docs, id_col, text_col), **index)
    found = log.join(entries.select("bucket", "hash", "digest", "keep_id", "group_size"), ["bucket", "hash", "digest"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies that the index drops; columns as they came. Rows are told apart by id and text."""
    drop = exact_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_drop"), F.col("text_sha256").alias("_digest")).distinct()
    digest = F.sha2(ascii_lower(F.coalesce(role(docs, text_col, "string"), F.lit(""))).cast("binary"), 256)
    return docs.join(drop, role(docs, id_col, "long").eqNullSafe(drop["_drop"]) & (digest == drop["_digest"]), "left_anti")
