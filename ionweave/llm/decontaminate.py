"""Benchmark decontamination by SimHash of item-sized windows with multi-index Hamming blocks. DataFrame operations only.

* Words are runs of letters and digits of the lower-cased text; shingles have five words (an item with fewer is one
  shingle of its own size).
* Prefilter, which loses nothing: a window can be similar enough only where the document holds enough of an item's shingles (the bound
  follows from the similarity). There, at every alignment that a shared shingle proposes, a window
  of the item's size is fingerprinted. Windows with equal shingles are fingerprinted once.
* Multi-index: with radius r, fingerprints are cut into r + 1 blocks; two within r bits agree in a block, so the join
  over (item size, block, value) finds all of them. Met pairs within the radius are verified. At a similarity of 0.8
  the radius must be near a third of the bits, where no choice of blocks is selective (four blocks of 16 bits, each
  searched within 5, meet 36 % of all pairs): the prefilter is what keeps the pairs few.
* Verification: weighted-shingle similarity, exact: a shingle weighs as often as it occurs; the sum of the smaller
  weights over the sum of the larger ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, role, sized, store

SHINGLE, SIMILARITY = 5, 0.8
#: Radius of the fingerprint search. Texts of similarity 0.8 differ in about 10 of 64 bits with a deviation of 3.
RADIUS = 20
#: Bytes of the shingle dictionary, and of places to look into, that are sent to the tasks; beyond it, shuffle joins.
BROADCAST_BYTES = 16 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, width: int) -> Column:
    """Hashes of all runs of `width` words; none if there are fewer words."""
    hashed = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(*(F.get(words, i + (k - 1)) for k in range(width))))
    return F.when(F.size(words) >= width, hashed).otherwise(F.array().cast("array<long>"))


def simhash64(groups: DataFrame, keys: list[str], shingle: str = "h") -> DataFrame:
    """(keys, fp): 64-bit SimHash of each group's shingles, every occurrence with weight one."""
    bit = lambda b: F.shiftrightunsigned(shingle, b).bitwiseAND(F.lit(1))
    sums = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(bit(b)).alias(f"_b{b}") for b in range(64)))
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"_b{b}") * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def blocks_of(fp: Column, radius: int) -> Column:
    """array<struct<block,value>>: the fingerprint cut into radius + 1 blocks of nearly equal width."""
    cuts = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words, width, m): items with at least one word. m: shingles."""
    items = id_text(benchmark, id_col, text_col).select(F.col("doc_id").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    return items.select("item_id", "words", n.alias("n_words"), F.least(n, F.lit(SHINGLE)).alias("width"), (n - F.least(n, F.lit(SHINGLE)) + 1).alias("m")).distinct()


def _all_shingles(rows: DataFrame, keep: list[str], widths: list[int]) -> DataFrame:
    """(keep..., width, pos, h) of rows with `words`, for each width that items have."""
    parts = [rows.select(*keep, F.lit(w).alias("width"), F.posexplode(shingles_of(F.col("words"), w)).alias("pos", "h")) for w in widths]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): for each document and item that it holds, the most
    similar window (the first of equals).

    Null texts are empty; an empty item is held by nobody; a null id is an id like any other. Rows that repeat a
    doc_id are one document. A document shorter than an item is one window. Empty tables give an empty result."""
    spark = docs.sparkSession
    items = store(_items(benchmark, item_id, item_text), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most SHINGLE values
    if not widths:
        return spark.createDataFrame([], "doc_id long, item_id long, start_word int, n_words int, hamming int, similarity double")
    texts = id_text(docs, id_col, text_col)
    worded = texts.select("doc_id", words_of(F.col("text")).alias("words"))
    item_rows = store(_all_shingles(items, ["item_id", "n_words", "m", F.col("width").alias("own")], widths).where("own = width").drop("own"), "item-shingles")

    hashes = store(item_rows.select("width", "h").distinct(), "item-hashes")
    met = store(_all_shingles(worded, ["doc_id", F.size("words").alias("doc_words")], widths).join(sized(hashes, BROADCAST_BYTES), ["width", "h"]), "met")
    pairs = met.join(item_rows.withColumnRenamed("pos", "item_pos"), ["width", "h"])
    held = pairs.groupBy("doc_id", "item_id").agg(F.count_distinct("pos").alias("_held"), F.max("m").alias("_m")).where(F.col("_held") >= similarity * F.col("_m"))
    enough = pairs.join(held.select(F.col("doc_id").alias("_d"), F.col("item_id").alias("_i")), F.expr("doc_id <=> _d and item_id <=> _i"), "left_semi")
    begin = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("item_pos"), F.col("doc_words") - F.col("n_words")))
    windows = store(enough.select("doc_id", "n_words", "width", begin.alias("start")).distinct(), "windows")

    look = store(windows.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(F.struct("n_words", "width", "start")).alias("spots")), "look-into")
    cut = worded.join(sized(look, BROADCAST_BYTES), worded["doc_id"].eqNullSafe(F.col("_d"))).select("doc_id", "words", F.explode("spots").alias("w"))
    cut = cut.select("doc_id", "w.*", F.slice("words", F.col("w.start") + 1, F.col("w.n_words")).alias("words"))
    made = None
    for w in widths:
        part = cut.where(F.col("width") == w).select("doc_id", "n_words", "start", shingles_of(F.col("words"), w).alias("hs"))
        made = part if made is None else made.union(part)
    made = store(made.where(F.size("hs") > 0).withColumn("content", F.xxhash64("n_words", "hs")), "window-shingles")
    contents = store(made.select("content", "n_words", "hs").dropDuplicates(["content"]), "contents")
    c_rows = contents.select("content", "n_words", F.explode("hs").alias("h"))

    left = simhash64(c_rows, ["content", "n_words"]).select("content", "n_words", "fp", F.explode(blocks_of(F.col("fp"), radius)).alias("b"))
    right = simhash64(item_rows, ["item_id", "n_words"]).select("item_id", "n_words", F.col("fp").alias("item_fp"), F.explode(blocks_of(F.col("fp"), radius)).alias("b"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = store(left.join(right, ["n_words", "b"]).where(apart <= radius).select("content", "item_id", apart.cast("int").alias("hamming")).distinct(), "near")

    c_weights = c_rows.groupBy("content", "h").agg(F.count(F.lit(1)).alias("cw"))
    i_weights = item_rows.groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("iw"))
    shared = near.join(c_weights, "content").join(i_weights.withColumnRenamed("item_id", "_i"), "h").where("item_id <=> _i")
    overlap = shared.groupBy("content", "item_id").agg(F.max("hamming").alias("hamming"), F.sum(F.least("cw", "iw")).alias("both"))
    sizes = item_rows.select(F.col("item_id").alias("_i"), "m").distinct()
    scored = overlap.join(sizes, F.expr("item_id <=> _i")).join(contents.select("content", F.size("hs").alias("cm")), "content")
    scored = scored.select("content", "item_id", "hamming", (F.col("both") / (F.col("cm") + F.col("m") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= similarity)
    spots = made.select("doc_id", "n_words", "start", "content").join(store(scored, "scored"), "content")
    best = F.max_by(F.struct(F.col("start").alias("start_word"), "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("start")))
    return spots.groupBy("doc_id", "item_id").agg(best.alias("w")).select("doc_id", "item_id", "w.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; columns as they came.

    Null texts hold nothing. Rows that repeat an id, or whose id is null, are one document and stay or go together. An
    empty table gives an empty one, an empty benchmark drops nothing."""
    drop = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, role(docs, id_col, "long").eqNullSafe(drop["_drop"]), "left_anti")
