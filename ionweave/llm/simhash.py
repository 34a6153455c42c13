"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two fingerprints that differ in at most r <= 4 bits agree in at least 8 - r of
them: the guaranteed minimum. Lists of the plain index, one per position and byte, hold a 256th of all fingerprints
each; they are therefore partitioned further: each distinct fingerprint is posted under every choice of 8 - r
(position, byte) pairs, so that the pairs that can reach the minimum still meet. Within a list, the shared positional
bytes of each pair are tallied, pairs that reach the minimum are retained and verified by the Hamming distance. A pair
that meets in several lists counts only in its first one, and each list returns a spanning forest of its verified
links, so output stays linear in the postings whatever the size of a near-copy group."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, role, slices, store
from .components import components

#: Words of a shingle, seed of its hash, differing bits of a link.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: A posting list longer than this is linked through shared neighbours instead of pair by pair.
LONG_LIST = 4096
_CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, 4-word shingles with repeats."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(SHINGLE)))]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), _CHUNK):
        h = np.array([digest(s, SEED) for s in shingles[at : at + _CHUNK]], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    for b in slices(batches):
        texts = b.column(1).cast(pa.binary()).to_pylist()
        fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])


def choices(radius: int) -> list[tuple[int, ...]]:
    """The sets of byte positions of which a linked pair must share one."""
    return list(combinations(range(8), 8 - radius))


def postings(fps: DataFrame, radius: int) -> DataFrame:
    """(key, fp): one row per distinct fingerprint and choice of positions; key holds the choice and its bytes."""
    rows = []
    for c, positions in enumerate(choices(radius)):
        value = F.lit(c).cast("long")
        if len(positions) <= 6:  # 7 bytes of choice and bytes fit a long
            for p in positions:
                value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        else:
            value = F.xxhash64(value, *(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in positions))
        rows.append(value)
    return fps.select(F.explode(F.array(*rows)).alias("key"), "fp")


_LOW_BITS = np.uint64(0x0101010101010101)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Tally of equal positional bytes of pairs of fingerprints, given their exclusive or."""
    y = x | x >> np.uint64(4)
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    return 8 - np.bitwise_count(y & _LOW_BITS)


def _forest(f: np.ndarray, c: np.ndarray, radius: int, first: np.ndarray):
    """Links of one posting list whose first shared choice is c, as (child, root) pairs of a spanning forest."""
    out_a, out_b = [], []
    parent = list(range(len(f)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step = max(1, (1 << 20) // len(f))
    for at in range(0, len(f), step):
        x = f[at : at + step, None] ^ f[None, :]
        retained = shared_bytes(x) >= 8 - radius
        retained &= np.arange(at, at + len(x))[:, None] < np.arange(len(f))[None, :]
        i, j = np.nonzero(retained & (np.bitwise_count(x) <= radius))
        if len(i):
            same = np.packbits((x[i, j].view(np.uint8).reshape(-1, 8) == 0), axis=1, bitorder="little")[:, 0]
            hold = first[same] == c
            for p, q in zip((i[hold] + at).tolist(), j[hold].tolist()):
                rp, rq = find(p), find(q)
                if rp != rq:
                    parent[max(rp, rq)] = min(rp, rq)
                    out_a.append(f[p])
                    out_b.append(f[q])
    return out_a, out_b


def first_choice(radius: int) -> np.ndarray:
    """Index of the first choice that a set of shared byte positions (as an 8-bit mask) contains; -1 for too few."""
    masks = [sum(1 << p for p in ps) for ps in choices(radius)]
    return np.array([next((i for i, m in enumerate(masks) if s & m == m), -1) for s in range(256)])


def _link_lists(radius: int, long_list: int):
    first, n_bytes = first_choice(radius), 8 - radius

    def run(batches):
        k_left, f_left = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        spilling = None

        def emit(a, b, hot):
            return pa.RecordBatch.from_arrays([pa.array(np.array(a, dtype=np.uint64).view(np.int64)), pa.array(np.array(b, dtype=np.uint64).view(np.int64)), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

        def whole(k, f):
            cut = np.flatnonzero(np.diff(k)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(k)]
            many = ends - starts > 1
            a, b = [], []
            for s, e in zip(starts[many].tolist(), ends[many].tolist()):
                c = int(k[s]) >> (8 * n_bytes) if n_bytes <= 6 else _choice_by_agreement(f[s:e], radius)
                x, y = _forest(f[s:e], c, radius, first)
                a += x
                b += y
            return a, b

        for batch in batches:
            k = np.r_[k_left, batch.column(0).to_numpy(zero_copy_only=False)]
            f = np.r_[f_left, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if spilling is not None:
                n = int(np.searchsorted(k != spilling, True))
                if n:
                    yield emit(k[:n].view(np.uint64), f[:n], True)
                k, f = k[n:], f[n:]
                if not len(k):
                    k_left, f_left = k, f
                    continue
                spilling = None
            last = int(np.searchsorted(k, k[-1]))
            a, b = whole(k[:last], f[:last]) if last else ([], [])
            if a:
                yield emit(a, b, False)
            k_left, f_left = k[last:], f[last:]
            if len(k_left) > long_list:
                yield emit(k_left.view(np.uint64), f_left, True)
                spilling, k_left, f_left = k_left[0], k_left[:0], f_left[:0]
        if len(k_left):
            a, b = whole(k_left, f_left)
            if a:
                yield emit(a, b, False)

    return run


def _choice_by_agreement(f: np.ndarray, radius: int) -> int:
    """For hashed keys (radius 0 and 1): the choice is the first that the whole list agrees on."""
    same = np.bitwise_or.reduce(f ^ f[0])
    mask = sum(1 << p for p in range(8) if not (int(same) >> (8 * p)) & 255)
    return int(first_choice(radius)[mask])


def _neighbour_rows(radius: int):
    """Each fingerprint of a long list with every value within half the radius of it, over the bytes the list leaves free."""
    table, n_bytes = choices(radius), 8 - radius

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, f in zip(keys.tolist(), fps):
                held = table[k >> (8 * n_bytes)]
                bits = [8 * p + i for p in range(8) if p not in held for i in range(8)]
                masks = [0] + [sum(1 << x for x in m) for n in range(1, (radius + 1) // 2 + 1) for m in combinations(bits, n)]
                z = np.array(masks, dtype=np.uint64) ^ f
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), k)), pa.array(z.view(np.int64)), pa.array(np.full(len(z), f).view(np.int64))], names=["key", "z", "fp"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs within the radius.

    Lists up to long_list are compared pair by pair inside their task. In longer ones, two fingerprints within an even
    radius r share a value at most r/2 bits from each; members around one such value are within r of each other, so a
    star on each value's smallest member gives the same components, in rows linear in the list."""
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings(fps, radius).repartition(n, "key").sortWithinPartitions("key", "fp")
    met = store(dealt.mapInArrow(_link_lists(radius, long_list), "a long, b long, hot boolean"), "links")
    short = met.where("not hot").select("a", "b")
    if radius % 2 or not met.where("hot").take(1):
        return short
    around = store(met.where("hot").select("a", "b").mapInArrow(_neighbour_rows(radius), "key long, z long, fp long"), "around")
    low = around.groupBy("key", "z").agg(F.min("fp").alias("b"))
    star = around.join(low, ["key", "z"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return short.union(star)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, long_list: int = LONG_LIST) -> DataFrame:
    """(doc_id, fp long, component_id): fingerprint of each document and the smallest doc_id reachable over links.

    A null or blank text has fingerprint zero and is linked like any other. Repeated rows give repeated rows. A null
    doc_id never names a component unless no other id is in it. An empty table gives an empty result. Odd radii need
    all lists within long_list and are linked pair by pair at any length."""
    if not 0 <= radius <= 4:
        raise ValueError("radius must be from 0 to 4: beyond that, too few bytes are guaranteed")
    fps = store(id_text(docs, id_col, text_col).mapInArrow(_fingerprint_batches, "doc_id long, fp long"), "fingerprints")
    names = store(fps.groupBy("fp").agg(F.min("doc_id").alias("name")), "names")
    roots = components(links(names.select("fp"), radius, long_list if radius % 2 == 0 else 1 << 62))
    rooted = names.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "name", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("name").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that have a near-duplicate with a smaller id; the smallest id of each group stays. Columns as they came.

    Rows with a null id stay. Rows that repeat an id stay or go together. Texts without a word are near one another. An
    empty table gives an empty one."""
    found = near_duplicates(docs, id_col, text_col)
    drop = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, role(docs, id_col, "long") == drop["_drop"], "left_anti")
