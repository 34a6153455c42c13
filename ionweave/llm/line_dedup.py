"""Line dedup with sharded cuckoo filters over exact reference counts.

* The reference log holds one row per (line key, document); counts made from it are exact. Inserting documents appends
  rows, deleting documents appends their negation, and only touched keys are counted anew, so dedup is reversible.
* Keys that enough documents hold are in cuckoo filters, one per hash class of keys. The lines of a class go to the
  tasks that hold its filter; a line whose key it lacks stays without a look-up. The others are verified against the
  exact counts, so false positives change nothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, id_text, role, slices, store

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of one filter at most (on average), and parts of shards that a partition gets.
SHARD_KEYS, SALTS = 32_768, 4
_STRIP = BLANKS.encode()


class CuckooFilter:
    """Four-slot cuckoo filter with 16-bit tags (Fan et al. 2014). Keys are 16-byte digests. Supports deletion."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.85)))))
            table = np.zeros((buckets, self.SLOTS), dtype=np.uint16)
        self.table, self.mask = table, len(table) - 1

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        room = max(1, len(keys))
        while True:
            made = cls(room)
            if all(made.insert(k) for k in keys):
                return made
            room *= 2

    def _places(self, key: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(key[8:10], "little") or 1
        one = int.from_bytes(key[10:14], "little") & self.mask
        return tag, one, self._other(one, tag)

    def _other(self, at: int, tag: int) -> int:
        return (at ^ (tag * 0x5BD1E995)) & self.mask

    def insert(self, key: bytes) -> bool:
        tag, one, two = self._places(key)
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = tag
                return True
        at = two
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            tag, self.table[at, slot] = int(self.table[at, slot]), tag
            at = self._other(at, tag)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = tag
                return True
        return False

    def delete(self, key: bytes) -> bool:
        tag, one, two = self._places(key)
        for at in (one, two):
            held = np.flatnonzero(self.table[at] == tag)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def __contains__(self, key: bytes) -> bool:
        tag, one, two = self._places(key)
        return bool((self.table[one] == tag).any() or (self.table[two] == tag).any())

    def held(self, keys: list[bytes]) -> np.ndarray:
        """Which keys the filter may hold."""
        raw = np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, 16)
        tag = raw[:, 8:10].copy().view("<u2")[:, 0].astype(np.int64)
        tag[tag == 0] = 1
        one = raw[:, 10:14].copy().view("<u4")[:, 0].astype(np.int64) & self.mask
        two = (one ^ (tag * 0x5BD1E995)) & self.mask
        return ((self.table[one] == tag[:, None]) | (self.table[two] == tag[:, None])).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, dtype=np.uint16).reshape(-1, cls.SLOTS).copy())


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of a line stripped of [\\x20\\x09-\\x0D] and with A-Z lower-cased; None if under min_chars code points."""
    key = line.strip(_STRIP)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _keys_of(text: bytes, min_chars: int) -> set[bytes]:
    return {k for k in (line_key(x, min_chars) for x in text.split(b"\n")) if k is not None}


def _reference_rows(min_chars: int):
    """(key, doc_id) of each document's keys."""

    def run(batches):
        for b in slices(batches):
            keys, ids = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                own = _keys_of(text, min_chars)
                keys += own
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.binary()), pa.array(ids, type=pa.int64())], names=["key", "doc_id"])

    return run


def _build_filter(key, table):
    """The filter of one shard from its keys."""
    return pa.table({"shard": pa.array([key[0].as_py()], type=pa.int32()), "filter": pa.array([CuckooFilter.of(table.column("key").to_pylist()).to_bytes()], type=pa.binary())})


def _shard_column(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def sharded_filters(keys: DataFrame, n_keys: int) -> tuple[int, DataFrame]:
    """(number of shards, DataFrame of (shard, filter)); each filter holds the keys of one hash class."""
    shards = max(1, -(-n_keys // SHARD_KEYS))
    dealt = keys.select("key", _shard_column(shards).alias("_s"))
    return shards, store(dealt.groupBy("_s").applyInArrow(_build_filter, "shard int, filter binary"), "filters")


def count_references(refs: DataFrame) -> DataFrame:
    """(key, n_docs, max_doc) of a log (key, doc_id, change): different documents that hold a key, and the largest."""
    own = refs.groupBy("key", "doc_id").agg(F.sum("change").alias("n")).where("n > 0")
    return own.groupBy("key").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _apply(min_chars: int):
    def run(batches):
        for b in slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    gone = set(drop)
                    lines = [x for x in lines if line_key(x, min_chars) not in gone]
                    text = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.binary()).cast(pa.string()), pa.array(n_lines, type=pa.int64()), pa.array(n_dropped, type=pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return run


def _screen(batches):
    """(key, doc_id) rows that their shard's filter may hold, from rows (shard, salt, filter, key, doc_id) sorted so that a
    shard's filter comes before its keys."""
    shard, held = None, None
    for b in batches:
        at = b.column(0).to_numpy(zero_copy_only=False)
        for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else ():
            part = b.slice(int(rows[0]), len(rows))
            if at[rows[0]] != shard:
                shard, held = at[rows[0]], None
            n = len(rows) - part.column(2).null_count
            if n:
                held = CuckooFilter.from_bytes(part.column(2)[0].as_py())
                part = part.slice(n)
            if held is not None and part.num_rows:
                may = pa.array(held.held(part.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(3).filter(may), part.column(4).filter(may)], names=["key", "doc_id"])


def _change_filter(min_docs: int):
    """The filter of one shard with the keys in or out whose counts crossed min_docs; null if it has no room for them."""

    def run(key, filters, changes):
        data = filters.column("filter")[0].as_py() if filters.num_rows else CuckooFilter(1).to_bytes()
        held, room = CuckooFilter.from_bytes(data), True
        for k, before, now in zip(*(changes.column(c).to_pylist() for c in ("key", "before", "now"))):
            if now >= min_docs > before:
                room = room and held.insert(k)
            elif before >= min_docs > now:
                held.delete(k)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([held.to_bytes() if room else None], pa.binary())})

    return run


class LineIndex:
    """State of incremental line dedup in the shared folder: a log of references, exact counts and filters by shard.

    An insertion or deletion appends to the log, counts again only the keys it touches, writes only their shards, and
    puts into the shards' filters or takes out of them only the keys whose counts cross min_docs. Every other file stays."""

    def __init__(self, log: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_chars: int, min_docs: int):
        self.log, self.counts, self.filters, self.shards, self.min_chars, self.min_docs = log, counts, filters, shards, min_chars, min_docs

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        """docs: (doc_id, text) rows."""
        log = store(docs.mapInArrow(_reference_rows(min_chars), "key binary, doc_id long").withColumn("change", F.lit(1)), "references")
        counts = store(count_references(log).where("n_docs > 0"), "line-counts")
        frequent = counts.where(F.col("n_docs") >= min_docs)
        shards, filters = sharded_filters(frequent, frequent.count())
        return cls(log, counts.withColumn("shard", _shard_column(shards)), filters, shards, min_chars, min_docs)

    def references(self) -> DataFrame:
        """(key, doc_id) rows as inserted, for documents that are still in."""
        return self.log.where("change > 0").select("key", "doc_id") if not self._changed() else self.refs

    def _changed(self) -> bool:
        return bool(self.log.where("change < 0").take(1))

    @property
    def refs(self) -> DataFrame:
        """(key, doc_id): different references of the documents that are in."""
        return self.log.groupBy("key", "doc_id").agg(F.sum("change").alias("n")).where("n > 0").select("key", "doc_id")

    @property
    def frequent(self) -> DataFrame:
        """(key, n_docs, max_doc) of the keys that at least min_docs documents hold."""
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("key", "n_docs", "max_doc")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with docs added; documents whose ids it already has gain the new lines."""
        rows = docs.mapInArrow(_reference_rows(self.min_chars), "key binary, doc_id long").distinct()
        known = self.refs.withColumns({"k": F.col("key"), "d": F.col("doc_id")}).select("k", "d")
        fresh = rows.join(known, (rows["key"] == known["k"]) & rows["doc_id"].eqNullSafe(known["d"]), "left_anti")
        return self._with(store(fresh.withColumn("change", F.lit(1)), "references"))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index as if the documents of ids (column doc_id) had never been inserted."""
        gone = self.log.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("key", "doc_id").agg((-F.sum("change")).cast("int").alias("change"))
        return self._with(store(gone.where("change < 0"), "references"))

    def _with(self, more: DataFrame) -> LineIndex:
        log = self.log.union(more.select(*self.log.columns))
        touched = store(more.select("key").distinct().withColumn("shard", _shard_column(self.shards)), "touched")
        shards = [r[0] for r in touched.select("shard").distinct().collect()]  # of at most self.shards
        if not shards:
            return self
        mine, other = self.counts.where(F.col("shard").isin(shards)), self.counts.where(~F.col("shard").isin(shards))
        again = count_references(log.join(touched, "key", "left_semi")).withColumn("shard", _shard_column(self.shards))
        fresh = store(mine.join(touched, "key", "left_anti").select(*self.counts.columns).union(again.where("n_docs > 0").select(*self.counts.columns)), "line-counts")
        before = mine.join(touched, "key", "left_semi").select("key", F.col("n_docs").alias("before"))
        now = again.select("key", F.col("n_docs").alias("now"))
        moved = touched.join(before, "key", "left").join(now, "key", "left").select("key", "shard", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("now", F.lit(0)).alias("now"))
        moved = moved.where((F.col("before") >= self.min_docs) != (F.col("now") >= self.min_docs))
        own = self.filters.where(F.col("shard").isin(shards))
        made = store(own.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(_change_filter(self.min_docs), "shard int, filter binary"), "filters")
        full = [r[0] for r in made.where("filter is null").select("shard").collect()]
        kept = made.where("filter is not null")
        if full:
            again = fresh.where((F.col("n_docs") >= self.min_docs) & F.col("shard").isin(full)).select("key", F.col("shard").alias("_s"))
            kept = kept.union(store(again.groupBy("_s").applyInArrow(_build_filter, "shard int, filter binary"), "filters"))
        return LineIndex(log, other.union(fresh), self.filters.where(~F.col("shard").isin(shards)).union(kept), self.shards, self.min_chars, self.min_docs)

    def screened(self, refs: DataFrame) -> DataFrame:
        """(key, doc_id) of refs whose shard's filter may hold the key. Each task loads the filters of its own shards; a
        shard is cut into parts by document, SALTS for each partition in all, so that a key with a third of all lines is
        dealt out too."""
        n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = -(-SALTS * n // self.shards)
        own = refs.select(_shard_column(self.shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), F.lit(None).cast("binary").alias("filter"), "key", "doc_id")
        sent = self.filters.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "filter", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"))
        dealt = own.union(sent).repartition(n, "shard", "salt").sortWithinPartitions("shard", F.col("filter").isNull())
        return dealt.mapInArrow(_screen, "key binary, doc_id long")

    def drops(self, refs: DataFrame) -> DataFrame:
        """(doc, drop): keys whose lines each document of refs loses."""
        found = self.screened(refs).join(self.frequent, "key").where("doc_id is null or doc_id < max_doc")
        return found.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set("key").alias("drop"))  # a document's own lines

    def apply(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """(doc_id, text, n_lines, n_dropped): docs without the lines that a document with a larger id holds too.
        refs: the references of docs, where they are at hand."""
        drops = self.drops(docs.mapInArrow(_reference_rows(self.min_chars), "key binary, doc_id long") if refs is None else refs)
        both = docs.join(drops, docs["doc_id"].eqNullSafe(drops["doc"]), "left").select("doc_id", "text", "drop")
        return both.mapInArrow(_apply(self.min_chars), "doc_id long, text string, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): one row per row of docs, with repeated lines taken out.

    Lines end at \\n only; a null or empty text is one empty line. A key held by at least min_docs different doc_ids
    loses its lines everywhere but in the largest of them. Rows that repeat a doc_id are one document. A null doc_id
    is never counted and never the largest. An empty table gives an empty result."""
    rows = id_text(docs, id_col, text_col)
    index = LineIndex.of(rows, min_chars, min_docs)
    return index.apply(rows, index.references())


def replace_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the texts that dedup_lines leaves; all other columns as they came, whatever their names.

    Every row stays, null ids and repeated rows too; a null text stays null; an empty table gives an empty one."""
    rows = id_text(docs, id_col, text_col)
    index = LineIndex.of(rows, min_chars, min_docs)
    drops = index.drops(index.references())
    whole = docs.select(F.struct(*(role(docs, c) for c in docs.columns)).alias("row"), role(docs, id_col, "long").alias("id"))
    both = whole.join(drops, whole["id"].eqNullSafe(drops["doc"]), "left").select("row", "drop")
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            columns, texts = b.column(0).flatten(), []
            for text, drop in zip(columns[at].cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                if drop and text is not None:
                    gone = set(drop)
                    text = b"\n".join(x for x in text.split(b"\n") if line_key(x, min_chars) not in gone)
                texts.append(text)
            columns[at] = pa.array(texts, type=pa.binary()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(b.schema.field(0).type)))

    return both.mapInArrow(run, docs.schema)
