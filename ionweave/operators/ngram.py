"""Protein look-up by n-grams: postings table, containment join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NGRAM = 4
#: Bits of the screen of asked n-grams and peptides, a power of two: 16 MB are sent to the tasks, whatever the input.
SCREEN_BITS = 1 << 27
#: Bytes of sequences that a task looks through at once (more where one sequence is longer).
PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def ngrams(sequence: Column, n: int = NGRAM) -> Column:
    """Distinct n-grams of a sequence; none if it is shorter."""
    return F.array_distinct(F.regexp_extract_all(sequence, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))


def ngram_index(proteins: DataFrame, n: int = NGRAM) -> DataFrame:
    """(ngram, accession): the postings, of proteins whose accessions differ."""
    return proteins.select(F.explode(ngrams(F.col("sequence"), n)).alias("ngram"), "accession")  # distinct within a protein already


def _powers(base: int, n: int) -> np.ndarray:
    return np.r_[np.uint64(1), np.cumprod(np.full(max(0, n - 1), base, dtype=np.uint64))]


def _slots(h: np.ndarray, length: int) -> np.ndarray:
    """Place in the screen of substrings with these hashes; length 0: n-grams."""
    z = h ^ np.uint64((length + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(SCREEN_BITS)).astype(np.int64)


class _Text:
    """Byte strings end to end, with the hash of any stretch: sum of byte i times BASE to the i, wherever it stands."""

    def __init__(self, strings: list[bytes]):
        self.data = b"".join(strings)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        self.stop = np.cumsum([len(x) for x in strings])
        self.end = np.repeat(self.stop, [len(x) for x in strings])
        self.sums = np.r_[np.uint64(0), np.cumsum(raw * _powers(_BASE, len(raw))[: len(raw)], dtype=np.uint64)]
        self.back = _powers(_INVERSE, len(raw))

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]


def _parts(batch):
    """(first row, byte strings) of runs of rows of about PART bytes; null is empty."""
    held, size, first = [], 0, 0
    for i, x in enumerate(batch.column(0).cast(pa.binary()).to_pylist()):
        held.append(x or b"")
        size += len(held[-1])
        if size >= PART:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _screen_rows(n: int):
    """(word, bits) of the screen: the first n-gram and the whole of each peptide; word -length names a length."""

    def run(batches):
        for batch in batches:
            for _, strings in _parts(batch):
                text, sizes = _Text(strings), np.array([len(x) for x in strings])
                start, found = text.stop - sizes, [_slots(text.hashes(text.stop - sizes, n), 0)]
                for size in np.unique(sizes).tolist():
                    found.append(_slots(text.hashes(start[sizes == size], size), size))
                slots = np.unique(np.concatenate(found))
                words = np.r_[slots >> 6, -np.unique(sizes)]
                bits = np.r_[np.left_shift(np.uint64(1), (slots & 63).astype(np.uint64)), np.zeros(len(words) - len(slots), np.uint64)]
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    return run


def _screened(sent, n: int):
    """(peptide, accession): stretches of each sequence whose first n-gram and whole pass the screen."""

    def run(batches):
        bits, lengths = sent.value
        passes = lambda slots: (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) > 0
        for batch in batches:
            for first, strings in _parts(batch):
                text = _Text(strings)
                at = np.arange(max(0, len(text.data) - n + 1))
                at = at[at + n <= text.end[at]]
                at = at[passes(_slots(text.hashes(at, n), 0))]
                for size in lengths:
                    own = at[at + size <= text.end[at]]
                    h = text.hashes(own, size)
                    met = passes(_slots(h, size))
                    own, h = own[met], h[met]
                    row = np.searchsorted(text.stop, own, "right")
                    _, one = np.unique(np.stack([row.astype(np.uint64), h]), axis=1, return_index=True) if len(own) else (None, np.zeros(0, np.int64))
                    if len(one):
                        found = pa.array([text.data[i : i + size] for i in own[one].tolist()], pa.binary())
                        yield pa.RecordBatch.from_arrays([found, batch.column(1).take(pa.array(first + row[one]))], names=["peptide", "accession"])

    return run


def _containing(peptides: DataFrame, proteins: DataFrame, n: int) -> DataFrame:
    """(peptide, accession) of all proteins that contain a peptide of at least n letters.

    The tasks that read the proteins screen every place for the peptides' first n-grams and then for whole peptides; only
    what passes leaves them, and meets the peptides by their letters. A screen that fills lets more pass, no less."""
    spark, own = proteins.sparkSession, peptides.where(F.length("peptide") >= n)
    words = own.select(F.col("peptide").cast("string")).mapInArrow(_screen_rows(n), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most SCREEN_BITS / 64 rows and one a length
    word, bits = (words.column(i).to_numpy() for i in range(2))
    screen = np.zeros(SCREEN_BITS >> 6, dtype=np.uint64)
    screen[word[word >= 0]] = bits[word >= 0].view(np.uint64)
    sent = spark.sparkContext.broadcast((screen, sorted((-word[word < 0]).tolist())))
    made = T.StructType([T.StructField("peptide", T.BinaryType()), T.StructField("accession", proteins.schema["accession"].dataType)])
    met = proteins.select("sequence", "accession").mapInArrow(_screened(sent, n), made).withColumn("peptide", F.col("peptide").cast("string"))
    return met.join(own, "peptide", "left_semi")


def find_proteins(peptides: DataFrame, index: DataFrame, proteins: DataFrame | None = None, n: int = NGRAM, peptide: str = "peptide") -> DataFrame:
    """(peptide, proteins): accessions, sorted and joined by `;`, that hold all n-grams of the peptide; with `proteins`,
    those that contain it, found by its first n-gram where the proteins lie, without reading the index. Peptides
    without a match do not appear. A longer n passes fewer places: the best is the length of the shortest peptide."""
    own = peptides.select(F.col(peptide).alias("peptide")).distinct()
    if proteins is not None:
        hits = _containing(own, proteins, n)
    else:
        wanted = own.withColumn("_grams", ngrams(F.col("peptide"), n)).select("peptide", F.size("_grams").alias("_need"), F.explode("_grams").alias("ngram"))
        asked = wanted.select("ngram").distinct()
        postings = index.join(asked, "ngram", "left_semi").distinct()  # others never leave the task that made them where the n-grams asked are few
        hits = wanted.join(postings, "ngram").groupBy("peptide", "accession").agg(F.count(F.lit(1)).alias("_have"), F.first("_need").alias("_need")).where("_have = _need")
    return hits.groupBy("peptide").agg(F.array_join(F.array_sort(F.collect_set("accession")), ";").alias("proteins"))
