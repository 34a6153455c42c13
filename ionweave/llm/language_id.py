"""Language identification by rank-order profiles (Cavnar and Trenkle 1994).

A profile is the list of a language's most frequent letter n-grams (one to three letters, with word ends). A document
is compared by the out-of-place distance: for each of its own most frequent n-grams, how far its rank is from that in
the profile, or the longest distance if the profile lacks it. The nearest profile is the prediction."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import learn_mask, role, slices

#: Learning rows per language (expected; chosen by a hash of the id), n-grams of a profile and of a document.
SAMPLE_PER_LANG, PROFILE, DOCUMENT = 2_000, 600, 400
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> str:
    """The text in lower case with everything but letters (Unicode category L) as blanks, a run of it as one."""
    low = _NOT_LETTERS.sub(" ", text.lower())
    if low.replace(" ", "a").isalpha() or not low:
        return low
    return re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in low))  # numerals other than digits


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes ascending, counts) of a text's 1- to 3-grams over letters and word ends."""
    c = np.frombuffer((" " + letters_of(text) + " ").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    letter = c != 32
    one = c[letter]
    two = ((c[:-1] << np.uint64(21)) | c[1:])[letter[:-1] | letter[1:]]
    three = ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[letter[1:-1]]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def top_grams(text: str, n: int) -> np.ndarray:
    """The n most frequent codes, most frequent first, smaller code first among equals."""
    codes, counts = gram_counts(text)
    return codes[np.argsort(-counts, kind="stable")[:n]]


class RankProfiles:
    """Profiles of all languages as one matrix: rank of every known n-gram per language, or `missing`."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.missing = max([PROFILE, *map(len, profiles.values())])
        self.codes = np.array(sorted({c for p in profiles.values() for c in p}), dtype=np.uint64)
        self.ranks = np.full((len(self.codes), len(self.langs)), self.missing, dtype=np.int32)
        for j, lang in enumerate(self.langs):
            own = np.array(profiles[lang], dtype=np.uint64)
            self.ranks[np.searchsorted(self.codes, own), j] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score). Without a letter or a profile: (`und`, 0). Equal distances: the first name."""
        if not self.langs or not text:
            return UNKNOWN, 0.0
        grams = top_grams(text, DOCUMENT)
        if not len(grams):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        known = self.codes[at] == grams
        place = np.arange(len(grams))[:, None]
        apart = np.where(known[:, None], np.minimum(np.abs(self.ranks[at] - place), self.missing), self.missing)
        apart = np.where(self.ranks[at] == self.missing, self.missing, apart).sum(axis=0) / (len(grams) * self.missing)
        best = int(apart.argmin())
        near = np.exp(-10 * (apart - apart[best]))
        return self.langs[best], float(1 / near.sum()) if len(self.langs) > 1 else float(1 - apart[best])


def _sample_counts(batches):
    for b in batches:
        held: dict[str, list] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(lang, []).append(gram_counts(text))
        for lang, parts in held.items():
            codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), type=pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "code", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG) -> RankProfiles:
    """Profiles from rows with a language and crc32(doc_id as text) mod 3 other than 1. Of each language a share of the
    rows is read that makes about sample_per_lang rows, chosen by a hash of the id. Rows with a null id, text or language
    teach nothing; repeated rows count as often as they occur; an empty table gives no profiles."""
    rows = docs.select(role(docs, id_col, "long").alias("doc_id"), role(docs, text_col, "string").alias("text"), role(docs, lang_col, "string").alias("lang")).where("lang is not null and text is not null").where(learn_mask())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return RankProfiles({})
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_per_lang / n))))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")
    counts = sample.mapInArrow(_sample_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["code"] & ((1 << 64) - 1))
    return RankProfiles(profiles)


def identify(docs: DataFrame, model: RankProfiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of docs, from its whole text alone.

    Null texts and texts without a letter are `und` with score 0, and so is everything if no language was learned.
    Repeated rows give repeated rows; an empty table an empty result."""

    def run(batches):
        for b in slices(batches):
            found = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(role(docs, id_col, "long").alias("doc_id"), role(docs, text_col, "string").alias("text"))
    made = slim.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return made.select("doc_id", (~F.coalesce(learn_mask(), F.lit(True))).alias("held_out"), "lang_pred", "score")
