"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Everything is learned from labelled rows whose crc32(doc_id as text) mod 3 is not 1, of which at most SAMPLE_ROWS (in
the order of a hash of their ids) are read: a lexicon of words and word beginnings by log-odds, the trees, and the
calibration. Features that the trees see for a learning row come from a lexicon of the other half of the rows, and the
calibration sees scores of trees that did not see the row, so neither is fitted to its own memory."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, learn_mask, role, slices, store

SAMPLE_ROWS, THRESHOLD = 20_000, 0.7
#: Documents that must hold a lexicon term, terms kept, smallest weight (log-odds ratio) and z-like strength of one.
MIN_SUPPORT, LEXICON_TERMS, MIN_WEIGHT, MIN_STRENGTH = 3, 600, 1.6, 3.2
#: Terms of the sample's toxic rows, by support, that may enter the lexicon.
LEXICON_CANDIDATES = 100_000
PREFIXES = (6, 7)
NEAR = 5
# Second-person words of several languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos usted tú ti tus vosotros ustedes".split())
# Signs that stand for letters in obfuscated words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
FEATURES = ("hits", "density", "weight", "top_weight", "top3", "near_you", "hits_near_you", "capitals", "exclamations", "punctuation", "obfuscated", "log_words", "strong_hits")
_EDGES = re.compile(r"^\W+|\W+$")
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def normal(token: str) -> tuple[str, bool]:
    """(word, whether obfuscated) of a white-space token: lower case, outer signs off, inner signs read as letters."""
    core = _EDGES.sub("", token).lower()
    if not core or core.isalpha():
        return core, False
    word = "".join(c for c in core.translate(LEET) if c.isalpha())
    return word, sum(c.isalpha() for c in core) >= 2 and len(word) >= 4


def terms_of(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


class Featurizer:
    """Dense features of a text under a lexicon {term: weight}. Tokens seen before are looked up."""

    MEMO = 300_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.memo, self.odd = lexicon, {}, set()

    def _value(self, token: str) -> float:
        word, obfuscated = normal(token)
        if obfuscated:
            self.odd.add(token)
        held = [self.lexicon[t] for t in terms_of(word) if t in self.lexicon] if word else []
        value = max(held) if held else (-1.0 if word in SECOND_PERSON else 0.0)
        self.memo[token] = value
        return value

    def __call__(self, text: str) -> list[float]:
        if len(self.memo) > self.MEMO:
            self.memo.clear()
            self.odd.clear()
        tokens = text.split()
        memo, value = self.memo, self._value
        v = np.array([memo[t] if t in memo else value(t) for t in tokens], dtype=np.float64)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        chars, words = max(1, len(raw)), max(1, len(tokens))
        capitals = int(((raw >= 65) & (raw <= 90)).sum())
        letters = capitals + int(((raw >= 97) & (raw <= 122)).sum())
        at, you = np.flatnonzero(v > 0), np.flatnonzero(v < 0)
        near, hits_near = 0.0, 0
        if len(at) and len(you):
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
            near, hits_near = 1.0 / (1.0 + float(gap.min())), int((gap <= NEAR).sum())
        kinds = {}
        for i in at.tolist():
            kinds[tokens[i]] = v[i]
        weights = sorted(kinds.values(), reverse=True)
        return [float(len(weights)), len(at) / words, float(sum(weights)), weights[0] if weights else 0.0, float(sum(weights[:3])) / math.log(math.e + words), near, float(hits_near), capitals / max(1, letters), int((raw == 33).sum()) / words, int(_PUNCTUATION[raw].sum()) / chars, (sum(t in self.odd for t in tokens) / words) if self.odd else 0.0, math.log1p(len(tokens)), float(sum(w > 2.5 for w in weights))]


class BoostedTrees:
    """Logistic gradient boosting with depth-limited regression trees over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, leaf: int = 8, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.penalty = rounds, depth, rate, bins, leaf, penalty
        self.base, self.edges, self.trees = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        b, raw = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.rounds if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf_of = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            raw += self.rate * tree[2][leaf_of]
        return self

    def _grow(self, b, g, h):
        """(features, cuts, values) of a full binary tree; rows with bin <= cut go left. Also each row's leaf."""
        inner, at = (1 << self.depth) - 1, np.zeros(len(g), dtype=np.int64)
        features, cuts = np.zeros(inner, dtype=np.int64), np.full(inner, 1 << 30, dtype=np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-9, 0, 1 << 30)
            if len(rows) >= 2 * self.leaf:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(b.shape[1]):
                    n_bins = len(self.edges[j]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b[rows, j], w, n_bins))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                    gain[(nl < self.leaf) | (len(rows) - nl < self.leaf)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
            features[node], cuts[node] = best[1], best[2]
            at[rows] = 2 * node + 1 + (b[rows, best[1]] > best[2])
        leaf_of = at - inner
        gl, hl = np.bincount(leaf_of, g, 1 << self.depth), np.bincount(leaf_of, h, 1 << self.depth)
        return (features, cuts, gl / (hl + self.penalty)), leaf_of

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.full(len(x), self.base)
        for features, cuts, values in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[np.arange(len(x)), features[at]] > cuts[at])
            out += self.rate * values[at - (len(features))]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the isotonic regression of y on raw (pool adjacent violators); between the blocks' means it is linear."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, t in zip(raw[order].tolist(), y[order].tolist()):
        blocks.append([t, 1.0, r])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t2, n2, r2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2] + r2]
    n = np.array([b[1] for b in blocks])
    return np.array([b[2] for b in blocks]) / n, (np.array([b[0] for b in blocks]) + 0.02) / (n + 0.04)


class ToxicityModel:
    """Lexicon, trees and calibration; score(texts) -> probabilities that never leave 0 to 1."""

    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def scorer(self):
        features = Featurizer(self.lexicon)

        def score(texts: list[str]) -> np.ndarray:
            raw = self.trees.raw(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)))
            smooth = 1 / (1 + np.exp(-raw))  # orders documents within a block
            return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * smooth, 0.0, 1.0) if len(self.knots[0]) else smooth

        return score


def _term_counts(toxic: int, only: frozenset | None):
    """(term, half, n): documents of one label that hold a term, by half; with `only`, of those terms."""

    def run(batches):
        counts = Counter()
        for b in slices(batches):
            for half, text, label in zip(*(b.column(i).to_pylist() for i in range(3))):
                if label == toxic:
                    terms = {t for w in {normal(x)[0] for x in set(text.split())} if len(w) > 2 for t in terms_of(w)}
                    counts.update((t, half) for t in (terms if only is None else terms & only))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], type=pa.string()), pa.array([k[1] for k in keys], type=pa.int32()), pa.array([counts[k] for k in keys], type=pa.int64())], names=["term", "half", "n"])

    return run


def _weights(toxic: dict, clean: dict, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Lexicon of the strongest terms: log-odds ratio with add-half smoothing."""
    held = {}
    for term, n in toxic.items():
        w = math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(term, 0) + 0.5) / (n_clean + 1))
        if n >= MIN_SUPPORT and w >= MIN_WEIGHT and w * math.sqrt(n) >= MIN_STRENGTH * MIN_WEIGHT:
            held[term] = w
    top = sorted(held, key=lambda t: (-held[t] * math.sqrt(toxic[t]), t))[:LEXICON_TERMS]
    return {t: held[t] for t in top}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Model from at most sample_rows labelled rows of docs. Rows with a null id or label are not used; with one label
    only, or none, every score is that label's share."""
    ids = labels.select(role(labels, label_id, "long").alias("doc_id"), role(labels, label_col, "int").alias("toxic")).where("doc_id is not null and toxic is not null").where(learn_mask())
    chosen = store(ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "labelled")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    rows = store(id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select(half.alias("half"), "text", "toxic"), "labelled-texts")  # at most sample_rows ids
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("half", "toxic").count().collect()}
    total = lambda part: part.groupBy("term").agg(*(F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)))
    seen = total(rows.mapInArrow(_term_counts(1, None), "term string, half int, n long")).where(F.col("n0") + F.col("n1") >= MIN_SUPPORT)
    hot = {r["term"]: (r["n0"], r["n1"]) for r in seen.orderBy(F.desc(F.col("n0") + F.col("n1")), "term").limit(LEXICON_CANDIDATES).collect()}  # of a bounded sample
    cold = {r["term"]: (r["n0"], r["n1"]) for r in total(rows.mapInArrow(_term_counts(0, frozenset(hot)), "term string, half int, n long")).collect()}

    def lexicon(halves: tuple[int, ...]) -> dict[str, float]:
        pick = lambda d: {t: sum(n[h] for h in halves) for t, n in d.items()}
        return _weights(pick(hot), pick(cold), *(sum(sizes.get((h, label), 0) for h in halves) for label in (1, 0)))

    other = {0: lexicon((1,)), 1: lexicon((0,))}

    def featurized(batches):
        makers = {h: Featurizer(x) for h, x in other.items()}
        for b in slices(batches):
            made = [makers[h](t) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(made, type=pa.list_(pa.float64())), b.column(2)], names=["x", "toxic"])

    learned = rows.mapInArrow(featurized, "x array<double>, toxic int").collect()  # at most sample_rows short rows
    x = np.array([r["x"] for r in learned], dtype=np.float64).reshape(-1, len(FEATURES))
    y = np.array([float(r["toxic"] > 0) for r in learned])
    order = np.lexsort((*x.T, y))  # the same rows in the same order on every run
    x, y = x[order], y[order]
    fold, raw = np.arange(len(y)) % 5, np.zeros(len(y))
    for k in range(5):
        if (fold == k).any():
            raw[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return ToxicityModel(lexicon((0, 1)), BoostedTrees().fit(x, y), isotonic(raw, y))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs; nothing but the text enters a score.

    A null text is scored as an empty one. Repeated rows give repeated rows; an empty table an empty result."""
    def run(batches):
        scorer = model.scorer()  # at most LEXICON_TERMS terms and some trees
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(b.column(1).to_pylist()), type=pa.float64())], names=["doc_id", "score"])

    made = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return made.select("doc_id", (~F.coalesce(learn_mask(), F.lit(True))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; columns as they came. Rows are judged one by one, in place: a null
    text as an empty one, a null id by its text, repeated rows alike. An empty table gives an empty one."""
    model = fit(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = model.scorer()
        for b in slices(batches):
            yield b.filter(pa.array(scorer([t or "" for t in b.column(at).to_pylist()]) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
