"""Toxicity, language identification, secret scans: held-out accuracy, brute force, awkward rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.llm import language_id as li
from ionweave.llm import secret_scan as ss
from ionweave.llm import toxicity as tx
from ionweave.llm.common import documents

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_on_held_out_rows(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    model = tx.fit(docs, labels)
    rows = tx.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    own = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    score, label, predicted = (np.array(c) for c in zip(*own))
    assert auc(score, label) > 0.9 and predicted[label == 0].mean() < 0.03
    assert predicted[label == 1].mean() > 0.5
    again = tx.score(docs, tx.fit(docs.repartition(7), labels)).orderBy("doc_id").collect()
    assert [r["score"] for r in again] == [r["score"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_toxicity_does_not_see_held_out_labels(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (tx.score(docs, tx.fit(docs, x)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_toxicity_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(0, 1), (3, None), (None, 1)], "doc_id long, toxic int")):
        rows = tx.score(awkward, tx.fit(awkward, labels)).collect()
        assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert tx.score(empty, tx.fit(empty, none)).count() == 0
    kept = tx.drop_toxic(awkward, none)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


def test_features():
    f = dict(zip(tx.FEATURES, tx.Featurizer({"idiot": 3.0, "^worthl": 2.0})("You 1d1ot, worthless! FINE x.y")))
    assert f["hits"] == 2 and f["top_weight"] == 3.0 and f["near_you"] == 0.5 and f["hits_near_you"] == 2 and f["obfuscated"] > 0
    assert tx.Featurizer({})("") == pytest.approx([0.0] * len(tx.FEATURES))
    assert tx.normal("!!1d-i0t!!") == ("idiot", True) and tx.normal("plain,") == ("plain", False)


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = tx.BoostedTrees(rounds=40).fit(x[:400], y[:400])
    assert ((model.raw(x[400:]) > 0) == (y[400:] > 0)).mean() > 0.93
    raw = rng.normal(size=500)
    knots = tx.isotonic(raw, (rng.random(500) < 1 / (1 + np.exp(-3 * raw))).astype(float))
    assert (np.diff(knots[1]) >= 0).all() and (np.diff(knots[0]) > 0).all()
    assert len(tx.isotonic(np.zeros(0), np.zeros(0))[0]) == 0


def test_languages_on_held_out_rows(spark):
    docs = documents(spark, SF)
    rows = li.identify(docs, li.fit(docs)).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    own = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in own]) > 0.97


def test_language_awkward(spark, awkward, empty):
    rows = li.identify(awkward, li.fit(awkward)).collect()
    assert len(rows) == awkward.count()
    by = {r["doc_id"]: r for r in rows}
    assert (by[0]["lang_pred"], by[0]["score"]) == ("und", 0.0) and by[3]["lang_pred"] == "und" and by[6]["lang_pred"] == "und"
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "und"}
    assert li.identify(empty, li.fit(empty)).count() == 0
    assert all(r["lang_pred"] == "und" for r in li.identify(awkward, li.RankProfiles({})).collect())


def test_profiles_count_out_of_place():
    model = li.RankProfiles({"a": [int(c) for c in li.top_grams("abab abab", 50)], "b": [int(c) for c in li.top_grams("xyxy xyxy", 50)]})
    assert model.predict("abab")[0] == "a" and model.predict("xyxy!")[0] == "b" and model.predict("12 !?") == ("und", 0.0)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6 and m[1].isascii()]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


SECRETS = [
    None, "", "nothing here", 'Äö password = "hunter22" and TOKEN:abcdef', "token:token:abcdefgh secret=short api_key='0123456789'", "AKIA" + "A" * 16, "AKIA" + "B" * 15, "xAKIAAKIA" + "C" * 20,
    "f" * 24 + " " + "0" * 23, "é" * 5 + "deadbeef" * 4 + "Z" + "cafe" * 6, "passwd==aaaaaa token = = abcdefg", "ApI_KeY: ABCDEFGHIJKLMNOP123 PASSWORD:\n123456", "secret=" + "0123456789abcdef" * 3, "token " * 500 + "token=abcdef",
    "apikey=AKIA" + "D" * 16 + " -----BEGIN RSA PRIVATE KEY----- ghp_" + "z" * 36,
]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_spans_equal_plain_regexes(spark, monkeypatch, rows):
    monkeypatch.setattr(ss, "BROADCAST_ROWS", rows)
    df = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["found"]] for r in ss.scan(df).collect()}
    for i, t in enumerate(SECRETS):
        assert [s for s in got[i] if s[1] < 3] == brute_spans(t or ""), t
    assert {ss.RULES[s[1]].kind for s in got[len(SECRETS) - 1]} == {"assign", "access", "private_key", "forge_token"}


def test_scan_awkward(awkward, empty):
    assert ss.scan(awkward).count() == awkward.count() and ss.scan(empty).count() == 0


def test_trigram_queries():
    assert ss.trigram_query("abcd") == frozenset([frozenset(["abc", "bcd"])])
    assert ss.trigram_query("ABC|xyz") == frozenset([frozenset(["abc"]), frozenset(["xyz"])])
    assert ss.trigram_query("ab?cde") == frozenset([frozenset(["acd", "cde"]), frozenset(["abc", "bcd", "cde"])])
    for none in ("[0-9a-f]{24,}", "ab", "(abc)*", "abc|x", "a.c"):
        assert frozenset() in ss.trigram_query(none)
    assert ss.trigram_query("(?:abc)+[0-9]{2,}def") == frozenset([frozenset(["abc", "def"])])


@pytest.mark.parametrize("rule", ss.RULES, ids=lambda r: r.kind)
def test_queries_never_reject_a_match(rule):
    made = {"assign": ["password=abcdef", "API_KEY : 'abcdef'", "apikey:abcdef", "Secret = abcdef", "PASSWD=abcdef", "tOKEN=abcdef"], "access": ["AKIA" + "Q" * 16], "hex": ["a" * 24], "private_key": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"], "forge_token": ["ghs_" + "x" * 36], "chat_token": ["xoxb-1234567890"], "web_token": ["eyJabcdefgh.eyJabcdefgh.abcdefgh"]}[rule.kind]
    for text in made:
        assert re.search(rule.pattern, text)
        low = text.lower()
        assert any(all(g in low for g in s) for s in ss.trigram_query(rule.pattern))


def test_only_letters_count():
    model = li.RankProfiles({"a": [int(c) for c in li.top_grams("abab abab", 50)]})
    assert all(model.predict(t) == ("und", 0.0) for t in ("² ½", "Ⅷ _ 12", "①²³", "​ !")) and model.predict("² b ½")[0] == "a"
    assert li.letters_of("aⅧb²c ½ D") == "a b c d"


def brute_language(profiles, text, size):
    """Nearest profile by the sum of rank differences, in plain Python."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    held = {}
    for word in low.split():
        w = f" {word} "
        for c in word:
            held[c] = held.get(c, 0) + 1
        for n in (2, 3):
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                if n == 2 and g.strip() or n == 3 and g[1] != " ":
                    held[g] = held.get(g, 0) + 1
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    own = [c for c, _ in sorted(((code(g), n) for g, n in held.items()), key=lambda x: (-x[1], x[0]))][:size]
    missing = max([li.PROFILE, *map(len, profiles.values())])
    apart = {lang: sum(min(missing, abs(p.index(c) - i)) if c in p else missing for i, c in enumerate(own)) for lang, p in profiles.items()}
    return min(sorted(apart), key=apart.get), apart


def test_languages_equal_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    model = li.fit(docs)
    profiles = {lang: [int(model.codes[i]) for i in sorted(np.flatnonzero(model.ranks[:, j] < model.missing), key=lambda i: model.ranks[i, j])] for j, lang in enumerate(model.langs)}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in li.identify(docs, model).collect()[::4]:
        text = texts[r["doc_id"]]
        if text and any(c.isalpha() for c in text):
            assert r["lang_pred"] == brute_language(profiles, text, li.DOCUMENT)[0]
        else:
            assert r["lang_pred"] == "und"


def test_scores_equal_a_walk_through_the_trees(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.001"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = tx.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    features = tx.Featurizer(model.lexicon)
    for r in tx.score(docs, model).collect()[::5]:
        x, raw = features(texts[r["doc_id"]]), model.trees.base
        for feature, cut, value in model.trees.trees:
            at = 0
            for _ in range(model.trees.depth):
                j = feature[at]
                at = 2 * at + 1 + (sum(e < x[j] for e in model.trees.edges[j]) > cut[at])
            raw += model.trees.rate * value[at - len(feature)]
        expected = 0.999 * np.interp(raw, *model.knots) + 0.001 / (1 + np.exp(-raw)) if len(model.knots[0]) else 1 / (1 + np.exp(-raw))
        assert abs(r["score"] - min(1, max(0, expected))) < 1e-9


def test_isotonic_equals_the_minimax_formula():
    rng = np.random.default_rng(7)
    raw, y = np.sort(rng.normal(size=40)), (rng.random(40) < 0.5).astype(float)
    at, value = tx.isotonic(raw, y)
    for i in range(40):
        fit = max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1))
        block = [k for k in range(40) if abs(max(min(y[a : b + 1].mean() for b in range(k, 40)) for a in range(k + 1)) - fit) < 1e-12]
        k = int(np.argmin(np.abs(at - raw[block].mean())))
        assert abs(at[k] - raw[block].mean()) < 1e-9 and abs(value[k] - (fit * len(block) + 0.02) / (len(block) + 0.04)) < 1e-9


def test_many_matches_in_a_long_text(spark):
    text = "token=abcdef " * 4000 + "é" + "0123456789abcdef" * 3
    found = ss.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["found"]
    assert [tuple(s) for s in found] == brute_spans(text)
