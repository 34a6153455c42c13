"""Exact dedup, line dedup, sharding and packing against brute force, with awkward rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.llm import exact_dedup as ex
from ionweave.llm import line_dedup as ld
from ionweave.llm import packing as pk
from ionweave.llm import sharding as sh

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("bits,capacity", [(64, 16_384), (3, 2), (64, 1)])
def test_exact_duplicates(awkward, bits, capacity):
    groups = defaultdict(list)
    rows = rows_of(awkward)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    expected = []
    for d, t in rows:
        low = (t or "").translate(LOWER)
        keep = max((x for x in groups[low] if x is not None), default=None)
        expected.append((d, keep, len(groups[low]), d == keep, hashlib.sha256(low.encode()).hexdigest()))
    got = [tuple(r) for r in ex.exact_duplicates(awkward, capacity=capacity, max_depth=4, hash_bits=bits).collect()]
    assert Counter(got) == Counter(expected)


def test_exact_dedup_of_nothing_and_kept_rows(awkward, empty):
    assert ex.exact_duplicates(empty).count() == 0
    kept = ex.keep_exact(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 12").count() == 1


def test_directory_doubles_and_splits():
    depth, directory = ex.grow_directory({0: 5, 1: 1, 8: 1}, 4, 4)
    assert depth == 4 and len(directory) == 16 and directory[0] != directory[1] and len(set(directory[8:])) == 1
    assert ex.grow_directory({}, 4, 4) == (0, [0])
    depth, directory = ex.grow_directory({3: 1000}, 4, 4)  # one key cannot be split: its bucket grows
    assert depth == 4 and directory.count(directory[3]) == 1


def brute_lines(rows, min_chars=40, min_docs=5):
    blanks = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    key = lambda line: line.strip(blanks).translate(LOWER)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and d is not None:
                holders[key(line)].add(d)
    frequent = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in frequent and (d is None or d < frequent[key(x)]))]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(awkward, empty):
    rows = rows_of(awkward)
    got = [tuple(r) for r in ld.dedup_lines(awkward).collect()]
    expected = brute_lines(rows)
    assert Counter(got) == Counter(expected) and sum(r[3] for r in got) > 5
    assert ld.dedup_lines(empty).count() == 0
    replaced = ld.replace_lines(awkward)
    assert replaced.columns == awkward.columns
    assert Counter((d, t or "") for d, t in rows_of(replaced)) == Counter((d, t) for d, t, _, _ in expected)


def test_line_dedup_with_many_filters(awkward, monkeypatch):
    expected = Counter(tuple(r) for r in ld.dedup_lines(awkward).collect())
    monkeypatch.setattr(ld, "SHARD_KEYS", 1)
    monkeypatch.setattr(ld, "SALTS", 3)
    assert Counter(tuple(r) for r in ld.dedup_lines(awkward).collect()) == expected


def test_line_index_is_reversible(spark):
    line = "a line that is shared and is longer than forty characters"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(6)], "doc_id long, text string")
    first = docs.where("doc_id < 4")
    index = ld.LineIndex.of(first)
    assert index.frequent.count() == 0
    more = index.insert(docs.where("doc_id >= 4"))
    assert [tuple(r) for r in more.frequent.select("n_docs", "max_doc").collect()] == [(6, 5)]
    less = more.delete(spark.createDataFrame([(5,), (4,)], "doc_id long"))
    assert sorted(less.refs.collect()) == sorted(index.refs.collect()) and less.frequent.count() == 0
    assert less.apply(first).agg(F.sum("n_dropped")).first()[0] == 0


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(20_000)]
    made = ld.CuckooFilter.from_bytes(ld.CuckooFilter.of(keys[:10_000]).to_bytes())
    assert all(k in made for k in keys[:10_000]) and made.held(keys[:10_000]).all()
    assert made.held(keys[10_000:]).mean() < 0.01
    assert made.delete(keys[0])
    assert sum(k in made for k in keys[1:10_000]) == 9_999


def test_shards(awkward, empty):
    rows = awkward.select("doc_id", "text").collect()
    got = sh.assign_shards(awkward).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 15}) == 1
    assert sh.assign_shards(empty).count() == 0


def test_jump_hash_moves_only_what_it_must(awkward, tmp_path):
    keys = sh.mix64(np.arange(40_000))
    before = sh.jump_hash(keys, 8)
    for n in range(1, 12):
        here, after = sh.jump_hash(keys, n), sh.jump_hash(keys, n + 1)
        assert ((here == after) | (after == n)).all() and abs((after == n).mean() - 1 / (n + 1)) < 0.02
    assert np.bincount(before, minlength=8).max() / 5000 < 1.06
    assert sh.jump_hash(np.array([0, 1, 2], dtype=np.uint64), 1).tolist() == [0, 0, 0]
    sh.write_shards(awkward, str(tmp_path / "out"), 3)
    assert awkward.sparkSession.read.parquet(str(tmp_path / "out")).count() == awkward.count()


def check_packing(got, rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pk.default_tokenizer())
    expected = Counter()
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            expected[d, k, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(awkward, capacity):
    rows = rows_of(awkward)
    check_packing(pk.pack(awkward, capacity=capacity).collect(), rows, capacity)


def test_packing_of_nothing(empty):
    assert pk.pack(empty).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 101, rng.integers(1, 400)).tolist()
        gaps = []
        for n in sorted(lengths, reverse=True):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(100 - n)
        plan, opened = pk.plan_sequences(Counter(lengths), 100)
        assert opened == len(gaps)
        used = defaultdict(int)
        for n, count in Counter(lengths).items():
            steps = plan[n]
            for rank in range(count):
                first, at, each, begin = [s for s in steps if s[0] <= rank][-1]
                used[at + (rank - first) // each] += n
        assert len(used) == opened and max(used.values()) <= 100


def test_word_encoder_equals_the_tokenizer():
    import random

    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = pk.default_tokenizer().replace("word_bpe_49k.json", name)
        encode, tokenizer = pk.word_encoder(path, 50), Tokenizer.from_file(path)
        rng = random.Random(1)
        texts = ["".join(rng.choices("abé́Aİςσ.,' \n\t|<>1-ñßΣ", k=rng.randrange(30))) for _ in range(3000)] + ["a <|ENDOFTEXT|> b <|endoftext|>c", "x.. ,, don't, it's."]
        assert encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_line_index_changes_only_what_it_must(spark, monkeypatch):
    """Many insertions and deletions leave the index as if built anew; shards without a change keep their filters."""
    monkeypatch.setattr(ld, "SHARD_KEYS", 4)
    line = lambda k: f"line number {k} is shared and is longer than forty characters"
    rows = [(d, "\n".join(line(k) for k in range(40) if (d * 7 + k * k) % 11 < 4)) for d in range(30)]
    frame = lambda ids: spark.createDataFrame([rows[d] for d in ids], "doc_id long, text string")
    index = ld.LineIndex.of(frame(range(20)))
    assert index.shards > 3
    old = {r["shard"]: bytes(r["filter"]) for r in index.filters.collect()}
    one = index.insert(spark.createDataFrame([(99, line(0))], "doc_id long, text string"))
    new = {r["shard"]: bytes(r["filter"]) for r in one.filters.collect()}
    assert sum(old.get(s) != new.get(s) for s in old.keys() | new.keys()) <= 1
    index = one.delete(spark.createDataFrame([(99,), (3,), (4,), (500,)], "doc_id long")).insert(frame([*range(20, 30), 5])).insert(frame([3]))
    left = [d for d in range(30) if d != 4]
    fresh = ld.LineIndex.of(frame(left))
    state = lambda i: sorted(tuple(r) for r in i.frequent.select(F.hex("key"), "n_docs", "max_doc").collect())
    assert state(index) == state(fresh) and sorted(index.refs.collect()) == sorted(fresh.refs.collect())
    filters = {r["shard"]: ld.CuckooFilter.from_bytes(bytes(r["filter"])) for r in index.filters.collect()}
    for r in index.frequent.withColumn("shard", ld._shard_column(index.shards)).collect():
        assert bytes(r["key"]) in filters[r["shard"]]
    got = Counter(tuple(r) for r in index.apply(frame(left)).collect())
    assert got == Counter(brute_lines([rows[d] for d in left])) and got == Counter(tuple(r) for r in index.apply(frame(left), index.references()).collect())


def test_filters_are_asked(spark, monkeypatch):
    """Without its filter a shard's lines are taken for rare: the filters stand in the way of every line."""
    text = "a line that is shared and is longer than forty characters"
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    index = ld.LineIndex.of(docs)
    assert index.apply(docs).agg(F.sum("n_dropped")).first()[0] == 5
    index.filters = index.filters.where("false")
    assert index.apply(docs).agg(F.sum("n_dropped")).first()[0] == 0


def test_owners_hold_their_key_range(awkward):
    """Each bucket's file holds one range of hashes, every text once, chained where hashes collide."""
    from ionweave.llm.common import id_text

    for hot in (0, 64):
        log, index = ex.build_index(id_text(awkward), capacity=2, max_depth=6, hash_bits=4, hot_rows=hot)
        rows = [r for r in index.collect()]
        texts = {(r["text"] or "").translate(LOWER) for r in awkward.collect()}
        assert len(rows) == len({r["digest"] for r in rows}) == len(texts) and max(r["chain"] for r in rows) > 1
        ranges = defaultdict(set)
        for r in rows:
            ranges[r["bucket"]].add((r["hash"] & (1 << 64) - 1) >> 58)
        ordered = sorted(ranges.values(), key=min)
        assert len(ordered) > 2 and all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))
        assert {(r["bucket"], r["hash"]) for r in log.collect()} == {(r["bucket"], r["hash"]) for r in rows}


def test_clashing_names(awkward, tmp_path):
    odd = awkward.select("*", *(F.lit("x").alias(c) for c in ("_id", "_line_doc", "_line_drop", "id", "row", "drop", "d", "_drop", "_digest")))
    for out in (ld.replace_lines(odd), ex.keep_exact(odd)):
        assert out.columns == odd.columns and 0 < out.count() <= odd.count()
    sh.write_shards(odd, str(tmp_path / "out"), 3)
    back = odd.sparkSession.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*odd.columns, "_shard"} and back.count() == odd.count()
    with pytest.raises(ValueError):
        sh.write_shards(odd.withColumn("_shard", F.lit(1)), str(tmp_path / "no"), 3)
    sh.write_shards(odd.withColumn("_shard", F.lit(1)), str(tmp_path / "yes"), 3, shard_name="piece")
