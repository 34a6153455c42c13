"""Best-fit packing of token sequences in bulk-synchronous supersteps.

Documents are ranged by length and gaps by room. Both are integers up to the sequence length, so the whole control
state is a pair of histograms of at most `capacity` classes, whatever the corpus. A superstep takes all documents of
the largest remaining length at once: a successor sweep finds the smallest gap class that fits, conflicts over it are
resolved by rank (the first so many of the class get the first so many gaps), gaps move to their smaller class, and it
repeats with the documents left over; those that no gap fits open new sequences. The sweeps yield rank intervals, never rows. The
data plane is distributed: tasks number the documents of each length, and each document finds its interval by rank."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_offsets, id_text, per_process, slices, store

CAPACITY, SEPARATOR = 2048, 0
#: Distinct words whose ids a worker process keeps; beyond that it starts anew.
CACHED_WORDS = 300_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet of public BPE vocabularies: printable bytes stand for themselves, the others for 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


def _joins_nothing_over_blanks(spec: dict) -> bool:
    """Whether a tokenizer parts words at white space, drops it, and marks word ends; then words can be encoded singly."""
    steps = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    first = spec["pre_tokenizer"]["pretokenizers"][0] if steps == ["Split", "ByteLevel"] else {}
    norms = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    return spec["model"].get("end_of_word_suffix") == "</w>" and first.get("behavior") == "Removed" and first.get("invert") is True and norms == ["NFC", "Replace", "Lowercase"]


def word_encoder(path: str, cached_words: int = CACHED_WORDS):
    """encode(texts) -> for each text its ids as little-endian unsigned 32-bit bytes.

    A tokenizer that never joins what white space parts gives a text's ids as those of its words in turn: each
    different word is encoded once and looked up from then on. Words of letters only, in lower case, go straight to
    the merges, many at a time, and are parted again by the word-end mark; a comma or stop after a letter is a token of
    its own. All other words pass the whole tokenizer, and so does every text if the tokenizer is of another kind."""
    import json
    import os
    import unicodedata

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    ids_of = lambda texts: [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _joins_nothing_over_blanks(spec):
        return ids_of
    merges = Tokenizer(tokenizer.model)
    merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith("</w>")]] = True
    del spec
    letters = _byte_letters()
    known: dict[str, bytes] = {}

    def plain(w: str) -> bool:
        if w.isascii():
            return w.isalpha() and w.islower()
        return w.isalpha() and w == w.lower() and unicodedata.is_normalized("NFC", w)

    def learn(words: list[str]) -> None:
        fast = [w for w in words if plain(w)]
        rest = [w for w in words if not plain(w)]
        known.update(zip(rest, ids_of(rest)))
        for at in range(0, len(fast), 256):
            some = fast[at : at + 256]
            spelled = " ".join([w if w.isascii() else "".join([letters[b] for b in w.encode()]) for w in some])
            ids = np.array(merges.encode(spelled, add_special_tokens=False).ids, dtype="<u4")
            raw, start = ids.tobytes(), 0
            for w, stop in zip(some, (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()):
                known[w] = raw[start:stop]
                start = stop

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > cached_words:
            known.clear()
        words, counts = [], []
        for t in texts:
            own = (t if "<|" in t else t.encode().lower().decode()).replace("\n", " ").split(" ")  # A-Z are lower-cased either way
            words += own
            counts.append(len(own))
        found = list(map(known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            fresh = {words[i] for i in missing}
            tailed = {w: w[:-1] for w in fresh if w[-1:] in (",", ".") and (c := w[-2:-1]).isalpha() and c == c.lower()}
            learn([w for w in {*(fresh - tailed.keys()), *tailed.values(), ",", "."} if w not in known])
            for w, core in tailed.items():
                known[w] = known[core] + known[w[-1]]
            for i in missing:
                found[i] = known[words[i]]
        out, at = [], 0
        for n in counts:
            out.append(b"".join(found[at : at + n]))
            at += n
        return out

    return encode


def _pieces(path: str, capacity: int, separator: int):
    def run(batches):
        pid, encode, seen = TaskContext.get().partitionId(), per_process(("encoder", path), lambda: word_encoder(path)), np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([separator], dtype="<u4").tobytes()
        for part in slices(batches):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start : start + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, piece, start // 4, n, zlib.crc32(own), pid, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "_pid", "_idx"])

    return run


def plan_sequences(lengths: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Best-fit decreasing over a histogram. Returns, per length, intervals (first rank, first sequence, documents per
    sequence, offset in the sequence), and the number of sequences."""
    gaps: dict[int, deque] = {}  # room -> ranges of sequences (first, count)
    rooms: list[int] = []  # sorted
    plan, opened = {}, 0

    def put(room: int, first: int, count: int) -> None:
        if room == 0 or count == 0:
            return
        if room not in gaps:
            gaps[room] = deque()
            rooms.insert(bisect_right(rooms, room), room)
        if gaps[room] and sum(gaps[room][-1]) == first:
            gaps[room][-1] = (gaps[room][-1][0], gaps[room][-1][1] + count)
        else:
            gaps[room].append((first, count))

    for n in sorted(lengths, reverse=True):
        left, rank, steps = lengths[n], 0, []
        while left:
            at = bisect_right(rooms, n - 1)  # successor: the smallest room that fits
            if at < len(rooms):
                room = rooms[at]
                first, count = gaps[room].popleft()
                take = min(left, count)
                if take < count:
                    gaps[room].appendleft((first + take, count - take))
                elif not gaps[room]:
                    del gaps[room], rooms[at]
                steps.append((rank, first, 1, capacity - room))
                put(room - n, first, take)
            else:
                each = capacity // n
                full, rest = divmod(left, each)
                take = left
                steps.append((rank, opened, each, 0))
                put(capacity - each * n, opened, full)
                if rest:
                    put(capacity - rest * n, opened + full, 1)
                opened += full + (rest > 0)
            left -= take
            rank += take
        plan[n] = steps
    return plan, opened


def _assign(plan):
    def run(batches):
        table = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*steps)) for n, steps in plan.value.items()}
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts):
                if not len(rows):
                    continue
                n = int(length[rows[0]])
                first, at, each, begin = table[n]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                j = rank[rows] - first[k]
                sequence[rows] = at[k] + j // each[k]
                offset[rows] = begin[k] + (j % each[k]) * n
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): the place of every document, cut into pieces only
    where longer than `capacity`, in sequences of at most that many tokens.

    A document is its ids and then the separator, so a null or empty text is one token. Repeated rows are packed
    singly; a null doc_id stays null. An empty table gives an empty result. The plan that is sent to tasks has a few
    intervals for each of at most `capacity` lengths."""
    cut = id_text(docs, id_col, text_col).mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, separator), "doc_id long, piece int, start long, length long, ids_crc32 long, _pid int, _idx long")
    pieces = store(cut, "pieces")
    lengths = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = docs.sparkSession.sparkContext.broadcast(plan_sequences(lengths, capacity)[0])
    ranked = pieces.join(dense_offsets(pieces, "length"), ["_pid", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_idx")).alias("_rank"))
    return ranked.mapInArrow(_assign(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
