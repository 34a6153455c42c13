"""Secret scans over a trigram inverted index (Cox 2012). DataFrame operations only.

Each rule's regex is compiled into a Boolean query: an OR of sets of trigrams, one of which a text must hold whole for
the rule to match. The index has postings (trigram, doc_id) of every trigram that a query names. Postings are
intersected per set, the sets of a rule united, and only candidates are verified by the regex. A rule without a
mandatory trigram scans every text."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, store

#: Documents with candidate rules are sent to the tasks up to this many rows (about 40 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Exact strings that a sub-expression may have before they become trigrams.
EXACT_LIMIT = 32
#: Matches whose spans are gathered at a time: lists grow by copying, so a text with many matches is taken in parts.
PART = 256


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: a regex that Java and Python read alike; group, least: code points that a group must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The contract's kinds, in its order. A run of 24 hex digits or 20 characters is maximal either way, so the length stands in the pattern.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: More kinds of credentials with published formats.
MORE_RULES = (
    Rule("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
_ALL = frozenset([frozenset()])


def _least(sets) -> frozenset:
    """A disjunction without sets that another one implies."""
    return frozenset(s for s in sets if not any(o < s for o in sets))


def _both(a: frozenset, b: frozenset) -> frozenset:
    made = _least({x | y for x in a for y in b})
    return made if len(made) <= EXACT_LIMIT else max(a, b, key=lambda q: min(map(len, q)))


def _trigrams(strings: frozenset) -> frozenset:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _analyse(tree) -> tuple[frozenset | None, frozenset]:
    """(all strings it can match in lower case, or None; its query)."""
    query, exact, open_ended = _ALL, frozenset([""]), False
    for op, arg in tree:
        own, need = _one(op, arg)
        crossed = None if own is None else frozenset(a + b for a in exact for b in own)
        if crossed is not None and len(crossed) <= EXACT_LIMIT:
            exact = crossed
            continue
        query = _both(_both(query, _trigrams(exact)), _trigrams(own) if own is not None else need)
        exact, open_ended = frozenset([""]), True
    return (None, _both(query, _trigrams(exact))) if open_ended else (exact, _trigrams(exact))


def _one(op, arg) -> tuple[frozenset | None, frozenset]:
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()]), _ALL
    if op is sre.IN:
        chars = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 4:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, _ALL
        return (frozenset(chars), _ALL) if len(chars) <= 6 else (None, _ALL)
    if op is sre.SUBPATTERN:
        return _analyse(arg[3])
    if op is sre.BRANCH:
        parts = [_analyse(t) for t in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= EXACT_LIMIT:
            return frozenset().union(*(e for e, _ in parts)), _ALL
        return None, _least({s for e, q in parts for s in (q if e is None else _trigrams(e))})
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, inner = arg
        own, need = _analyse(inner)
        if own is not None and (low, high) == (0, 1):
            return own | {""}, _ALL
        if own is not None and low == high and len(own) ** low <= EXACT_LIMIT:
            strings = frozenset([""])
            for _ in range(low):
                strings = frozenset(a + b for a in strings for b in own)
            return strings, _ALL
        return None, (_ALL if low == 0 else _trigrams(own) if own is not None else need)
    return None, _ALL


def trigram_query(pattern: str) -> frozenset:
    """Sets of lower-case trigrams; a text that matches the pattern holds all of at least one. An empty set: no demand."""
    return _analyse(sre_parser.parse(pattern))[1]


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start,kind_at,end>> of a rule's leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between the matches give their places. kind_at is the rule's place in RULES."""
    empty = F.array().cast("array<struct<start:long,kind_at:int,end:long>>")
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, rule.pattern, -1).alias("piece"), found.alias("match"))
    ok = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)

    def step(acc, x):
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(RULES.index(rule)).alias("kind_at"), end.alias("end"))
        spans = F.when(x["match"].isNotNull() & ok(x["match"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), acc["lists"].alias("lists"), spans.alias("spans"))

    def part(acc, at):
        begin = F.struct(acc["at"].alias("at"), acc["lists"].alias("lists"), empty.alias("spans"))
        own = F.slice(pairs, at * PART + 1, F.lit(PART))
        return F.aggregate(own, begin, step, lambda a: F.struct(a["at"].alias("at"), F.concat(a["lists"], F.array(a["spans"])).alias("lists")))

    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(found) + PART) / PART).cast("int") - 1))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:long,kind_at:int,end:long>>>").alias("lists"))
    gathered = F.flatten(F.aggregate(parts, none, part, lambda acc: acc["lists"]))
    return F.when(text.rlike(rule.pattern), gathered).otherwise(empty)


def build_postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id): the inverted index over the trigrams that queries name; gram is the place in grams."""
    low = texts.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    return store(low.select(F.explode(held).alias("gram"), "doc_id").sortWithinPartitions("gram"), "postings")


def candidates(postings: DataFrame, grams: list[str], queries: dict[int, frozenset]) -> DataFrame:
    """(doc_id, rules): bit i of rules is set if the postings allow rule i. Postings are combined map-side."""
    spark = postings.sparkSession
    sets = [(r, c, s) for r, q in queries.items() for c, s in enumerate(sorted(q, key=sorted))]
    rows = [(grams.index(g), r, c, 1 << k, (1 << len(s)) - 1) for r, c, s in sets for k, g in enumerate(sorted(s))]
    wanted = F.broadcast(spark.createDataFrame(rows, "gram int, rule int, part int, bit long, full long"))  # one row per trigram of a rule
    met = postings.join(wanted, "gram").groupBy("doc_id", "rule", "part").agg(F.bit_or("bit").alias("bits"), F.first("full").alias("full")).where("bits = full")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found): one row per row of docs; found is array<struct<start,kind_at,end>> by start, kind_at.

    A null text is empty. Rows that repeat a doc_id share candidates, and each is verified by itself. A null doc_id is
    looked up like any other. An empty table gives an empty result."""
    texts = id_text(docs, id_col, text_col)
    queries = {RULES.index(r): q for r in rules if frozenset() not in (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for s in q for g in s})
    if grams:
        flags = store(candidates(build_postings(texts, grams), grams, queries).select(F.col("doc_id").alias("_doc"), "rules"), "candidates")
        small = flags.count() <= BROADCAST_ROWS
        texts = texts.join(F.broadcast(flags) if small else flags, texts["doc_id"].eqNullSafe(flags["_doc"]), "left")
    else:
        texts = texts.withColumn("rules", F.lit(0).cast("long"))
    empty = F.array().cast("array<struct<start:long,kind_at:int,end:long>>")
    parts = []
    for r in rules:
        at = RULES.index(r)
        allowed = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << at)) != 0
        parts.append(F.when(allowed, spans_of(F.col("text"), r)).otherwise(empty) if at in queries else spans_of(F.col("text"), r))
    return texts.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def joined(found: Column, below: int | None = None) -> Column:
    """kind:start:end of the spans, comma-joined; with `below`, of the first so many kinds."""
    kept = found if below is None else F.filter(found, lambda s: s["kind_at"] < below)
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind_at"] + 1), s["start"], s["end"])), ",")
