"""Secret scans over a trigram inverted index, native.

Each rule's regular expression is turned into a Boolean query over trigrams
that any match must contain. The index holds a posting (trigram, document) for
every trigram that some query asks for; postings are intersected into the
candidates of each rule, and only candidates are searched with the expression
itself. Rules without a mandatory trigram search every text.

Null and empty texts have no spans. Postings are by doc_id: rows that share one
are candidates together, and each is verified on its own text; null doc_ids
likewise. An empty table gives an empty result. Other columns are ignored.
Spans are in code points, end exclusive."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable

#: Sets of strings larger than this are no longer followed.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    shortest: int
    group: int = 0


#: Fixed values of the contract, in the order of kinds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)

Clause = frozenset[frozenset[str]]


def _trigrams(text: str) -> frozenset[str]:
    low = text.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def _clause(strings: set[str]) -> Clause | None:
    """Any of the strings' trigrams, all of them; None says nothing."""
    options = {_trigrams(s) for s in strings}
    if frozenset() in options:
        return None
    return frozenset(a for a in options if not any(b < a for b in options))


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that all hold where the pattern matches; each clause is a set of
    alternatives, each a set of trigrams that occur together."""
    clauses: list[Clause] = []

    def note(strings: set[str]) -> None:
        if (clause := _clause(strings)) is not None and clause not in clauses:
            clauses.append(clause)

    def exact(items: object) -> set[str] | None:
        """All strings that a part can match, if they are few."""
        found = {""}
        for kind, value in items:  # type: ignore[attr-defined]
            more = one(kind, value)
            if more is None or len(found) * len(more) > MOST_STRINGS:
                return None
            found = {a + b for a in found for b in more}
        return found

    def one(kind: object, value: object) -> set[str] | None:
        if kind is sre.LITERAL and value < 128:
            return {chr(value)}
        if kind is sre.IN:
            found: set[str] = set()
            for what, x in value:
                if what is sre.LITERAL and x < 128:
                    found.add(chr(x))
                elif what is sre.RANGE and x[1] < 128 and x[1] - x[0] < 8:
                    found.update(map(chr, range(x[0], x[1] + 1)))
                else:
                    return None
            return found
        if kind is sre.SUBPATTERN:
            return exact(value[-1])
        if kind is sre.BRANCH:
            parts = [exact(x) for x in value[1]]
            return None if None in parts else set().union(*parts)  # type: ignore[arg-type]
        if kind is sre.MAX_REPEAT and value[1] <= 3:
            inner = exact(value[2])
            if inner is None:
                return None
            found = set()
            for times in range(value[0], value[1] + 1):
                grown = {""}
                for _ in range(times):
                    grown = {a + b for a in grown for b in inner}
                    if len(grown) > MOST_STRINGS:
                        return None
                found |= grown
            return found
        return None

    def walk(items: object) -> None:
        run = {""}
        for kind, value in items:  # type: ignore[attr-defined]
            more = one(kind, value)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            note(run)
            run = more if more is not None else {""}
            if kind is sre.SUBPATTERN:
                walk(value[-1])
            elif kind is sre.MAX_REPEAT and value[0] >= 1:
                walk(value[2])
        note(run)

    walk(parser.parse(pattern))
    return clauses


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key): the trigram's place in the list, the document."""
    low = ascii_lower(F.coalesce("text", F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(trigrams)]))
    return docs.select(_key(), low.alias("low")).select("key", F.explode(held).alias("trigram"))


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")


def candidates(index: DataFrame, trigrams: list[str], queries: dict[str, list[Clause]]) -> DataFrame:
    """(key, one Boolean per rule): the postings of a document meet in one set
    of bits, on which each query is evaluated."""
    words = -(-len(trigrams) // 63) or 1
    bits = [
        F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, F.expr("shiftleft(1L, trigram % 63)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}")
        for w in range(words)
    ]
    place = {t: i for i, t in enumerate(trigrams)}

    def together(option: frozenset[str]) -> Column:
        test = F.lit(True)
        for w in range(words):
            mask = sum(1 << place[t] % 63 for t in option if place[t] // 63 == w)
            if mask:
                test = test & (F.col(f"w{w}").bitwiseAND(F.lit(mask)) == mask)
        return test

    def holds(clauses: list[Clause]) -> Column:
        test = F.lit(True)
        for clause in clauses:
            some = F.lit(False)
            for option in sorted(clause, key=sorted):
                some = some | together(option)
            test = test & some
        return test

    found = index.groupBy("key").agg(*bits).select("key", *[holds(q).alias(kind) for kind, q in queries.items()])
    return found.filter(" or ".join(f"`{kind}`" for kind in queries))


SPANS = "array<struct<start:int,place:int,stop:int>>"
#: Matches whose places are summed up together.
BLOCK = 256


def _running(steps: Column, first: Column, step: Callable[[Column], Column]) -> Column:
    """Before each of an array's items, first and the sum of `step` over the items
    before it. What is appended to stays as short as the array."""
    start = F.struct(first.cast("long").alias("at"), F.array().cast("array<long>").alias("found"))
    add = lambda state, x: F.struct((state["at"] + step(x)).alias("at"), F.array_append(state["found"], state["at"]).alias("found"))
    return F.aggregate(steps, start, add, lambda state: state["found"])


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, stop>> of the rule's matches, leftmost and not
    overlapping, those that are too short dropped. Where they start is summed up
    in blocks, so that many matches in a text take little more than their number."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    rows = F.transform(
        F.arrays_zip(matches.alias("m"), tested.alias("t"), F.slice(between, F.lit(1), F.size(matches)).alias("b")),
        lambda x: F.struct(
            F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["t"]) >= rule.shortest).alias("ok")
        ),
    )
    length = lambda x: (x["gap"] + x["size"]).cast("long")
    whole = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda sum_, x: sum_ + length(x))

    def blocks_of(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK)), lambda b: F.slice(rows, (b * BLOCK + 1).cast("int"), BLOCK))

    def placed(block: Column, first: Column) -> Column:
        each = F.arrays_zip(block.alias("x"), _running(block, first, length).alias("at"))
        start = lambda e: (e["at"] + e["x"]["gap"]).cast("int")
        span = lambda e: F.struct(start(e).alias("start"), F.lit(place).alias("place"), (start(e) + e["x"]["size"]).alias("stop"))
        return F.transform(F.filter(each, lambda e: e["x"]["ok"]), span)

    def summed(blocks: Column) -> Column:
        dealt = F.arrays_zip(blocks.alias("block"), _running(blocks, F.lit(0), whole).alias("first"))
        return F.flatten(F.transform(dealt, lambda d: placed(d["block"], d["first"])))

    found = _once(_once(rows, blocks_of), summed)
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPANS))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which value is computed a single time."""
    return F.transform(F.array(value), use)[0]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and spans, an array of (start, place of the rule, stop) in order."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: q for kind, q in queries.items() if q}
    trigrams = sorted({t for q in indexed.values() for clause in q for option in clause for t in option})
    found = durable(candidates(build_index(docs, trigrams), trigrams, indexed))
    texts = docs.select("doc_id", _key(), F.coalesce("text", F.lit("")).alias("text")).join(found.hint("merge"), "key", "left")
    none = F.array().cast(SPANS)
    each = []
    for place, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, place)
        each.append(F.when(F.coalesce(rule.kind, F.lit(False)), spans).otherwise(none) if rule.kind in indexed else spans)
    return texts.select("doc_id", F.array_sort(F.flatten(F.array(*each))).alias("spans"))


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["place"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
