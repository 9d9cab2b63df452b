"""Near copies by SimHash, and by an exact set-similarity join with prefix filters
for those that it misses.

Two texts are near copies when their sets of five-word shingles have a Jaccard
similarity of at least 4/5. Texts whose SimHash fingerprints of those shingles
are alike or within DISTANCE bits come first: links that connect all of them are
verified, and those that hold are the first groups. Many near copies have
fingerprints further apart, so all texts go through an exact join too, which
compares what is not in one group yet.

Shingles are put in one order; of n shingles the
first n - ceil(4n/5) + k, with k = 1 + n / 20, are listed. Two texts whose
similarity is high enough share at least the lesser k of their listed shingles,
whatever the order is, so no pair is missed. The order puts shingles that a
sample of texts shows to be frequent last, which only saves work.

In each listed shingle's bucket the texts are first held against a few heads,
picked by hash. Then the texts outside a bucket's largest component by that time
are held against all others in it. A pair comes out of that join only if the
parity bits of the two texts' shingles allow it: shared shingles cancel out, so
the bits that differ are at most as many as the shingles that only one text has.
It does not come out where the EARLIER listed shingles of the two have one in
common, as they meet at that one, or before it, too: a pair that shares hundreds
of shingles gives a few rows. More parity bits, of the pairs alone, then tell long
texts apart. So a cluster of many near copies gives about as many pairs as it has
members, and no near pair is lost. Every pair is verified on the shingles
themselves before it links anything, and connected components of verified pairs
are the groups.

Null and empty texts have one shingle, the empty one; a text of fewer words
than a shingle is one shingle. A null doc_id stays only where all are null, and
rows that share text and doc_id stay together. An empty table gives an empty
result. A text is named by 64 bits of hash."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Filter, at_rest, connected_components, durable, in_small_batches, kept, lookup

#: Least similarity, as a fraction.
ABOVE, BELOW = 4, 5
SHINGLE = 5
#: Bits in which the fingerprints of SimHash's candidates differ at most.
DISTANCE = 7
#: A text of n shingles has to share 1 + n / STEP listed ones.
STEP = 20
#: Members of a bucket that the others are first held against.
HEADS = 4
#: Texts that the frequent shingles are guessed from, in how many of them a
#: frequent one is, and how many are told to the workers.
SAMPLE, FREQUENT, TOLD = 5_000, 3, 10_000
#: Words whose hashes a task keeps.
CACHED = 100_000
#: Longs of parity bits of a text in the join, and of one in a pair.
PARITY, FINE = 16, 128
#: Listed shingles before its own that a row of the join knows.
EARLIER = 16
#: Links that one task may put in groups.
FEW = 50_000
#: Odd numbers that spread bits.
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes) -> set[bytes]:
    words = text.lower().split()
    if len(words) < SHINGLE:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(SHINGLE)), strict=False)))


def are_near(a: set[bytes], b: set[bytes]) -> bool:
    shared = len(a & b)
    return BELOW * shared >= ABOVE * (len(a) + len(b) - shared)


def _words() -> dict[bytes, int]:
    """Hashes of words that a worker's task has seen."""
    return kept("near_copies")


def hashes(text: bytes) -> np.ndarray:
    """64 bits of each distinct shingle, sorted; made of the words' own."""
    import xxhash

    hashed, seen = xxhash.xxh64_intdigest, _words()
    words = text.lower().split()
    if len(seen) > CACHED:
        seen.clear()
    for word in set(words).difference(seen):
        seen[word] = hashed(word, 42)
    each = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    span = min(SHINGLE, len(words))
    found = np.full(max(1, len(words) - span + 1), span, np.uint64)
    for i in range(span):
        found = found * _MULTIPLY + each[i : len(each) - span + 1 + i]
    found = (found ^ (found >> np.uint64(31))) * _MIX
    return np.unique((found ^ (found >> np.uint64(29))).view(np.int64))


def parities(found: np.ndarray, longs: int = PARITY) -> np.ndarray:
    """Longs of bits, each bit set if an odd number of the hashes fall to it."""
    place = found.view(np.uint64) & np.uint64(64 * longs - 1)
    odd = np.bincount(place.astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


class Frequent:
    """Hashes that come last in the order, each with its place among them."""

    def __init__(self, found: np.ndarray):
        self.sorted = np.sort(found)
        self.place = np.argsort(found, kind="stable")

    def places(self, found: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for those that aren't frequent."""
        if not len(self.sorted):
            return np.full(len(found), -1)
        at = np.minimum(np.searchsorted(self.sorted, found), len(self.sorted) - 1)
        return np.where(self.sorted[at] == found, self.place[at], -1)


def listed(found: np.ndarray, frequent: Frequent) -> np.ndarray:
    """The first of a text's sorted hashes: rare before frequent ones, whose
    order is the one in which they are given."""
    n = len(found)
    take = n - (ABOVE * n + BELOW - 1) // BELOW + 1 + n // STEP
    places = frequent.places(found)
    late = places >= 0
    early = found[~late][:take]
    if len(early) == take:
        return early
    return np.concatenate([early, found[late][np.argsort(places[late])][: take - len(early)]])


def named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("node"), text.alias("text"))


def frequent_shingles(texts: DataFrame) -> Frequent:
    """Hashes that many of a sample share, rarest first; TOLD at most."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes(t.as_py().encode()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["h"])

    every = max(1, texts.count() // SAMPLE)
    few = in_small_batches(texts.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(every)) == 0)).select("text")
    seen = few.mapInArrow(at_rest(read), "h long").groupBy("h").count().filter(F.col("count") >= FREQUENT)
    most = seen.orderBy(F.desc("count"), "h").limit(TOLD).collect()
    return Frequent(np.array([h for h, _ in reversed(most)], np.int64))


def entries(texts: DataFrame, frequent: Frequent) -> DataFrame:
    """h, node and n: each text's listed hashes and its number of shingles."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes(t.as_py().encode()) for t in batch.column(1)]
            lists = [listed(x, frequent) for x in found]
            sizes = [len(x) for x in lists]
            h = np.concatenate([np.zeros(0, np.int64), *lists])
            node = np.repeat(batch.column(0).to_numpy(), sizes)
            n = np.repeat(np.array([len(x) for x in found], np.int32), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(node), pa.array(n)], names=["h", "node", "n"])

    return in_small_batches(texts).select("node", "text").mapInArrow(at_rest(read), "h long, node long, n int")


def parity_bits(texts: DataFrame) -> DataFrame:
    """node and p0, p1, ...: the parity bits of each text's shingles."""
    names = [f"p{i}" for i in range(PARITY)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([parities(hashes(t.as_py().encode())) for t in batch.column(1)], np.int64).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(bits[:, i]) for i in range(PARITY))], names=["node", *names])

    return in_small_batches(texts).select("node", "text").mapInArrow(at_rest(read), "node long, " + ", ".join(f"{n} long" for n in names))


def alike(m: Column, n: Column) -> Column:
    return F.least(m, n) * BELOW >= F.greatest(m, n) * ABOVE


def may_be_near(x: str, y: str) -> Column:
    """False where more shingles differ than near copies of these sizes can have."""
    differing = [F.bit_count(F.col(f"p{i}{x}").bitwiseXOR(F.col(f"p{i}{y}"))) for i in range(PARITY)]
    return (F.col(f"n{x}") + F.col(f"n{y}")) * (BELOW - ABOVE) >= reduce(lambda a, b: a + b, differing) * (BELOW + ABOVE)


def enough(n: Column) -> Column:
    return 1 + F.floor(n / STEP)


def once(rows: DataFrame) -> DataFrame:
    """rows (h, node, ...) with `earlier`, the node's last EARLIER lesser h in them."""
    before = Window.partitionBy("node").orderBy("h").rowsBetween(-EARLIER, -1)
    return rows.withColumn("earlier", F.collect_list("h").over(before))


def unmet() -> Column:
    """False where the two sides of a join on h have met at an earlier one."""
    return ~F.arrays_overlap("earlierx", "earliery")


def possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose FINE longs of parity bits allow that they are near."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes(t.as_py().encode()) for t in batch.column(1)]
            bits = pa.array([parities(x, FINE).tobytes() for x in found], pa.binary())
            n = pa.array([len(x) for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, bits], names=["node", "n", "bits"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, m, x, n, y = batch.columns
            odd = [int.from_bytes(u.as_py()) ^ int.from_bytes(v.as_py()) for u, v in zip(x, y, strict=True)]
            differing = np.fromiter((o.bit_count() for o in odd), np.int64, len(odd))
            both = m.to_numpy().astype(np.int64) + n.to_numpy()
            fits = pa.array(both * (BELOW - ABOVE) >= differing * (BELOW + ABOVE))
            yield pa.RecordBatch.from_arrays([a.filter(fits), b.filter(fits)], names=["a", "b"])

    ends = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    told = in_small_batches(lookup(texts, ends, "node", "left_semi").select("node", "text"))
    told = durable(told.mapInArrow(at_rest(read), "node long, n int, bits binary"))
    left = durable(lookup(pairs, told.toDF("a", "m", "x"), "a", "inner"))
    both = lookup(left, told.toDF("b", "n", "y"), "b", "inner").select("a", "b", "m", "x", "n", "y")
    return durable(in_small_batches(both).mapInArrow(at_rest(compare), "a long, b long"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are near copies."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2), batch.column(3), strict=True)
            near = [are_near(shingles(x.as_py().encode()), shingles(y.as_py().encode())) for x, y in sides]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    left = durable(lookup(pairs, texts.toDF("a", "x"), "a", "inner"))
    both = lookup(left, texts.toDF("b", "y"), "b", "inner").select("a", "b", "x", "y")
    return durable(in_small_batches(both).mapInArrow(at_rest(read), "a long, b long"))


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all texts whose fingerprints link."""
    prints = simhash.fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), SHINGLE)
    prints = durable(prints.select(F.col("doc_id").alias("node"), "fp").distinct())
    classes = durable(prints.groupBy("fp").agg(F.min("node").alias("a")))
    same = lookup(prints.withColumnRenamed("node", "b"), classes, "fp", "inner").filter("a <> b").select("a", "b")
    found = durable(simhash.spanning(durable(classes.select("fp")), DISTANCE).toDF("fp", "y"))
    found = durable(lookup(found, classes, "fp", "inner").select("a", F.col("y").alias("fp")))
    found = lookup(found, classes.withColumnRenamed("a", "b"), "fp", "inner").select("a", "b")
    return durable(same.unionByName(found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def links(docs: DataFrame) -> DataFrame:
    """Rows (node, component) of all texts that have a near copy."""
    texts = named(docs)
    alike_prints = simhash_pairs(texts)
    in_bucket = F.count(F.lit(1)).over(Window.partitionBy("h"))
    crowded = durable(entries(texts, frequent_shingles(texts)).withColumn("m", in_bucket).filter("m > 1").drop("m"))
    wanted = crowded.groupBy("node").agg(F.min("n").alias("n"), F.count("*").alias("m"))
    wanted = durable(wanted.filter(F.col("m") >= enough(F.col("n"))).select("node"))
    held = durable(lookup(texts.select("node", "text"), wanted, "node", "left_semi").dropDuplicates(["node"]).select("node", "text"))
    for end in "ab":  # near copies are all wanted
        alike_prints = durable(lookup(alike_prints, wanted.toDF(end), end, "left_semi").select("a", "b"))
    printed = verified(alike_prints, held)
    grouped = lookup(wanted, durable(connected_components(printed, few=FEW)), "node").select("node", F.coalesce("component", "node").alias("s"))
    crowded = durable(lookup(crowded, durable(grouped), "node", "inner"))

    heads = [F.min_by(F.struct("node", "n", "s"), F.xxhash64("node", F.lit(k))) for k in range(HEADS)]
    heads = durable(crowded.groupBy("h").agg(F.array_distinct(F.array(*heads)).alias("heads")))
    near = lookup(crowded, heads, "h", "inner").select("node", "n", "s", F.explode("heads").alias("head"))
    near = near.filter((F.col("head.s") != F.col("s")) & alike(F.col("n"), F.col("head.n")))
    ends = (F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))
    near = near.groupBy(*ends).agg(F.min(F.least("n", "head.n")).alias("n"), F.count("*").alias("m"))
    first = printed.unionByName(verified(durable(near.filter(F.col("m") >= enough(F.col("n"))).select("a", "b")), held))

    known = durable(lookup(crowded.drop("s"), durable(connected_components(first, few=FEW)), "node").withColumn("c", F.coalesce("component", "node")).drop("component"))
    parts = known.groupBy("h", "c").agg(F.count("*").alias("m")).groupBy("h")
    mixed = durable(parts.agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("m")).filter("m > 1").drop("m"))
    rest = durable(lookup(known, mixed, "h", "inner").withColumn("is_main", F.col("c") == F.col("main")).drop("main"))
    able = rest.groupBy("node").agg(F.min("n").alias("n"), F.count("*").alias("m")).filter(F.col("m") >= enough(F.col("n")))
    rest = durable(once(lookup(rest, durable(able.select("node")), "node", "left_semi")))
    told = durable(parity_bits(lookup(held, durable(rest.select("node").distinct()), "node", "left_semi")))
    rest = durable(lookup(rest, told, "node", "inner"))
    x, y = (rest.select(*(F.col(c).alias(f"{c}{s}") for c in rest.columns)) for s in "xy")
    apart = (F.col("cx") != F.col("cy")) & (F.col("is_mainy") | (F.col("cx") < F.col("cy")))
    across = x.filter(~F.col("is_mainx")).join(y.hint("merge"), (F.col("hx") == F.col("hy")) & apart & alike(F.col("nx"), F.col("ny")) & may_be_near("x", "y") & unmet())
    across = across.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()
    second = verified(possible(durable(across), held), held)
    return connected_components(first.unionByName(second), few=FEW)


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row with the least doc_id; columns
    unchanged. Rows that share nothing with one that goes are not shuffled."""
    rows = durable(named(docs).select("doc_id", "node"))
    found = durable(lookup(rows, durable(links(docs)), "node").withColumn("component", F.coalesce("component", "node")))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    best = durable(found.groupBy("component").agg(F.min(place).alias("best")))
    gone = lookup(found, best, "component").filter(place != F.col("best")).select(F.col("doc_id").alias("_id"), F.col("node").alias("digest"))
    gone = durable(gone.distinct())
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    told = Filter(gone).told(whole)
    hits = told.filter("may").join(gone.hint("merge"), (F.col("_own").eqNullSafe(F.col("_id"))) & (told["digest"] == gone["digest"]), "left_anti")
    return told.filter(~F.col("may")).select("_doc.*").unionByName(hits.select("_doc.*"))
