"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint is the majority, bit by bit, of the hashes of its word
shingles. Bits that go together are grouped into the same part; the parts get
unequal thresholds t_i with sum(t_i + 1) = distance + 1, so that two
fingerprints within the distance agree up to t_i bits in some part i. A dynamic
program picks the thresholds with the least work; a part may get -1 and is not
looked at. How many candidates a part gives is estimated from the pairs of at
most SAMPLE fingerprints, since grouped bits are far from independent; the
estimate decides how fast the search is, never what it finds.

Rows with the same fingerprint are one class. Each class first links to a few
heads of its exact buckets, picked by hash; only then are the probes (a part's
value with up to t_i bits flipped) joined to the index, and only pairs that are
not yet connected come out of that join. So a cluster of many near copies
gives about as many links as it has members, and no link between different
components is lost.

Null and empty texts have no words and fingerprint zero. Repeated rows belong
to the same class. Null doc_ids are never a component's id unless all are null.
An empty table gives an empty result. Other columns are ignored."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_rest, connected_components, durable, in_small_batches, lookup

BITS = 64
#: Members of a bucket that the others are first held against.
HEADS = 8
#: A pair compared inside a join, in rows that are dealt to it.
PAIR_COST = 0.05
#: Fingerprints that candidate counts are estimated from.
SAMPLE = 2048


def fingerprint(text: bytes, shingle: int = 5, seed: int = 42) -> int:
    """64 bits of one UTF-8 text, A-Z lower-cased, as an unsigned number."""
    import xxhash

    words, hashed = text.lower().split(), xxhash.xxh64_intdigest
    if not words:
        return 0
    spans = zip(*(itertools.islice(words, i, None) for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashes = np.array([hashed(b" ".join(span), seed) for span in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 100_000):
        block = hashes[at : at + 100_000].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 5, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a signed long."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t.as_py() or "").encode(), shingle, seed) for t in batch.column(1)]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "fp"])

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(at_rest(mark), "doc_id long, fp long")


def bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many bits i and j are both
    set: 64 x 64 counts over all of them, summed where the rows are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            total += len(bits)
            both += (bits.T @ bits).astype(np.int64)
        cells = [*both.ravel().tolist(), total]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.int64())], names=["cell", "n"])

    rows = classes.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for cell, n in rows:
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size, correlated ones together."""
    share = both / max(n, 1)
    mean = np.diag(share)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    alike = np.abs(share - np.outer(mean, mean)) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        width = BITS // parts + (g < BITS % parts)
        rest = sorted(free)
        first = max(rest, key=lambda i: (sum(sorted((alike[i, j] for j in rest if j != i), reverse=True)[: width - 1]), -i))
        group = [first]
        free.remove(first)
        while len(group) < width:
            best = max(sorted(free), key=lambda j: (alike[group, j].sum(), -j))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def within(n: int, both: np.ndarray, group: list[int], most: int, prints: np.ndarray) -> list[float]:
    """Chance that two fingerprints differ in at most t of the group's bits, for
    t = 0 to most: from the pairs of prints, and as one pair more from the bits'
    frequencies."""
    mean = np.diag(both)[group] / max(n, 1)
    exact = np.zeros(most + 2)
    exact[0] = 1.0
    for p in mean:
        differ = 2 * p * (1 - p)
        exact[1:] = exact[1:] * (1 - differ) + exact[:-1] * differ
        exact[0] *= 1 - differ
    mask, hits, pairs = np.uint64(sum(1 << i for i in group)), np.zeros(BITS + 1), 0
    own = prints & mask
    for i in range(1, len(own)):
        hits += np.bincount(np.bitwise_count(own[i:] ^ own[:-i]), minlength=BITS + 1)
        pairs += len(own) - i
    return list(((np.cumsum(hits) + np.cumsum(np.append(exact, np.zeros(BITS)))[: BITS + 1]) / (pairs + 1))[: most + 1])


def allocate(n: int, both: np.ndarray, distance: int, parts: int, prints: np.ndarray) -> tuple[float, list[tuple[list[int], int]]]:
    """The thresholds with the least work for so many parts, by dynamic
    programming over parts and the threshold left."""
    groups = group_bits(n, both, parts)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        chances = within(n, both, group, distance, prints)
        following: dict[int, tuple[float, list[int]]] = {}
        for spent, (work, picked) in best.items():
            for t in range(-1, distance + 1 - spent):
                probes = sum(math.comb(len(group), k) for k in range(t + 1))
                cost = work + (n * (probes + 1) + PAIR_COST * n * n / 2 * chances[t] if t >= 0 else 0.0)
                left = spent + t + 1
                if left <= distance + 1 and (left not in following or cost < following[left][0]):
                    following[left] = (cost, [*picked, t])
        best = following
    work, picked = best[distance + 1]
    return work, list(zip(groups, picked, strict=True))


def choose(n: int, both: np.ndarray, distance: int, prints: np.ndarray) -> list[tuple[list[int], int]]:
    options = [allocate(n, both, distance, parts, prints) for parts in range(2, distance + 2)] if distance else [allocate(n, both, 0, 1, prints)]
    return [(group, t) for group, t in min(options, key=lambda x: x[0])[1] if t >= 0]


def signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> BITS - 1 else bits


def search(classes: DataFrame, distance: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """classes: distinct fp, durable. Links (a, b) to heads; fp and the component c
    that those give it; and links (x, y) between such components (cx, cy)."""
    n, both = bit_counts(classes)
    if n < 2:
        alone = classes.select("fp", F.col("fp").alias("c"))
        none = alone.toDF("a", "b").filter("false")
        return none, alone, none.select(F.col("a").alias("cx"), F.col("b").alias("cy"), F.col("a").alias("x"), F.col("b").alias("y"))
    few = classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    parts = choose(n, both, distance, np.array([r["fp"] for r in few], np.int64).view(np.uint64))
    masks = [sum(1 << i for i in group) for group, _ in parts]
    keyed = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("part", "key")
    index = durable(classes.select("fp", keyed).withColumn("bucket", F.xxhash64("part", "key")))
    shared = index.groupBy("bucket").count().filter("count > 1").select("bucket")
    crowded = durable(lookup(index, durable(shared), "bucket", "inner").select("bucket", "fp"))
    heads = [F.min_by("fp", F.xxhash64("fp", F.lit(k))) for k in range(HEADS)]
    heads = durable(crowded.groupBy("bucket").agg(F.array_distinct(F.array(*heads)).alias("heads")))
    near = lookup(crowded, heads, "bucket", "inner")
    apart = lambda h: (h != F.col("fp")) & (F.bit_count(h.bitwiseXOR(F.col("fp"))) <= distance)
    near = near.select("fp", F.explode(F.filter("heads", apart)).alias("head")).distinct()
    near = durable(near.select(F.col("fp").alias("a"), F.col("head").alias("b")))
    first = connected_components(near)
    known = durable(lookup(classes, first.withColumnRenamed("node", "fp"), "fp").select("fp", F.coalesce("component", "fp").alias("c")))
    flips = []
    for group, t in parts:
        found = [sum(1 << i for i in flip) for k in range(t + 1) for flip in itertools.combinations(group, k)]
        flips.append(F.array(*[F.lit(signed(f)).cast("long") for f in found]))
    entries = known.select("fp", "c", keyed)
    probes = entries.withColumn("flip", F.explode(F.element_at(F.array(*flips), F.col("part") + 1)))
    probes = probes.select(F.xxhash64("part", F.col("key").bitwiseXOR(F.col("flip"))).alias("bucket"), F.col("fp").alias("x"), F.col("c").alias("cx"))
    exact = entries.select(F.xxhash64("part", "key").alias("bucket"), F.col("fp").alias("y"), F.col("c").alias("cy"))
    close = (F.col("cx") < F.col("cy")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance)
    across = probes.join(exact.hint("merge"), (probes["bucket"] == exact["bucket"]) & close)
    return near, known, across.select("cx", "cy", "x", "y")


def spanning(classes: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) that connect all that is linked: about as many as there are
    fingerprints, at most one between two components of links to heads."""
    near, _, across = search(classes, distance)
    between = across.groupBy("cx", "cy").agg(F.min(F.struct("x", "y")).alias("_link"))
    return near.unionByName(between.select(F.col("_link.x").alias("a"), F.col("_link.y").alias("b")))


def link(classes: DataFrame, distance: int = 4) -> DataFrame:
    """classes: distinct fp, durable. Rows (node, component) of all that link."""
    _, known, across = search(classes, distance)
    across = durable(across.select(F.col("cx").alias("a"), F.col("cy").alias("b")).distinct())
    second = durable(connected_components(across))
    over = second.select(F.col("node").alias("c"), "component")
    return lookup(known, over, "c").select(F.col("fp").alias("node"), F.coalesce("component", "c").alias("component"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id that links reach."""
    rows = durable(fingerprints(docs, shingle, seed))
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = link(classes.select("fp"), distance).withColumnRenamed("node", "fp")
    named = durable(lookup(linked, classes, "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = lookup(named.select("fp", "component"), durable(least), "component").select("fp", "component_id")
    return lookup(rows, durable(by_fp), "fp").select("doc_id", "fp", "component_id")
