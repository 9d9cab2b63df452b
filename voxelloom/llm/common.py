"""Shared pieces of the training-data operators: durable cuts of lineage, joins
that survive hot keys, and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from voxelloom.storage import durable, scratch

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot when it holds at least 1/HOT_SHARE of the rows, so no table has
#: more than HOT_SHARE hot keys: that is the proven bound of what is broadcast.
HOT_SHARE = 1000

#: Most words of a filter, and its bits for each digest.
FILTER_WORDS, FILTER_BITS = 1 << 17, 16

#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_where_unset(spark: SparkSession, key: str, value: str) -> None:
    """A session setting that an operator relies on; one that the user has chosen
    stays as it is."""
    if key not in spark.conf.getAll:
        spark.conf.set(key, value)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, its session sending Python at most BATCH_BYTES at a time: what a
    worker holds then does not depend on how long texts are."""
    set_where_unset(df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


#: What this Python worker keeps from task to task.
_kept: dict[str, dict] = {}


def kept(what: str) -> dict:
    """A dict that a worker keeps until `let_go`."""
    return _kept.setdefault(what, {})


def let_go() -> None:
    """Drop what the worker keeps, and give its free memory back to the system."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


Read = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def at_rest(read: Read) -> Read:
    """read, for mapInArrow, leaving nothing in its worker, nor what another
    operator left there. Workers outlive their tasks: what they keep would count
    against the memory of stages that run no Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        try:
            yield from read(batches)
        finally:
            let_go()

    return run


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the JVM's fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_number(key: Column, salt: str = "") -> Column:
    """32 bits from a key's text, the same in any SQL engine that has md5."""
    text = F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def running(df: DataFrame, order: tuple[Column, ...], place: str, **sums: str) -> DataFrame:
    """df, durable, with each row's place in a total order, from 0, and under
    their names the sums of columns over the rows before it. Rows are dealt by
    range; one window goes through the ranges, none through all rows."""
    dealt = durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    wholes = dealt.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = wholes.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", *(f"_{n}" for n in sums))])
    here = Window.partitionBy("_range").orderBy(*order)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    own = {n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()}
    found = dealt.withColumns({place: F.row_number().over(here) - 1, **own}).join(bases, "_range")
    return durable(found.withColumns({place: F.col(place) + F.col("_n"), **{n: F.col(n) + F.col(f"_{n}") for n in sums}}).drop("_range", "_n", *(f"_{n}" for n in sums)))


def durable_counting(df: DataFrame, test: Column) -> tuple[DataFrame, int]:
    """durable(df), and in how many rows test holds, in one job."""
    seen = Observation()
    written = durable(df.observe(seen, F.count_if(test).alias("n")))
    return written, seen.get["n"]


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join left to right on `key`, unique in right. Null keys match nothing.

    Both sides should be stored tables and the result be stored or shuffled
    next: each side then reaches the join straight from its exchange, and
    Spark's adaptive skew join deals the rows of a hot key to many tasks."""
    return left.join(right.hint("merge"), key, how)


def _word(words: int) -> Column:
    return F.xxhash64("digest").bitwiseAND(F.lit(words - 1))


def _bits() -> Column:
    """The three bits of its word that a digest sets."""
    key = F.xxhash64("digest")
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(key, at).bitwiseAND(F.lit(63)).cast("int"))
    return bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))


class Filter:
    """A Bloom filter of the column `digest` of a stored table, of at most
    FILTER_WORDS words. Where it holds more digests than it can tell apart, it
    lets more through; it never turns down one that it holds."""

    def __init__(self, held: DataFrame):
        self.words, n = 64, held.count()
        while self.words < FILTER_WORDS and self.words * 64 < n * FILTER_BITS:
            self.words *= 2
        self.table = durable(held.groupBy(_word(self.words).alias("_word")).agg(F.bit_or(_bits()).alias("_bits")))

    def told(self, rows: DataFrame) -> DataFrame:
        """rows, which have a digest, and `may`: false where it is not held."""
        told = rows.withColumn("_word", _word(self.words)).join(F.broadcast(self.table), "_word", "left")
        return told.withColumn("may", F.coalesce(F.col("_bits").bitwiseAND(_bits()) == _bits(), F.lit(False))).drop("_word", "_bits")


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all ends of the edges (a, b) that one task reads."""
    up: dict = {}

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            x, y = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            up[max(x, y)] = min(x, y)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(k) for k in up], kind)], names=["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """Rows (node, component) for every end of an edge; component is the least
    node that can be reached. Null ends and loops link nothing.

    Each round hooks every node to its least neighbour, shortens the chains by
    pointer jumping, and goes on with the edges between what is left: at least
    half of the nodes go each time. All state stays distributed. Once at most
    `few` edges are left, one task links them instead of further rounds, which
    write half a dozen tables each; it never holds more than those."""
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends, n = durable_counting(ends, F.lit(True))
    found = ends.select(F.col("a").alias("node"), F.col("b").alias("component")).filter("false")
    first = True
    while n > few:
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        up = durable(up.select("node", F.least("node", "up").alias("up")))
        moved = 1
        while moved:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            step, moved = durable_counting(lookup(up, over, "up"), F.col("over") != F.col("up"))
            up = step.select("node", F.col("over").alias("up"))
        if first:
            found = up.select("node", F.col("up").alias("component"))
        else:
            onto = up.select(F.col("node").alias("component"), "up")
            found = durable(lookup(found, onto, "component"))
            found = found.select("node", F.coalesce("up", "component").alias("component"))
        first = False
        ends = lookup(ends, up.select(F.col("node").alias("a"), F.col("up").alias("a2")), "a")
        ends = lookup(ends, up.select(F.col("node").alias("b"), F.col("up").alias("b2")), "b")
        ends = ends.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a <> b").distinct()
        ends, n = durable_counting(ends, F.lit(True))
    if n:
        kind = ends.schema["a"].dataType.simpleString()
        last = durable(ends.repartition(1).mapInArrow(united, f"node {kind}, component {kind}"))
        if first:
            return last
        found = durable(lookup(found, last.select(F.col("node").alias("component"), F.col("component").alias("up")), "component"))
        found = found.select("node", F.coalesce("up", "component").alias("component"))
    return found


__all__ = ["WORD", "HOT_SHARE", "Filter", "ascii_lower", "at_rest", "connected_components", "durable", "durable_counting", "hash_number", "in_small_batches", "kept", "let_go", "lookup", "running", "scratch", "set_where_unset", "table", "word_count"]
