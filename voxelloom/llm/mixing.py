"""Mixing sources to target weights by systematic sampling, native.

Each source gets a target in words: its weight's share of all words, at most
`most` times its own size, what is cut off being shared again by weight. Every
document of a source then expects target / source size copies. Their prefix sum
runs through the source's documents, one random offset is added, and a document
is emitted once for each integer boundary that its step crosses.

The prefix sum follows the size first, then a hash of doc_id: each source's words
come near their target, and the documents of one size are ranked in slices of
the hash, of which there are more the more documents there are. No task sees a
whole source. Null and empty texts have size 0. A null source is a source
of its own, last in order. Repeated rows are documents of their own. An empty
table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, hash_number, running, word_count

#: Weights by the source's place in code point order, over and over.
WEIGHTS = (5, 2, 1)
#: Documents of one size that one window task ranks on average at most.
RANKED = 50_000


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def targets(by: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Rows (source, target); by has one row per source with its source_size.
    Pouring all words over the sources in proportion to their weights, a source
    is full at `most` times its size: the level at which all words are poured
    decides every target."""
    ranked = running(by, (F.col("source").asc_nulls_last(),), "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("most", most * F.col("source_size"))
    ranked = ranked.withColumn("fullness", F.col("most") / F.col("weight"))
    filled = running(ranked, (F.col("fullness").asc(), F.col("place").asc()), "order", full_words="most", full_weight="weight")
    total, all_weights = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total or 0) - F.col("full_words")).cast("double") / (F.lit(all_weights or 0) - F.col("full_weight"))
    # the first source that does not fill up sets the level of all after it
    poured = filled.agg(F.max(F.when(F.col("weight") * level < F.col("most"), level))).first()[0]
    full = F.col("most").cast("double")
    return filled.select("source", (full if poured is None else F.least(full, F.col("weight") * F.lit(poured))).alias("target"))


def systematic_copies(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix"
) -> DataFrame:
    """docs has doc_id, source and size; other columns stay. It is read three
    times, once for the number of rows and once for those three columns. Adds
    source_size, target and copies (0 to most)."""
    bits, rows = 6, docs.count()
    while bits < 31 and RANKED << bits < rows:
        bits += 1
    keyed = docs.withColumn("_hash", hash_number(F.col("doc_id"))).withColumn("_slice", F.shiftright("_hash", 32 - bits))
    keyed = keyed.withColumn("_source", F.to_json(F.struct("source")))
    blocks = durable(keyed.groupBy("_source", "source", "size", "_slice").count())
    sizes = blocks.groupBy("_source", "source", "size").agg(F.sum("count").alias("count"))
    by = durable(sizes.groupBy("_source", "source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")))
    goal = by.select("_source", "source_size").join(targets(by.drop("_source"), weights, most).withColumn("_source", F.to_json(F.struct("source"))), "_source")
    earlier = Window.unboundedPreceding, -1
    by_size = Window.partitionBy("_source").orderBy("size").rowsBetween(*earlier)
    by_slice = Window.partitionBy("_source", "size").orderBy("_slice").rowsBetween(*earlier)
    size_bases = sizes.select("_source", "size", F.coalesce(F.sum("count").over(by_size), F.lit(0)).alias("_size_base"))
    bases = blocks.select("_source", "size", "_slice", F.coalesce(F.sum("count").over(by_slice), F.lit(0)).alias("_slice_base"))
    bases = bases.join(size_bases, ["_source", "size"]).join(goal.drop("source"), "_source")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 4), 16, 10)
    within = Window.partitionBy("_source", "size", "_slice").orderBy("_hash", "doc_id")
    ranked = keyed.withColumn("_rank", F.row_number().over(within)).join(bases, ["_source", "size", "_slice"])
    rank = F.col("_rank") + F.col("_size_base") + F.col("_slice_base")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = (offset.cast("double") + 0.5) / 65536
    copies = F.floor(rank * expected + start) - F.floor((rank - 1) * expected + start)
    return ranked.select(*docs.columns, "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """docs with each row as often as the mix takes it, its columns unchanged."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = systematic_copies(whole, weights, most, seed).filter("copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
