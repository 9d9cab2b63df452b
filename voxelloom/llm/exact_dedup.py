"""Exact deduplication over a log-structured merge index, native.

Each memtable (a slice of the documents) is flushed as a run: one entry (digest,
keep_id, entries) per distinct text, sorted by digest. When a level holds
`fanout` runs, compaction merges them into one of the next level and keeps the
identifier that wins; at the end all are merged into one run.

A run's filter is a Bloom filter of the digests that more than one row has: words
of 64 bits, in one of which each digest sets three. It has a bounded number of words,
however many texts there are (where they are more than it can tell apart it lets
more through), and is broadcast. A row that the filter turns down is alone with
its text, and needs no lookup; the others look the run up, and their texts are
shuffled for verification byte by byte: the least and the greatest text of a
digest must be the same. Digests that fail are split by text.

Null and empty texts are equal. Null doc_ids lose to any other. Repeated rows
count as often as they occur; of rows that also share the doc_id that stays,
each is marked as kept (`deduplicate` leaves one). An empty table
gives an empty result. Other columns are ignored, or kept by `deduplicate`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, Filter, ascii_lower, durable, lookup

#: Rows of a part of a hot group, at least and at most.
LEAST_PART, PART = 32, 20_000


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


class RunIndex:
    """Sorted digest runs by level; `fanout` runs of a level become one of the next."""

    def __init__(self, keep: str = "min", fanout: int = 2):
        self.keep, self.fanout = keep, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def _wins(self, column: str) -> Column:
        return F.max(column) if self.keep == "max" else F.min(column)

    def _run(self, entries: DataFrame) -> DataFrame:
        merged = entries.groupBy("digest").agg(self._wins("keep_id").alias("keep_id"), F.sum("entries").alias("entries"))
        return durable(merged.sortWithinPartitions("digest"))

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        whole = runs[0]
        for run in runs[1:]:
            whole = whole.unionByName(run)
        return self._run(whole)

    def flush(self, memtable: DataFrame) -> None:
        """memtable: (doc_id, digest). Adds a run and compacts full levels."""
        self.levels[0].append(self._run(memtable.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("entries"))))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._merge(runs))
            level += 1

    def whole(self) -> DataFrame:
        """One run of all levels."""
        runs = [run for level in self.levels for run in level]
        if len(runs) > 1:
            runs = [self._merge(runs)]
        self.levels = [runs]
        return runs[0]


@dataclass
class Index:
    """entries: (doc_id, digest, sha) of every row; shared: the run's entries
    of more than one row; clashing: digests of different texts, None without."""

    entries: DataFrame
    shared: DataFrame
    filter: Filter
    clashing: DataFrame | None
    digest_bytes: int


def _digest(text: Column, digest_bytes: int) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, digest_bytes)


def build(docs: DataFrame, keep: str, memtables: int = 4, fanout: int = 2, digest_bytes: int = 32) -> Index:
    entries = docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"))
    entries = durable(entries.select("doc_id", F.substring("sha", 1, digest_bytes).alias("digest"), "sha"))
    index = RunIndex(keep, fanout)
    for i in range(memtables):
        index.flush(entries.filter(F.pmod(F.xxhash64("doc_id"), F.lit(memtables)) == i))
    shared = durable(index.whole().filter("entries > 1"))
    found = Filter(shared)
    return Index(entries, shared, found, _clashes(docs, entries, shared, found, digest_bytes), digest_bytes)


def _clashes(docs: DataFrame, entries: DataFrame, shared: DataFrame, held: Filter, digest_bytes: int) -> DataFrame | None:
    """Digests whose texts differ. Groups of more than 1/HOT_SHARE of all rows, of
    which there are fewer than HOT_SHARE, are dealt in parts."""
    share = max(LEAST_PART, -(-entries.count() // HOT_SHARE))
    parts = F.when(F.col("entries") > share, F.ceil(F.col("entries") / min(share, PART))).otherwise(1)
    parted = shared.select("digest", parts.cast("int").alias("parts"))
    hot = F.broadcast(parted.filter("parts > 1"))
    dealt = parted.select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    read = docs.select(F.col("doc_id").cast("long"), normalised(F.col("text")).alias("text"))
    read = held.told(read.withColumn("digest", _digest(F.col("text"), digest_bytes))).filter("may")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts"))).cast("int")
    read = read.join(hot, "digest", "left").select("digest", part.alias("part"), "text")
    hits = read.join(dealt.hint("merge"), ["digest", "part"], "left_semi").groupBy("digest", "part")
    ends = hits.agg(F.min("text").alias("least"), F.max("text").alias("most"))
    ends = ends.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    found = durable(ends.filter("least <> most").select("digest"))
    return None if found.isEmpty() else found


def exact_groups(docs: DataFrame, keep: str = "min", memtables: int = 4, fanout: int = 2, digest_bytes: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept and
    text_sha256 of the normalised text."""
    return groups_of(docs, build(docs, keep, memtables, fanout, digest_bytes), keep)


def groups_of(docs: DataFrame, index: Index, keep: str, hits_only: bool = False) -> DataFrame:
    """exact_groups of an index; with hits_only, of rows that its filter lets through."""
    told = index.filter.told(index.entries)
    alone = told.filter(~F.col("may")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("entries"), "sha", "digest")
    hits = lookup(told.filter("may").select("doc_id", "digest", "sha"), index.shared.select("digest", "keep_id", "entries"), "digest")
    is_shared = F.col("entries").isNotNull()
    hits = hits.select(
        "doc_id", F.when(is_shared, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("entries", F.lit(1)).alias("entries"), "sha", "digest"
    )
    found = hits if hits_only else alone.unionByName(hits)
    if index.clashing is not None:
        found = lookup(found, index.clashing, "digest", "left_anti")
    found = found.select(
        "doc_id", "keep_id", F.col("entries").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    if index.clashing is not None:
        read = docs.select(F.col("doc_id").cast("long"), normalised(F.col("text")).alias("text"))
        read = read.withColumn("digest", _digest(F.col("text"), index.digest_bytes))
        found = found.unionByName(by_text(lookup(read, index.clashing, "digest", "left_semi").drop("digest"), keep))
    return found


def by_text(rows: DataFrame, keep: str) -> DataFrame:
    """The groups of (doc_id, text) from the texts themselves, should different
    ones share a digest."""
    wins = F.max("doc_id") if keep == "max" else F.min("doc_id")
    groups = rows.groupBy("text").agg(wins.alias("keep_id"), F.count("*").alias("group_size"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.join(groups, "text").select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.sha2("text", 256).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The rows of docs that stay, one per text, columns unchanged. Rows that the
    filter turns down stay where they are; only the others are shuffled."""
    index = build(docs, keep)
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key")
    found = groups_of(docs, index, keep, hits_only=True).filter("kept")
    found = durable(found.select(F.unhex("text_sha256").alias("_digest"), id_))
    repeated = not found.groupBy("_digest", "_key").count().filter("count > 1").isEmpty()
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), id_, _digest(normalised(F.col("text")), index.digest_bytes).alias("digest"))
    told = index.filter.told(whole)
    hits = told.filter("may").select("_doc", F.col("digest").alias("_digest"), "_key")
    stay = hits.join(found.hint("merge"), ["_digest", "_key"], "left_semi")
    if repeated:  # rows that share even the doc_id
        stay = stay.groupBy("_digest", "_key").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))
    return told.filter(~F.col("may")).select("_doc.*").unionByName(stay.select("_doc.*"))
