"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it
as Parquet to the shared folder and reads it again as the next stage's docs.

An empty table gives an empty result in every stage, and columns beyond those a
stage needs, whatever their names, come out as they went in (the last one returns
places of pieces instead). Null texts count as empty throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelloom.llm import exact_dedup, mixing, near_copies, packing, quality
from voxelloom.llm.common import scratch, table
from voxelloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the isolation forest rejects go: null and empty
    texts too. Rows with null doc_ids are judged like others; repeated rows alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, a null one only where all
    are null; one of the rows that share text and doc_id."""
    return exact_dedup.deduplicate(docs, keep="max")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays.

    Near copies share 4/5 of their five-word shingles: an exact join, as SimHash
    finds only part of such pairs and links others. The stage keeps its name. A
    null doc_id stays only where all are null; rows that share text and doc_id
    stay together; texts without words are near copies of one another."""
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, 0 to 3 times. Null is
    a source of its own; documents without words are taken or not like others of
    size 0, and count nothing; repeated rows are documents of their own."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence; a text without
    tokens is one piece of the end token. Repeated rows are packed as often as
    they occur; which of equal pieces goes where is of no account."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Isolation forests, SimHash and tokenizers are beyond SQL; the stages are
#: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
