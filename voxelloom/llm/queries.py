"""The training-data queries opN_* with their parameters, and SQL for those that
SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, mixing, oracle, packing, quality, secrets, simhash, toxicity, url_filters, warc
from .common import durable, scratch, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Two turns whose text looks like a template's own controls.
TRICKY = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    formatted = chat.format_chats(chat.from_rows(rows.unionByName(tricky)))
    back = formatted.withColumn("back", chat.read_back(F.col("formatted"), F.col("loss_spans")))
    said = F.transform("back.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.col("back.learned")
    return back.select(
        "conv_id",
        F.size("back.turns").cast("long").alias("n_turns"),
        chat.digest(said).alias("turns_sha256"),
        F.length(F.array_join(learned, "")).cast("long").alias("loss_chars"),
        chat.digest(learned).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.archive_pages(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    read = warc.read_warc(spark, path, payload=False).filter(F.col("record_type").isin("response", "revisit"))
    return read.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = durable(mixing.sized(table(spark, sf_dir, "documents")))
    mixed = mixing.systematic_copies(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.NAMES, "base_failed", "kept", "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets.BASE + secrets.MORE
    found = secrets.scan(table(spark, sf_dir, "documents"), rules)
    base = F.filter("spans", lambda s: s["place"] < len(secrets.BASE))
    of = lambda place: F.size(F.filter("spans", lambda s: s["place"] == place)).cast("long")
    counts = [of(place).alias(f"n_{rule.kind}") for place, rule in enumerate(secrets.BASE)]
    digest = F.sha2(secrets.joined(base, rules), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secrets.joined(F.col("spans"), rules).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, shingle=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ours = (
        op1_chat_format, op2_packing, op3_warc, op4_mixing, op5_quality,
        op6_secrets, op7_toxicity, op8_exact_dedup, op9_url_filter, op10_simhash,
    )
    return {f.__name__: f for f in ours}


def oracle_sql() -> dict[str, str]:
    """Tokenizers, forests, language models and SimHash are beyond SQL; those
    queries are tested against brute force."""
    return {
        "op1_chat_format": oracle.chat(TRICKY),
        "op3_warc": oracle.warc(),
        "op4_mixing": oracle.mixing(),
        "op6_secrets": oracle.scan(),
        "op8_exact_dedup": oracle.exact_dedup(),
        "op9_url_filter": oracle.url_filter(),
    }
