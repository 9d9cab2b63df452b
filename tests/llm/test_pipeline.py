"""The pipeline's stages, one after another, against plain versions."""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from voxelloom.llm import quality
from voxelloom.llm import queries as llm

from .test_near_copies import kept_by_force

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder, docs, made = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    made["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        made[name] = docs.collect()
    return made


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_dedup", "mixing", "packing"]


def test_quality(stages, spark, sf_dir):
    judged = {r["doc_id"]: r["kept"] for r in llm.queries()["op5_quality"](spark, sf_dir).collect()}
    assert sorted(r["doc_id"] for r in stages["quality_rules"]) == sorted(k for k, kept in judged.items() if kept)
    for r in stages["quality_rules"]:
        words, *_, repeated = quality.statistics((r["text"] or "").encode())
        assert words >= 50 and 100 * repeated <= 50 * words
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    usual = [r for r in stages["input"] if r["doc_id"] in good and len(WORD.findall(r["text"] or "")) >= 50]
    kept = {r["doc_id"] for r in stages["quality_rules"]}
    assert sum(r["doc_id"] in kept for r in usual) >= 0.95 * len(usual)


def test_exact(stages):
    last = {}
    for r in stages["quality_rules"]:
        key = lowered(r["text"])
        if key not in last or r["doc_id"] > last[key]["doc_id"]:
            last[key] = r
    assert sorted(stages["exact_dedup"]) == sorted(last.values())


def test_near(stages):
    """Groups are linked by five-word shingles with a Jaccard similarity of 4/5."""
    want, pairs = kept_by_force([(r["doc_id"], r["text"]) for r in stages["exact_dedup"]])
    assert pairs >= 5 and sorted(r["doc_id"] for r in stages["simhash_dedup"]) == want


def test_mix(stages):
    sizes = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in stages["simhash_dedup"]}
    of = {r["doc_id"]: r for r in stages["simhash_dedup"]}
    copies = Counter(r["doc_id"] for r in stages["mixing"])
    assert set(stages["mixing"]) <= set(of.values()) and max(copies.values()) <= 3
    by = defaultdict(int)
    for k, n in sizes.items():
        by[of[k]["source"]] += n
    order = sorted(by)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 3.0 * sum(by.values())
    for _ in range(200):  # the level at which all words are poured
        level = (low + high) / 2
        poured = sum(min(3 * by[s], weight[s] * level) for s in order)
        low, high = (level, high) if poured < sum(by.values()) else (low, level)
    for s in order:
        taken = sum(n * sizes[k] for k, n in copies.items() if of[k]["source"] == s)
        assert abs(taken - min(3 * by[s], weight[s] * level)) <= 3 * max(sizes.values())


def test_pack(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(llm.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in stages["mixing"]}
    want = Counter()
    for doc, n in Counter(r["doc_id"] for r in stages["mixing"]).items():
        ids = tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [2]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[doc, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)] += n
    got, places = Counter(), defaultdict(list)
    for r in stages["packing"]:
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:i]) for i in range(len(found))] and sum(n for _, n in found) <= 4096


def test_run(stages, spark, sf_dir):
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(stages["packing"])
