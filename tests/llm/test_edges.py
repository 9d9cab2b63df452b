"""Nulls in any column, empty and very long texts, ties and repeated rows, empty
tables, and extra columns with clashing names, for every operator and stage."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxelloom.llm import chat, common, exact_dedup, mixing, packing, quality, secrets, simhash, toxicity, url_filters, warc
from voxelloom.llm import queries as llm
from voxelloom.llm.common import connected_components, durable

EXTRA = ("text_1", "fp", "kept", "size", "copies", "digest", "key", "part", "_doc", "_digest", "_key", "length", "ids", "label", "n_words", "component", "path", "node")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed=0, words=("the", "river", "stone", "light", "over", "garden", "slow", "paper", "winter", "glass")):
    picks = random.Random(seed)
    return " ".join(picks.choice(words) + str(picks.randrange(400)) for _ in range(n))


ROWS = [
    (1, prose(80, 1), "en", "a", 1),
    (2, prose(80, 1), "en", "a", 1),
    (2, prose(80, 1), "en", "a", 1),
    (3, prose(80, 1).upper(), None, "b", None),
    (4, None, "en", None, 0),
    (5, "", "en", "", 0),
    (6, " \t\n\x0b", "en", "b", 4),
    (None, prose(70, 2), "en", "b", 9),
    (None, prose(70, 3), "en", None, 9),
    (7, prose(20_000, 4), "en", "a", 9),
    (8, "é ß 你好 \U0001f600 " * 30, "en", "c", 9),
    (9, "password = abcdefghijklmnop and AKIA" + "A" * 16 + " " + prose(60, 5), "en", "c", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    whole = spark.createDataFrame(ROWS, DOCS)
    return whole.withColumns({c: F.lit(f"extra {c}") for c in EXTRA})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (7, None, 0), (9, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def n_of(df):
    return len(df.collect())


def test_packing(docs, empty):
    path = llm.tokenizer_path()
    packed = packing.pack_documents(docs, path).collect()
    whole = {(r["doc_id"], r["doc_tokens"]) for r in packed if r["start"] == 0}
    assert sum(r["start"] == 0 for r in packed) == len(ROWS)
    assert (4, 1) in whole and (5, 1) in whole
    assert n_of(packing.pack_documents(empty, path)) == 0


def test_tokens_by_words(spark):
    from tokenizers import Tokenizer

    cached, whole = packing.WordTokenizer(llm.tokenizer_path()), Tokenizer.from_file(llm.tokenizer_path())
    picks = random.Random(3)
    alphabet = ["a", "B", "'s", "é", "é", "́", " ", " ", " ", "\n", "1", "23", "!", "<|", "<|endoftext|>", "İ", "ß", "ͅ", "Σ", "σς", "한", "x" * 80, "​", "\x1c", "\x85", "﻿"]
    texts = ["".join(picks.choice(alphabet) for _ in range(picks.randrange(12))) for _ in range(4000)]
    for text in texts:
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(cached.ids(text), "<u4").tolist() == want, repr(text)


def test_words_with_runs_of_signs(monkeypatch):
    """New words of letters and signs go to the tokenizer by their parts: once for
    each run of signs, however many words it follows, and across generations."""
    from tokenizers import Tokenizer

    cached, whole, asked = packing.WordTokenizer(llm.tokenizer_path()), Tokenizer.from_file(llm.tokenizer_path()), []
    monkeypatch.setattr(cached, "whole", lambda text, f=cached.whole: asked.append(text) or f(text))
    monkeypatch.setattr(packing, "CACHED_WORDS", 300)
    picks = random.Random(5)
    runs = ["&&&", ",***", "!!", ".$$$", "'", ".", ""]
    made = ["".join(picks.choices("abcdeéñÀß", k=picks.randrange(1, 9))) for _ in range(600)]
    for at in (0, 200, 400, 0):
        texts = [" ".join(w + picks.choice(runs) for w in picks.sample(made[at : at + 200], 80)) for _ in range(5)]
        texts += ["ΣΑΣ&&& É&&& é!! 다&&& " + "x" * 80 + "&&&", "&&& ,*** a", "\u0130. " + made[at] + "!!"]
        for text, ids in zip(texts, cached.batch(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
        assert len(cached.words) < 300 + 5 * 80 * 3
    assert len([w for w in asked if w[0].isalpha() and w.isascii() and len(w) < 64]) == 0
    assert len(asked) < 60, len(asked)


def test_fill_is_closest():
    picks = random.Random(1)
    for _ in range(60):
        capacity = picks.randrange(5, 60)
        counts = {picks.randrange(1, capacity + 1): picks.randrange(1, 4) for _ in range(6)}
        picked = packing.fill(counts, capacity)
        sums = {max(counts)}
        items = [k for k, n in counts.items() for _ in range(n - (k == max(counts)))]
        for item in items:
            sums |= {s + item for s in sums if s + item <= capacity}
        assert all(n <= counts[k] for k, n in picked.items())
        assert sum(k * n for k, n in picked.items()) == max(sums)


def test_mixing(docs, empty, spark):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {tuple(r) for r in mixed.select("doc_id", "key").distinct().collect()}
    assert counts <= {(r[0], "extra key") for r in ROWS}
    assert n_of(mixing.mix(empty)) == 0
    sizes = mixing.systematic_copies(mixing.sized(docs)).collect()
    assert len(sizes) == len(ROWS) and {r["size"] for r in sizes if r["doc_id"] in (4, 5, 6)} == {0}
    assert sorted(map(repr, sizes)) == sorted(map(repr, mixing.systematic_copies(mixing.sized(docs)).collect()))
    assert n_of(mixing.systematic_copies(mixing.sized(empty))) == 0


def test_quality(docs, empty, labels):
    judged = quality.judge(docs, labels).collect()
    assert len(judged) == len(ROWS)
    assert all(r["base_failed"] and not r["kept"] for r in judged if r["doc_id"] in (4, 5, 6))
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert n_of(quality.judge(empty, labels)) == 0 and n_of(quality.keep_good(empty, labels)) == 0
    unlabelled = quality.judge(docs, labels.filter("false")).collect()
    assert all(r["kept"] != r["base_failed"] for r in unlabelled)


@pytest.mark.parametrize("bad", [0, 700])
def test_threshold_ranks_all_labelled_rows(spark, bad):
    picks = np.random.default_rng(bad)
    scores = np.round(np.concatenate([picks.normal(0.4, 0.05, 3000), picks.normal(0.5, 0.08, bad)]), 3)
    good = np.arange(len(scores)) < 3000
    scored = spark.createDataFrame([(float(x), bool(g)) for x, g in zip(scores, good, strict=True)], "score double, good boolean")
    floor = np.quantile(scores[good], 0.99, method="higher")
    tries = [x for x in np.unique(scores) if x >= floor] if bad else [floor]
    gains = [((scores[~good] > x).mean() if bad else 0) - (scores[good] > x).mean() for x in tries]
    assert quality.calibrate(scored, 0.01) == tries[int(np.argmax(gains))]
    assert quality.calibrate(scored.filter("not good"), 0.01) == np.inf


def test_no_labelled_row_is_left_out(spark):
    """The bad rows are the only ones far out; the rows of least hash hold none of them."""
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("_h")).orderBy("_h").collect()
    late = {r["doc_id"] for r in rows[25_000:25_400]}
    texts = [(i, " ".join(("x" * 30 if i in late else "word") + str(k) for k in range(60 + i % 7))) for i in range(30_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, int(i not in late)) for i, _ in texts], "doc_id long, quality int")
    judged = quality.judge(docs, labels)
    assert {r["doc_id"] for r in judged.filter("not kept").collect()} == late
    assert quality.keep_good(docs, labels).count() == 30_000 - 400


def test_forest_finds_the_odd_one():
    picks = np.random.default_rng(0)
    usual, odd = picks.normal(0, 0.1, (500, 3)), np.array([[4.0, 0, 0]])
    forest = quality.IsolationForest(usual, np.concatenate([usual, odd]))
    assert forest.scores(odd)[0] > np.quantile(forest.scores(usual), 0.99)


def test_exact(docs, empty):
    found = exact_dedup.exact_groups(docs, keep="max").collect()
    assert len(found) == len(ROWS)
    of = {r["doc_id"]: r for r in found}
    assert {of[k]["keep_id"] for k in (1, 2, 3)} == {3} and of[1]["group_size"] == 4
    assert of[4]["keep_id"] == of[5]["keep_id"] == 5
    assert of[4]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    least = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs).collect()}
    assert least[3] == 1 and least[5] == 4
    for keep in ("min", "max"):
        kept = exact_dedup.deduplicate(docs, keep)
        assert kept.columns == docs.columns and n_of(kept) == len({(r[1] or "").lower() for r in ROWS})
    assert n_of(exact_dedup.exact_groups(empty)) == 0 and n_of(exact_dedup.deduplicate(empty)) == 0


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_splits_clashing_digests(spark, docs, keep):
    """With one byte of digest different texts share one; the groups are those of
    the texts all the same."""
    more = spark.range(600).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("Text "), F.col("id") % 400).alias("text"))
    rows = docs.select("doc_id", "text").unionByName(more)
    whole = sorted(map(repr, exact_dedup.exact_groups(rows, keep).collect()))
    index = exact_dedup.build(rows, keep, digest_bytes=1)
    assert index.clashing is not None and exact_dedup.build(rows, keep).clashing is None
    assert sorted(map(repr, exact_dedup.groups_of(rows, index, keep).collect())) == whole


def test_runs_merge_by_level(spark):
    index = exact_dedup.RunIndex("min", fanout=2)
    for i in range(5):
        rows = spark.range(10).select((F.col("id") + 10 * i).alias("doc_id"), F.to_binary((F.col("id") % 5).cast("string"), F.lit("utf-8")).alias("digest"))
        index.flush(rows)
    assert [len(level) for level in index.levels] == [1, 0, 1]
    whole = index.whole()
    assert sorted((bytes(r["digest"]), r["keep_id"], r["entries"]) for r in whole.collect()) == [(str(k).encode(), k, 10) for k in range(5)]


def test_filter_has_no_false_negatives(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_WORDS", 128)  # too few for the keys
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")
    keys = durable(spark.range(3000).select(digest))
    held = common.Filter(keys)
    assert held.table.count() <= 128 and held.told(keys).filter("may").count() == 3000
    small = common.Filter(durable(keys.limit(100)))
    others = spark.range(5000, 8000).select(digest)
    assert small.told(others).filter("may").count() < 600


def test_copies_that_share_a_doc_id(spark):
    rows = [(1, "A", "x"), (1, "a", "y"), (1, "b", "z"), (None, "a", "w"), (None, None, "v"), (None, "", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {tuple(r) for r in exact_dedup.deduplicate(docs, "max").collect()}
    assert len(kept) == 3 and {(k, (t or "").lower()) for k, t, _ in kept} == {(1, "a"), (1, "b"), (None, "")}
    assert kept == {tuple(r) for r in exact_dedup.deduplicate(docs.repartition(3), "max").collect()}


def test_hot_group_is_dealt(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, "Same").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup.exact_groups(rows.withColumnRenamed("id", "doc_id"), "max")
    assert found.filter("group_size = 2000 and keep_id = 1999").count() == 2000 and found.filter("kept").count() == 1001


def test_simhash(docs, empty):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(ROWS)
    of = {r["doc_id"]: r for r in found}
    assert of[1]["component_id"] == of[3]["component_id"] == 1
    assert of[4]["fp"] == of[5]["fp"] == of[6]["fp"] == 0 and of[6]["component_id"] == 4
    assert n_of(simhash.near_duplicates(empty)) == 0


def test_rows_that_share_a_doc_id_keep_their_own_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "t u v w x y z"), (None, "T U V W X Y Z"), (2, "a b c d e f g"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["fp"] == 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert found == sorted([(1, False, 1), (1, False, 1), (None, False, 1), (2, False, 1), (None, True, None)], key=repr)
    groups = sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs, "max").collect()), key=repr)
    assert groups == sorted([(1, 2, 2), (1, 1, 2), (None, 1, 2), (2, 2, 2), (None, None, 1)], key=repr)


@pytest.mark.parametrize("distance", [0, 1, 3, 6])
def test_all_links_are_found(spark, distance):
    picks = np.random.default_rng(distance)
    base = picks.integers(0, 1 << 62, 60)
    near = [int(b) ^ sum(1 << int(i) for i in picks.choice(64, k, replace=False)) for b in base for k in range(8)]
    prints = sorted({simhash.signed(x) for x in near})
    up = {x: x for x in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    rows = durable(spark.createDataFrame([(x,) for x in prints], "fp long"))
    got = {r["node"]: r["component"] for r in simhash.link(rows, distance).collect()}
    assert got == {x: root(x) for x in prints}


def test_thresholds_cover_the_distance():
    picks = np.random.default_rng(5)
    bits = picks.random((4000, 64)) < np.linspace(0.05, 0.95, 64)
    bits[:, 10] = bits[:, 50]
    both = (bits.astype(int).T @ bits.astype(int)).astype(np.int64)
    prints = np.packbits(bits[: simhash.SAMPLE], axis=1, bitorder="little").view("<u8").ravel()
    for distance in (1, 4, 7):
        parts = simhash.choose(len(bits), both, distance, prints)
        assert sum(t + 1 for _, t in parts) == distance + 1
        assert len({i for group, _ in parts for i in group}) == sum(len(group) for group, _ in parts)
    assert any(10 in group and 50 in group for group in simhash.group_bits(len(bits), both, 3))


def test_candidate_estimates_know_of_correlation():
    picks = np.random.default_rng(6)
    half = picks.random((2000, 32)) < 0.5
    bits = np.repeat(half, 2, axis=1)  # bits 2i and 2i + 1 are the same
    both = (bits.astype(int).T @ bits.astype(int)).astype(np.int64)
    prints = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    group = list(range(12))
    found = simhash.within(len(bits), both, group, 3, prints)
    gaps = [(int(a) ^ int(b)) & 0xFFF for i, a in enumerate(prints[:300]) for b in prints[:i]]
    for t in range(4):
        assert found[t] == pytest.approx(sum(g.bit_count() <= t for g in gaps) / len(gaps), rel=0.2)
    assert simhash.within(2, both, group, 1, prints[:1])[0] > 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3), (50, 50)] + [(200, n) for n in range(201, 400)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(200, 400)} == {200}
    assert n_of(connected_components(spark.createDataFrame([], "a long, b long"))) == 0


def test_secrets(docs, empty):
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert n_of(secrets.scan(docs)) == len(ROWS) and n_of(secrets.scan(empty)) == 0
    assert [(s["start"], s["place"], s["stop"]) for s in found[9]] == [(0, 0, 27), (32, 1, 52)]
    assert found[4] == found[5] == []


def test_many_secrets_in_a_text(spark):
    for n in (255, 256, 257, 513, 20_000):
        rows = spark.createDataFrame([(1, "x 0123456789abcdef0 é" * n)], "doc_id long, text string")
        spans = secrets.scan(rows).first()["spans"]
        assert [(s["start"], s["stop"]) for s in spans] == [(21 * i + 2, 21 * i + 19) for i in range(n)]


def test_secret_spans_are_code_points(spark):
    text = "😀é token: ABCDEFGHIJKL0 \x01 secret='short' ghp_" + "a" * 36
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = {(s["start"], s["stop"]) for s in secrets.scan(rows).first()["spans"]}
    assert spans == {(3, 23), (text.index("ghp_"), len(text)), (text.index("a" * 36), len(text))}


def test_trigram_queries():
    assign, access, hex_ = (secrets.trigram_query(r.pattern) for r in secrets.BASE)
    assert hex_ == [] and frozenset({frozenset({"aki", "kia"})}) in access
    assert any(frozenset({"tok", "oke", "ken"}) in clause for clause in assign)


def test_toxicity(docs, empty, labels):
    for marks in (labels, labels.filter("false")):
        found = toxicity.score(docs, marks).collect()
        assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 for r in found)
        assert not any(r["held_out"] for r in found if r["doc_id"] is None)
    assert n_of(toxicity.score(empty, labels)) == 0


def test_toxicity_does_not_depend_on_partitions(spark, labels):
    rows = [(i, prose(60, i % 40) + (" you vile 1d10t " * 3 if i % 4 == 0 else ""), "en") for i in range(200)] + [(500, "ab", "en"), (501, "cd", "en"), (502, "é 你", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    one, seven = (sorted((r["doc_id"], r["score"], r["predicted"]) for r in toxicity.score(docs.repartition(n), marks).collect()) for n in (1, 7))
    assert one == seven and all(p == int(k < 200 and k % 4 == 0) for k, _, p in one)


def test_letters_count_by_text():
    assert (toxicity.joined_counts(["ab", "cd\0", ""]) == sum(toxicity.letter_counts(t) for t in ("ab", "cd\0", ""))).all()
    for letter in "azé你_1 ":
        assert toxicity._classes()[ord(letter)] == toxicity._class(letter)


@pytest.mark.parametrize("written", ["1d10t", "idiooot", "i d i o t", "i.d.i.o.t", "id!ot", "IDIOT"])
def test_disguises_are_undone(written):
    english = "the idiot in that tidy riot did not edit it and the pilot had to idle on a ridge " * 40
    model = toxicity.model_of(toxicity.letter_counts(english).astype(float))
    scorer = toxicity.Scorer(model, {"=idiot": 3.0})
    assert scorer.features(f"what an {written} you are")[0] == 3.0
    assert scorer.features("what a pilot you are in 2010")[0] == 0.0


def test_urls(spark):
    rows = [
        (1, "http://a.example.com/en/x", '<link rel="canonical" href="/other">'), (2, "https://b.example.com/fr/?utm_source=x#f", None),
        (3, None, "<html>"), (4, "no url", ""), (5, "http://shop.net/es/1", ""), (6, "http://mirror.org/1", "<meta http-equiv=refresh content='0; URL=http://shop.net/es/1'>"),
        (None, "http://www.example.com/en/", ""), (7, "http://MIRROR.org/1/", ""), (7, "http://MIRROR.org/1/", ""), (8, "://", ""), (9, "ftp://x.org?q", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "form", "rule", "class", "a", "component")})
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages).collect()]
    assert len(got) == len(rows)
    assert {x[0]: x[1:] for x in got} == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("b.example.com", "/fr/", "com/", "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("shop.net", "/es/1", "net/es/", "block"), 6: ("mirror.org", "/1", None, "block"), None: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        7: ("mirror.org", "/1/", None, "block"), 8: ("", "", None, "allow"), 9: ("x.org", "", None, "allow"),
    }
    assert n_of(url_filters.judge(pages.filter("false"))) == 0
    more = spark.createDataFrame([("http://x.org?q", "http://shop.net/es/1"), (None, "http://shop.net/es/1")], "src string, dst string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, redirects=more).collect()}[9] == "block"


def test_warc(spark, tmp_path):
    long = "x" * 300_000
    rows = [(1, "http://a/ ü\r\nx", "héllo"), (5, "http://a", "héllo"), (5, "http://a", "héllo"), (2, None, None), (3, "http://b", ""), (None, "http://c", long), (9, "http://c", "\r\n\r\nbody\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "head", "refers_to", "payload")})
    warc.archive_pages(pages, str(tmp_path / "w"))
    read = warc.read_warc(spark, str(tmp_path / "w"))
    got = {r["record_id"]: r for r in read.collect()}
    assert read.count() == len(rows) and got["urn:page:1"]["refers_to"] == "urn:page:5"
    assert got["urn:page:1"]["record_type"] == "revisit" and got["urn:page:1"]["payload_bytes"] == 6 and bytes(got["urn:page:1"]["payload"]) == b""
    assert bytes(got["urn:page:9"]["payload"]) == b"\r\n\r\nbody\r\n\r\n" and bytes(got["urn:page:5"]["payload"]).decode() == "héllo"
    assert got["urn:page:2"]["refers_to"] == "urn:page:3" and read.filter("record_type = 'response'").count() == 5
    assert bytes(got[""]["payload"]).decode() == long
    assert read.filter("record_type = 'revisit' and payload_digest = 'x'").count() == 0
    warc.archive_pages(pages.filter("false"), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0
    assert not [n for n in os.listdir(tmp_path / "w") if n.startswith("_")]


def test_warc_reader_pushes_and_skips(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    path = tmp_path / "a.warc.gz"
    import gzip

    path.write_bytes(warc.member(warc.record("r1", "http://a", b"one" * 5000, None)) + gzip.compress(warc.record("r2", "http://b", b"two", "r1")) + warc.member(warc.record("r3", "http://c", b"", None)))
    reader = warc.WarcReader({"path": str(path), "payload": "true"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("record_id",), ("r1", "r2", "r3")), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1
    (part,) = reader.partitions()
    rows = list(reader.read(part))
    assert [r[0] for r in rows] == ["r1", "r3"] and rows[0][-1] == b"one" * 5000
    plain = warc.WarcReader({"path": str(path), "payload": "false"})
    assert [(r[0], r[1], r[5], r[-1]) for r in plain.read(part)] == [("r1", "response", 15000, None), ("r2", "revisit", 3, None), ("r3", "response", 0, None)]


def test_large_archives_are_cut(spark, tmp_path):
    picks = random.Random(1)
    pages = [(i, f"http://a/{i}", "".join(picks.choice("0123456789abcdef") for _ in range(3000))) for i in range(400)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.archive_pages(rows, str(tmp_path / "one"))
    records = warc.with_revisits(rows).select(F.col("page_id").cast("string").alias("record_id"), F.col("url").alias("target_uri"), F.col("html").alias("payload"), "refers_to").coalesce(1)
    warc.write_warc(records, str(tmp_path / "many"), archive_bytes=100_000)
    archives = os.listdir(tmp_path / "many")
    assert len(archives) > 5 and all(n.endswith(".warc.gz") for n in archives)
    for folder in ("one", "many"):
        for size in (1, 50_000, 10**9):
            read = warc.read_warc(spark, str(tmp_path / folder), partition_bytes=size)
            got = sorted((r["target_uri"], bytes(r["payload"]).decode()) for r in read.collect())
            assert got == sorted(p[1:] for p in pages)
    assert len(warc.WarcReader({"path": str(tmp_path / "one"), "partitionBytes": "50000"}).partitions()) > 5


def test_archives_without_sizes_are_read_whole(tmp_path):
    import gzip

    path = tmp_path / "a.warc.gz"
    records = [warc.record(f"r{i}", "http://a", bytes([65 + i]) * 20_000, None) for i in range(9)]
    path.write_bytes(b"".join(warc.member(r) if i < 4 else gzip.compress(r) for i, r in enumerate(records)))
    reader = warc.WarcReader({"path": str(path), "partitionBytes": "100"})
    parts = reader.partitions()
    assert 1 < len(parts) <= 5
    assert sorted(r[0] for p in parts for r in reader.read(p)) == [f"r{i}" for i in range(9)]


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows = spark.range(200).select(
        F.col("id").cast("string").alias("record_id"), F.lit("http://a").alias("target_uri"),
        F.when(F.col("id") < 150, "x").otherwise(F.raise_error(F.lit("lost")).cast("string")).alias("payload"), F.lit(None).cast("string").alias("refers_to"),
    )
    with pytest.raises(Exception, match="lost"):
        warc.write_warc(rows.coalesce(1), str(tmp_path / "w"), archive_bytes=100)
    assert not os.path.exists(tmp_path / "w") or os.listdir(tmp_path / "w") == []


def test_chat_layouts(spark):
    turns = [("system", "Be < kind"), ("user", "a\\b"), ("assistant", "</turn>\n<turn user>")]
    records = [
        (1, '{"messages": [{"role": "system", "content": "Be < kind"}, {"role": "user", "content": "a\\\\b"}, {"role": "assistant", "content": "</turn>\\n<turn user>"}]}'),
        (2, '{"conversations": [{"from": "human", "value": "a\\\\b"}, {"from": "gpt", "value": "</turn>\\n<turn user>"}], "system": "Be < kind"}'),
        (3, '{"prompt": "a\\\\b", "completion": "</turn>\\n<turn user>", "system": "Be < kind"}'),
        (4, '{"instruction": "a\\\\b", "output": "</turn>\\n<turn user>", "input": "", "system": "Be < kind"}'),
        (5, '{"question": "a\\\\b", "answer": "</turn>\\n<turn user>", "system": "Be < kind"}'),
        (6, "not json"), (7, None), (8, '{"unknown": 1}'), (None, '{"messages": []}'), (9, "[1]"),
    ]
    rows = spark.createDataFrame(records, "conv_id long, record string").withColumns({c: F.lit("x") for c in ("layout", "turns", "formatted")})
    found = chat.format_chats(rows)
    back = {r["conv_id"]: r for r in found.withColumn("back", chat.read_back(F.col("formatted"), F.col("loss_spans"))).collect()}
    for k in range(1, 6):
        assert [(t["role"], t["text"]) for t in back[k]["back"]["turns"]] == turns, k
        assert back[k]["back"]["learned"] == ["</turn>\n<turn user>"]
    assert len({back[k]["formatted"] for k in range(1, 6)}) == 1 and len({back[k]["schema_id"] for k in range(1, 6)}) == 5
    assert all(back[k]["layout"] == "unknown" and back[k]["formatted"] == "" for k in (6, 7, 8, 9, None))
    assert n_of(chat.format_chats(rows.filter("false"))) == 0


@pytest.mark.parametrize(
    "record",
    [
        '{"messages": [{"role": "a", "content": "b"}, []]}', '{"messages": [{"role": "a", "content": "b"}, "c"]}', '{"messages[].role": 1, "messages[].content": 2}',
        '{"messages": [{"role": "a", "content": [{"text": "b"}]}, {"role": "a", "content": "b"}]}', "[" * 100_000, '{"a":' * 50_000, '{"messages": {"role": "a", "content": "b"}}',
        '{"prompt": {"x": 1}, "completion": "a"}', '{"": 1}', "null", '{"messages": [[{"role": "a", "content": "b"}]]}', '{"x": ' + "9" * 5000 + "}",
    ],
)
def test_malformed_records_are_unknown(record):
    assert chat.canonical(record, chat.known_layouts())[1:] == ("unknown", [])


def test_extra_fields_hide_no_layout(spark):
    records = [
        (1, '{"id": 7, "messages": [{"role": "user", "content": "a", "name": "x"}, {"role": "assistant", "content": null, "tool_calls": [{"id": 1}]}]}'),
        (2, '{"id": "x", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": ""}], "meta": {"source": "y"}}'),
        (3, '{"prompt": "a", "completion": "", "input": "left out"}'), (4, '{"instruction": "a", "output": "", "text": "all", "input": {"not": "text"}}'),
        (5, '{"question": "a\\ud800", "answer": "\\ud83d\\ude00", "x.y[]": {"\\udfff": 1}}'),
    ]
    rows = spark.createDataFrame(records, "conv_id long, record string")
    found = {r["conv_id"]: (r["layout"], chat.parse(r["formatted"]), r["schema_id"]) for r in chat.format_chats(rows).collect()}
    assert {k: v[0] for k, v in found.items()} == {1: "messages", 2: "conversations", 3: "prompt", 4: "instruction", 5: "question"}
    assert all(found[k][1] == [("user", "a"), ("assistant", "")] for k in range(1, 5)) and len({v[2] for v in found.values()}) == 5
    assert found[5][1] == [("user", "a\ufffd"), ("assistant", "\U0001f600")]


def test_very_long_texts_in_chats(spark):
    said = [(1, 0, "user", "</turn>\\" * 400_000), (1, 1, "assistant", "<turn é" * 300_000)]
    rows = chat.format_chats(chat.from_rows(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")))
    (r,) = rows.withColumn("back", chat.read_back(F.col("formatted"), F.col("loss_spans"))).collect()
    assert [tuple(t) for t in r["back"]["turns"]] == [x[2:] for x in said] and r["back"]["learned"] == [said[1][3]]


def test_rows_take_the_layout_of_their_shape(spark):
    said = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", ""), (2, 1, "user", "q"), (2, 2, "assistant", None), (3, 0, "user", "q")]
    rows = chat.format_chats(chat.from_rows(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")))
    found = {r["conv_id"]: (r["layout"], chat.parse(r["formatted"])) for r in rows.collect()}
    assert found == {1: ("prompt", [("user", "q"), ("assistant", "a")]), 2: ("instruction", [("system", ""), ("user", "q"), ("assistant", "")]), 3: ("messages", [("user", "q")])}


def test_chat_round_trip():
    picks = random.Random(2)
    pieces = ["\\", "<", "<turn", "</turn>", "\n", ">", "l", "g", "n", "assistant", " ", "é"]
    for _ in range(3000):
        turns = [("".join(picks.choice(pieces) for _ in range(picks.randrange(4))), "".join(picks.choice(pieces) for _ in range(picks.randrange(8)))) for _ in range(picks.randrange(4))]
        assert chat.parse(chat.render(turns)[0]) == turns


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "user", "late"), (2, 0, "user", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("messages", F.lit(1))
    found = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_chats(chat.from_rows(table)).collect()}
    assert found == {1: [("user", ""), ("assistant", "b"), ("assistant", "b")], None: [("", "x")], 2: [("user", "late"), ("user", "z")]}


def test_stages(spark, docs, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            out.write.mode("overwrite").parquet(str(tmp_path / "out"))
    assert pa.__version__
