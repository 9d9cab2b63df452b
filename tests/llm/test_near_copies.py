"""The pipeline's near copies against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from voxelloom.llm import near_copies
from voxelloom.llm.common import durable


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_force(rows):
    """rows: (doc_id, text), distinct doc_ids."""
    of, up = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    ids, pairs = sorted(of), 0
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(of[a]) * 4 <= len(of[b]) * 5 and len(of[b]) * 4 <= len(of[a]) * 5:
                shared = len(of[a] & of[b])
                if 5 * shared >= 4 * (len(of[a]) + len(of[b]) - shared):
                    pairs += 1
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return sorted(k for k in ids if root(k) == k), pairs


def test_stage_reaches_four_fifths(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang")
    docs = durable(docs)
    want, pairs = kept_by_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    stay = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert stay.columns == docs.columns and pairs > 5
    assert sorted(r["doc_id"] for r in stay.collect()) == want


@pytest.fixture(scope="module")
def edited():
    """Texts of 1 to 400 words with edits at both sides of the bound, a cluster
    of many copies, a passage that all long ones share, and short and empty ones."""
    picks, rows = random.Random(7), []
    passage = [f"w{i}" for i in range(30)]
    for _ in range(40):
        words = [str(picks.randrange(10_000)) for _ in range(picks.choice((1, 4, 5, 6, 20, 100, 400)))]
        words += passage if len(words) > 50 else []
        for edits in (0, 1, 2, 4, 6, 8):
            new = list(words)
            for _ in range(edits * len(words) // 200 + (edits > 0)):
                new[picks.randrange(len(new))] = "edit"
            rows.append(" ".join(new))
    base = [str(picks.randrange(10_000)) for _ in range(200)]
    for i in range(60):
        new = list(base)
        new[picks.randrange(200)] = f"copy{i}"
        rows.append(" ".join(new).upper())
    rows += [None, "", " \n", "a", "A", "a b c d", "a b c d e"]
    return list(enumerate(rows))


def test_edited_copies(spark, edited):
    want, pairs = kept_by_force(edited)
    docs = spark.createDataFrame(edited, "doc_id long, text string")
    assert pairs > 1000 and sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == want


def components(nodes, pairs):
    up = {k: k for k in nodes}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {k: root(k) for k in up}


def test_fingerprints_come_first(spark, edited, monkeypatch):
    """The stage's first candidates connect all texts whose fingerprints link."""
    from voxelloom.llm import simhash

    seen, verify = [], near_copies.verified

    def watching(pairs, texts):
        near = verify(pairs, texts)
        seen.append(([tuple(r) for r in pairs.collect()], near.count()))
        return near

    monkeypatch.setattr(near_copies, "verified", watching)
    docs = spark.createDataFrame(edited, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == kept_by_force(edited)[0]
    texts = {r["node"]: r["text"] for r in near_copies.named(docs).collect()}
    prints = [(k, simhash.fingerprint(t.encode())) for k, t in sorted(texts.items())]
    close = [(a, b) for i, (a, p) in enumerate(prints) for b, q in prints[i + 1 :] if (p ^ q).bit_count() <= 7]
    found = [tuple(r) for r in near_copies.simhash_pairs(near_copies.named(docs)).collect()]
    assert set(found) <= set(close) and components(texts, found) == components(texts, close)
    assert len(seen) == 3 and set(seen[0][0]) <= set(found) and seen[0][1] > 50


@pytest.mark.parametrize("seed", range(3))
def test_listed_hashes_meet(seed):
    import numpy as np

    picks = np.random.default_rng(seed)
    for _ in range(300):
        n = int(picks.integers(1, 300))
        pool = picks.integers(-(1 << 62), 1 << 62, 2 * n)
        a = np.unique(pool[:n])
        cut = int(picks.integers(0, n // 9 + 1))
        b = np.unique(np.concatenate([a[picks.permutation(len(a))[cut:]], pool[n : n + cut]]))
        frequent = near_copies.Frequent(np.unique(picks.permutation(pool)[: n // 2]))
        if near_copies.are_near(set(a), set(b)):
            shared = set(near_copies.listed(a, frequent)) & set(near_copies.listed(b, frequent))
            assert len(shared) >= 1 + min(len(a), len(b)) // near_copies.STEP


@pytest.mark.parametrize("seed", range(3))
def test_parity_bits_never_exceed_what_differs(seed):
    import numpy as np

    picks = np.random.default_rng(seed)
    for n in (1, 5, 40, 300, 3000):
        pool = np.unique(picks.integers(-(1 << 62), 1 << 62, 2 * n))
        a, b = pool[: n + n // 3], pool[n // 4 :]
        bits = near_copies.parities(a) ^ near_copies.parities(b)
        differ = sum(int(x).bit_count() for x in bits.view(np.uint64))
        assert differ <= len(set(a) ^ set(b)) and len(bits) == near_copies.PARITY


def test_equal_shingles_have_equal_hashes():
    import numpy as np

    picks = random.Random(4)
    words = [picks.choice("abcdefgh") for _ in range(500)]
    text = " ".join(words).encode()
    found = near_copies.hashes(text)
    assert len(found) == len(near_copies.shingles(text)) and (np.diff(found) > 0).all()
    part = near_copies.hashes(b" ".join(text.split()[40:90]))
    assert np.isin(part, found).all()
    assert len({int(near_copies.hashes(t)[0]) for t in (b"", b"a", b"a a", b"a a a a", b"a a a a a")}) == 5


def test_a_crowd_below_the_bound_gives_few_pairs(spark, monkeypatch):
    """Copies that each share more with one text than with one another: pairs that
    can't be near don't come out of the join."""
    picks = random.Random(9)
    base, rows = [str(picks.randrange(10_000)) for _ in range(200)], []
    for i in range(300):
        new = list(base)
        for k in range(4 + i % 4):
            new[picks.randrange(200)] = f"w{i}x{k}"
        rows.append((i, " ".join(new)))
    counts, verify = [], near_copies.verified

    def counting(pairs, texts):
        counts.append(pairs.count())
        return verify(pairs, texts)

    monkeypatch.setattr(near_copies, "verified", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == kept_by_force(rows)[0]
    assert sum(counts) < 300 * 299 // 2 // 4


def join_rows(spark, since):
    """Rows out of the joins of entries in executions after one, and the last one's number."""
    store, rows, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    executions = store.executionsList()
    for i in range(executions.size()):
        number = executions.apply(i).executionId()
        last = max(last, number)
        nodes = store.planGraph(number).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size()) if number > since):
            if node.name().startswith("SortMergeJoin") and "[hx#" in node.desc():
                metrics, values = node.metrics(), store.executionMetrics(number)
                of = {metrics.apply(k).name(): metrics.apply(k).accumulatorId() for k in range(metrics.size())}
                rows += int(values.apply(of["number of output rows"]).replace(",", ""))
    return rows, last


def test_a_pair_comes_out_of_the_join_a_few_times(spark):
    """Long texts that share many listed shingles, and are too long for the bits to
    tell them apart: a row for each shared shingle would be hundreds for a pair."""
    picks, rows = random.Random(3), []
    base = [str(picks.randrange(100_000)) for _ in range(3000)]
    for i in range(40):
        new = list(base)
        for k in range(70 + i % 7):
            new[picks.randrange(len(new))] = f"w{i}x{k}"
        rows.append((i, " ".join(new)))
    since = join_rows(spark, -1)[1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == kept_by_force(rows)[0]
    assert join_rows(spark, since)[0] <= 4 * 40 * 39 // 2


def test_pairs_meet_wherever_their_first_shared_row_is(spark):
    picks = random.Random(5)
    sets = {node: sorted(picks.sample(range(400), picks.choice((1, 3, 40, 120)))) for node in range(60)}
    entries = spark.createDataFrame([(h, node) for node, hs in sets.items() for h in hs], "h long, node long")
    rows = near_copies.once(entries)
    x, y = (rows.select(*(rows[c].alias(f"{c}{s}") for c in rows.columns)) for s in "xy")
    met = [tuple(r) for r in x.join(y, (x["hx"] == y["hy"]) & (x["nodex"] < y["nodey"]) & near_copies.unmet()).select("nodex", "nodey").collect()]
    want = {(a, b) for a in sets for b in sets if a < b and set(sets[a]) & set(sets[b])}
    assert set(met) == want and len(met) < sum(len(set(sets[a]) & set(sets[b])) for a, b in want)


@pytest.mark.parametrize("shared, near", [(2700, True), (0, False)])
def test_fine_bits_keep_near_pairs(spark, shared, near):
    words = [f"a{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:shared] + [f"b{i}" for i in range(3000 - shared)]))]
    texts = spark.createDataFrame(rows, "node long, text string")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    found = near_copies.possible(pairs, texts).collect()
    assert [tuple(r) for r in found] == [(1, 2)] * near


def test_close_fingerprints_alone_link_nothing(spark, sf_dir):
    from voxelloom.llm import simhash

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id in (61, 777)").collect()}
    prints = [simhash.fingerprint(t.encode(), 4) for t in texts.values()]
    assert len(texts) == 2 and (prints[0] ^ prints[1]).bit_count() <= 7
    assert kept_by_force(list(texts.items())) == ([61, 777], 0)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert near_copies.keep_one(docs).count() == 2


@pytest.mark.parametrize("few", [0, 30, 10_000])
def test_few_links_are_put_in_groups_by_one_task(spark, few):
    from voxelloom.llm.common import connected_components

    picks = random.Random(8)
    edges = [(picks.randrange(-300, 300), picks.randrange(-300, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1200)] + [(None, 1), (2, None), (7, 7)]
    ends = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()
    assert len(found) == len({r["node"] for r in found}) and {r["node"]: r["component"] for r in found} == components({k for e in ends for k in e}, ends)
    assert connected_components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_the_stage_writes_few_tables(spark, edited):
    """Each table costs executors a plan, buffers and files."""
    from voxelloom import storage

    before = len(storage._made)
    near_copies.keep_one(spark.createDataFrame(edited, "doc_id long, text string")).count()
    assert len(storage._made) - before <= 75


def test_frequent_shingles_come_from_a_small_share(spark):
    """The guess orders shingles and must not hold those of twenty thousand texts."""
    docs = spark.range(15_000).selectExpr("id AS node", "concat_ws(' ', transform(sequence(1, 20), i -> concat(id, 'x', i)), 'one two three four five') AS text")
    docs = durable(docs)
    store = spark._jsparkSession.sharedState().statusStore()
    since = max([store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())], default=-1)
    assert len(near_copies.frequent_shingles(docs).sorted) == 1
    rows, executions = 0, store.executionsList()
    for number in (executions.apply(i).executionId() for i in range(executions.size())):
        nodes = store.planGraph(number).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size()) if number > since):
            if node.name().startswith("MapInArrow"):
                metrics, values = node.metrics(), store.executionMetrics(number)
                of = {metrics.apply(k).name(): metrics.apply(k).accumulatorId() for k in range(metrics.size())}
                rows += int(values.apply(of["number of output rows"]).replace(",", ""))
    assert 0 < rows <= 10_000 * 21
