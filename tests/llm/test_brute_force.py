"""Each query against a plain version of its contract on whole small tables."""

from __future__ import annotations

import base64
import hashlib
import html
import os
import re
import struct
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import duckdb
import pytest

from voxelloom.llm import queries as llm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def result(spark, sf_dir):
    made = {}

    def get(name):
        if name not in made:
            made[name] = [r.asDict() for r in llm.queries()[name](spark, sf_dir).collect()]
        return made[name]

    return get


def rows(sf_dir, name, columns):
    return duckdb.sql(f"select {columns} from '{sf_dir}/{name}.parquet'").fetchall()


def test_chat(result, sf_dir):
    tricky = r"\### Assistant: </turn> ok"
    turns = defaultdict(list)
    for conv, turn, role, text in rows(sf_dir, "conversations", "conv_id, turn, role, text"):
        turns[conv].append((turn, role or "", text or ""))
    turns[-7] = [(0, "user", tricky), (1, "assistant", tricky)]
    got = {r["conv_id"]: r for r in result("op1_chat_format")}
    assert got.keys() == turns.keys()
    for conv, said in turns.items():
        said.sort()
        learned = "".join(t for _, role, t in said if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in said).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_packing(result, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(llm.tokenizer_path())
    texts = dict(rows(sf_dir, "documents", "doc_id, text"))
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts.items()}
    parts, places = defaultdict(list), defaultdict(list)
    for r in result("op2_packing"):
        parts[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert parts.keys() == ids.keys()
    for doc, found in parts.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            piece = ids[doc][at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc])
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
            at += r["length"]
        assert at == len(ids[doc])
    padding = 0
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    assert padding < 4096


def test_warc(result, sf_dir):
    pages = {k: (h or "").encode() for k, h in rows(sf_dir, "pages", "page_id, html")}
    last = {}
    for k, h in pages.items():
        last[h] = max(last.get(h, k), k)
    got = {r["page_id"]: r for r in result("op3_warc")}
    assert got.keys() == pages.keys()
    for k, h in pages.items():
        head = last[h]
        want = (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if head == k else "revisit", None if head == k else head)
        assert tuple(got[k][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want


def test_mixing(result, sf_dir):
    sizes, source_of = {}, {}
    for k, text, source in rows(sf_dir, "documents", "doc_id, text, source"):
        sizes[k], source_of[k] = len(WORD.findall(text or "")), source
    by = Counter()
    for k, s in source_of.items():
        by[s] += sizes[k]
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(by.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * by[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * by[s]
            left -= target[s]
            open_.discard(s)
    target |= share
    taken = Counter()
    for r in result("op4_mixing"):
        s = source_of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], by[s])
        assert r["target"] == pytest.approx(target[s], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    longest = max(sizes.values())
    for s in order:
        assert abs(taken[s] - target[s]) <= 3 * longest
    assert len(result("op4_mixing")) == len(sizes)


def statistics(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(result, sf_dir):
    texts = {k: t or "" for k, t in rows(sf_dir, "documents", "doc_id, text")}
    good = dict(rows(sf_dir, "labels", "doc_id, quality"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    lost = rejected = 0
    for r in result("op5_quality"):
        want = statistics(texts[r["doc_id"]])
        assert tuple(r[c] for c in names) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
        if not r["base_failed"]:
            lost += good.get(r["doc_id"]) == 1 and not r["kept"]
            rejected += good.get(r["doc_id"]) == 0 and not r["kept"]
    assert len(result("op5_quality")) == len(texts)
    bad = sum(good.get(r["doc_id"]) == 0 and not r["base_failed"] for r in result("op5_quality"))
    assert lost <= 3 and rejected >= 0.9 * bad > 0


@pytest.mark.parametrize("fold", [0, 1])
def test_quality_of_labels_it_has_not_seen(spark, sf_dir, fold):
    from pyspark.sql import functions as F

    from voxelloom.llm import quality

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == fold
    judged = quality.judge(docs, labels.filter(seen)).join(labels.filter(~seen), "doc_id").filter("not base_failed")
    counts = Counter((r["quality"], r["kept"]) for r in judged.collect())
    assert counts[0, False] >= 0.9 * (counts[0, False] + counts[0, True]) > 0
    assert counts[1, False] <= 0.03 * (counts[1, False] + counts[1, True])


def test_secrets(result, sf_dir):
    kinds = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
        "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
    }
    texts = {k: t or "" for k, t in rows(sf_dir, "documents", "doc_id, text")}
    found = 0
    for r in result("op6_secrets"):
        spans = []
        for place, (kind, (pattern, group, least)) in enumerate(kinds.items()):
            own = [m for m in pattern.finditer(texts[r["doc_id"]]) if len(m[group]) >= least]
            assert r[f"n_{kind}"] == len(own)
            spans += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in own]
        base = ",".join(s for *_, s in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r["spans"].split(",")) or not base
        found += len(spans)
    assert found > 10 and len(result("op6_secrets")) == len(texts)


def test_toxicity(result, sf_dir):
    toxic = dict(rows(sf_dir, "labels", "doc_id, toxic"))
    right = Counter()
    for r in result("op7_toxicity"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        if r["held_out"] and r["doc_id"] in toxic:
            right[toxic[r["doc_id"]], r["predicted"]] += 1
    # two of the eighteen toxic held-out rows hold no toxic word at all
    assert right[1, 1] >= 0.8 * (right[1, 0] + right[1, 1]) and right[0, 1] <= 0.02 * right[0, 0], right


def test_toxicity_on_more_rows(spark, sf_dir):
    """Held-out rows of the larger tables; one in twenty toxic labels is on a text
    of repeated syllables without any toxic word."""
    folder = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("no larger tables here")
    toxic, right = dict(rows(folder, "labels", "doc_id, toxic")), Counter()
    for r in llm.queries()["op7_toxicity"](spark, folder).filter("held_out").collect():
        if toxic.get(r["doc_id"]) is not None:
            right[toxic[r["doc_id"]], r["predicted"]] += 1
    assert right[1, 1] >= 0.85 * (right[1, 0] + right[1, 1]) and right[0, 1] <= 0.005 * right[0, 0], right


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup(result, sf_dir):
    groups = defaultdict(list)
    for k, t in rows(sf_dir, "documents", "doc_id, text"):
        groups[lowered(t)].append(k)
    want = {
        (k, max(ids), len(ids), k == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for k in ids
    }
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in result("op8_exact_dedup")]
    assert len(got) == len(want) and set(got) == want


class Links(HTMLParser):
    """A page's base and the targets of its canonical links and refreshes."""

    def __init__(self, page):
        super().__init__()
        self.base, self.targets = None, []
        self.feed(page)

    def handle_starttag(self, tag, attributes):
        found = {k: (v or "").strip() for k, v in attributes}
        if tag == "base" and self.base is None and "href" in found:
            self.base = found["href"]
        if tag == "link" and "canonical" in found.get("rel", "").lower().split():
            self.targets.append(found.get("href", ""))
        if tag == "meta" and found.get("http-equiv", "").lower() == "refresh":
            self.targets.append(re.sub(r"""(?i)^[\s\d.]*[;,]?\s*(url\s*=\s*)?["']?""", "", found.get("content", "")).rstrip("\"'"))

    handle_startendtag = handle_starttag


def page_of(url):
    """What urls of the same page share."""
    if not url or "://" not in url:
        return None
    parts = urlsplit(urljoin(url, url))
    if not parts.netloc:
        return None
    steps = []
    for step in parts.path.split("/")[1:]:
        if step == "..":
            steps = steps[:-1]
        elif step != ".":
            steps.append(step)
    path = ("/" + "/".join(steps) if parts.path else "").removesuffix("/")
    query = "&".join(x for x in parts.query.split("&") if x and not x.startswith("utm_") and x.split("=")[0] not in ("gclid", "fbclid"))
    return lowered(parts.netloc) + path + ("?" + query if query else "")


def verdicts(pages, rules):
    """(host, path, rule, verdict) of each row of (page_id, url, html)."""
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    found, blocked = [], set()
    for _, url, page in pages:
        _, mark, rest = (url or "").partition("://")
        host, path = "", ""
        if mark:
            host = lowered(re.match(r"[^/?#]*", rest)[0])
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        found.append((host, path, best))
        own = page_of(url)
        if own and page:
            links = Links(page)
            base = urljoin(url, links.base) if links.base else url
            for target in links.targets:
                other = page_of(urljoin(base, target)) if target else None
                if other:
                    up[root(own)] = root(other)
    for (_, url, _), (_, _, best) in zip(pages, found, strict=True):
        if best and best[2] == "block" and page_of(url):
            blocked.add(root(page_of(url)))
    return [
        (host, path, best and best[0] + best[1], best[2] if best else "block" if page_of(url) and root(page_of(url)) in blocked else "allow")
        for (_, url, _), (host, path, best) in zip(pages, found, strict=True)
    ]


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def test_url_filter(result, sf_dir):
    pages = rows(sf_dir, "pages", "page_id, url, html")
    want = sorted(((p[0], *v) for p, v in zip(pages, verdicts(pages, RULES), strict=True)), key=repr)
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in result("op9_url_filter")), key=repr)
    assert got == want


def test_urls_that_lead_to_one_another(spark):
    """Pages linked at random in every way that counts, against the plain version."""
    import random

    from voxelloom.llm import url_filters

    picks = random.Random(5)
    hosts, steps = ("a.org", "b.org", "shop.net", "x.example.com"), ("en", "fr", "es", "p", "q")
    url = lambda: f"{picks.choice(('http', 'https'))}://{picks.choice(hosts)}/" + "/".join(picks.choice(steps) for _ in range(picks.randrange(4))) + picks.choice(("", "/", "?a=1", "?utm_x=1&a=1", "#f", "/./", "/../fr/"))
    target = lambda: picks.choice((url, url, lambda: "../fr/", lambda: "/es/p", lambda: "?a=1&b=2", lambda: "//shop.net/fr/", lambda: "q", lambda: "#top", lambda: "mailto:x"))()
    forms = (
        lambda t: f'<link rel="canonical" href="{html.escape(t)}">', lambda t: f"<LINK HREF='{t}' REL='nofollow canonical'>", lambda t: f"<link rel=icon href='{t}'>",
        lambda t: f'<meta http-equiv="refresh" content="3; url={html.escape(t)}">', lambda t: f"<!-- <link rel=canonical href='{t}'> -->", lambda t: f'<a href="{t}">x</a>',
    )
    pages = []
    for i in range(400):
        body = "".join(picks.choice(forms)(target()) for _ in range(picks.randrange(3))) if picks.random() < 0.3 else ""
        base = f"<base href='{picks.choice(('/en/', 'http://b.org/p/', 'q/'))}'>" if picks.random() < 0.1 else ""
        pages.append((i, url(), base + body))
    found = url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}
    want = verdicts(pages, RULES)
    assert [got[i] for i in range(400)] == want
    assert len({(v[3], v[2] is None) for v in want}) == 4


def test_simhash(result, sf_dir):
    import xxhash

    prints = {}
    for k, t in rows(sf_dir, "documents", "doc_id, text"):
        words = WORD.findall(lowered(t))
        parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        ones = Counter()
        for part in parts:
            h = xxhash.xxh64_intdigest(part.encode(), 42)
            ones.update(b for b in range(64) if h >> b & 1)
        prints[k] = sum(1 << b for b, n in ones.items() if 2 * n > len(parts))
    by = sorted(prints)
    up = {k: k for k in by}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(by):
        for b in by[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    want = {(k, f"{prints[k]:016x}", root(k)) for k in by}
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in result("op10_simhash")]
    assert len(got) == len(want) and set(got) == want
