"""Packing token sequences by minimum bin slack.

Documents become token ids, documents longer than a window are cut at window
ends, and the pieces fill windows so that each is as close to capacity as the
lengths that remain allow. Only the histogram of lengths (at most `capacity`
rows, whatever the input) reaches the driver, where a bitset subset-sum dynamic
program picks one multiset of lengths after another and applies it as often as
the counts allow. Pieces then find their place by their rank within their
length.

Null and empty texts are a document of the end token alone. Repeated rows and
repeated doc_ids are packed as often as they occur. An empty table gives an
empty result. Other columns are ignored."""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, in_small_batches, kept

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
#: Rows that one window task ranks on average at most.
RANKED = 50_000
#: Words whose ids a worker keeps in each of two generations.
CACHED_WORDS = 300_000
#: Texts tokenized at a time.
TEXTS = 256
LONGEST_CACHED = 64
#: New words in one string for the tokenizer, whose own tables for it then stay small.
TOGETHER = 200
WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: None of them is a letter, a number or white space: a run of them is one unit.
SIGNS = string.punctuation


class Words(dict):
    """Ids of words. Those that it lacks come over from `old`, the last generation;
    one that both lack is a hole, empty until its ids are put in."""

    def __init__(self, old: dict[str, bytes]):
        self.old = old
        self.holes: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytes | bytearray:
        ids = self.old.get(word)
        if ids is None:
            ids = self.holes[word] = bytearray()
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of texts as the tokenizer gives them, from a cache of their words.

    The tokenizer drops white space and never looks across it, so a text's ids
    are those of its words in order; it lower-cases, and it parts letters from
    signs, so a word and the signs after it are looked up apart. Words of Latin-1
    letters alone are one unit each that only lower-casing changes: the new ones
    of a batch go to the tokenizer's model together, without its other steps, and
    the ids of a unit end with one that ends words. Texts with a special token's
    opening, or with a separator that Python alone takes for white space, are
    left to the tokenizer as a whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.units = Tokenizer(self.tokenizer.model)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.units.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
        self.words = Words({})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def together(self, words: list[str]) -> list[bytes]:
        runs = [" ".join(words[at : at + TOGETHER]).lower() for at in range(0, len(words), TOGETHER)]
        found = self.units.encode_batch_fast(runs, add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(run.ids for run in found)), "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return [self.whole(w) for w in words]
        raw, stops = ids.tobytes(), (4 * stops).tolist()
        return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def learn(self) -> None:
        """Fill the holes of the cache."""
        cache, holes = self.words, self.words.holes
        every = latin("".join(holes))
        signed, plain, odd = [], [], []
        for word in list(holes):
            if not word.isalpha():
                letters = word.rstrip(SIGNS)
                if letters.isalpha() and (every or latin(letters)):
                    signed.append((holes.pop(word), cache[letters], cache[word[len(letters) :]], word))
        for word in holes:
            if word.isalpha() and len(word) <= LONGEST_CACHED and (every or latin(word)):
                plain.append(word)
            else:
                odd.append(word)
        if plain:
            for word, ids in zip(plain, self.together(plain), strict=True):
                holes[word] += ids
                cache[word] = ids
        for word in odd:
            cache[word] = ids = self.whole(word)
            holes[word] += ids
        for hole, letters, signs, word in signed:
            hole += letters + signs
            cache[word] = bytes(hole)
        holes.clear()

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHED_WORDS:
            self.words.old = {}
            self.words = Words(self.words)
        get, found = self.words.__getitem__, []
        for text in texts:
            if any(sign in text for sign in WHOLE):
                found.append([self.whole(text)])
                continue
            if text.isascii() or latin(text):
                text = text.lower()
            found.append(list(map(get, text.split())))
        self.learn()
        return list(map(b"".join, found))

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0]


def latin(text: str) -> bool:
    """Whether a text stays within Latin-1, where lower-casing has no context."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def tokenizer_of(path: str) -> WordTokenizer:
    """One for each Python worker, which keeps its words from task to task until
    an operator runs there that lets them go."""
    found = kept("packing")
    if path not in found:
        found.clear()
        found[path] = WordTokenizer(path)
    return found[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Cut each document's ids, with end_id after them, into pieces of at most
    capacity. `ids` holds them as little-endian unsigned 32-bit numbers."""
    end, width = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        names = ["doc_id", "start", "length", "ids", "doc_tokens"]
        for batch in batches:
            for part in (batch.slice(at, TEXTS) for at in range(0, batch.num_rows, TEXTS)):
                rows: list[list] = [[] for _ in names]
                texts = [text or "" for text in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.batch(texts), strict=True):
                    whole = ids + end
                    for at in range(0, len(whole), width):
                        cut_off = whole[at : at + width]
                        for column, value in zip(rows, (doc_id, at // 4, len(cut_off) // 4, cut_off, len(whole) // 4), strict=True):
                            column.append(value)
                yield arrow(rows, names)
        tokenizer.words.old = {}  # the worker may wait long for another task

    def arrow(rows: list[list], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECES)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, of those in counts, that holds the longest and
    comes closest to capacity: bit s of a bitset is set when sum s is reached."""
    longest = max(counts)
    reached, layers = 1 << longest, []
    full, mask = 1 << capacity, (1 << capacity + 1) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), (capacity - longest) // length)
        if left <= 0:
            continue
        layers.append((length, left, reached))
        step = 1
        while left > 0:
            take = min(step, left)
            reached |= reached << take * length & mask
            left -= take
            step *= 2
        if reached & full:
            break
    total, picked = reached.bit_length() - 1, {longest: 1}
    for length, left, before in reversed(layers):
        taken = next(k for k in range(left + 1) if total >= k * length and before >> total - k * length & 1)
        if taken:
            picked[length] = picked.get(length, 0) + taken
            total -= taken * length
    return picked


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, ranks, per_sequence, first_sequence, first_offset).

    A multiset is used as often as the counts allow, so that the number of
    multisets depends on how many lengths there are and not on the input."""
    left, used, rows, sequence = {k: n for k, n in counts.items() if n}, dict.fromkeys(counts, 0), [], 0
    while left:
        picked = fill(left, capacity)
        times, offset = min(left[k] // n for k, n in picked.items()), 0
        for length, n in picked.items():
            rows.append((length, used[length], n * times, n, sequence, offset))
            offset += n * length
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return rows


def pack(rows: DataFrame, capacity: int = 4096, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` from 1 to capacity.

    rows is read twice and should be durable. Rows that tie in `order` are
    interchangeable. Sequences hold no gap; what lacks to capacity is padding."""
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    buckets = 16
    while buckets * RANKED < sum(counts.values()):
        buckets *= 2
    keyed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = keyed.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base"))
    names = ("_length", "_first", "_n", "_per", "_sequence", "_offset")
    columns = zip(*(plan(counts, capacity) or [(0, 0, 0, 1, 0, 0)]), strict=True)
    # of an Arrow table, as rows would go through Python workers of their own
    places = spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in zip(names, columns, strict=True)}))
    at = F.col("_rank") - F.col("_first")
    fits = (F.col("length") == F.col("_length")) & (at >= 0) & (at < F.col("_n"))
    placed = ranked.join(F.broadcast(places), fits)  # as many rows as the lengths' multisets hold
    return placed.select(
        *rows.columns,
        (F.col("_sequence") + F.floor(at / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_per") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece with its place and the CRC-32 of its ids."""
    cut = pieces(docs, tokenizer_path, capacity, end_id)
    cut = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(durable(cut), capacity, ("doc_id", "start", "ids_crc32"))
