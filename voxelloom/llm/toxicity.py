"""Toxicity scores over noisy-channel restored text.

Words that look disguised (letters mixed with look-alike digits and signs, torn
apart by spaces or dots, or drawn out by repetition) are restored: each written
character may stand for itself, for what it looks like, or for nothing, which
spans a lattice of letters, and the Viterbi path under a character language
model is the word. The model's trigram counts come from all texts. Labels then
tell which restored words and word beginnings mark a document as toxic; a
logistic curve over a document's marks gives its score.

Labels are learned from at most `toxic` and `clean` labelled training rows (the
least hashes of doc_id); every document is scored over its whole text. A mark
must have been seen after `contexts` different words, so that copies of one
text don't make marks of all its words.

Null and empty texts have no marks and get the curve's lowest value. Documents
with null doc_ids are scored, never learned from, and count as not held out.
Repeated rows score alike. Without labels of both kinds every score is the same,
below 1e-12. An empty table gives an empty result. Other columns are ignored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, in_small_batches

#: Classes of the language model: 0 no letter, 1 to 26 a to z, 27 other letters.
CLASSES = 28
#: What a sign may stand for, besides itself; fixed values of common disguises.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "+": "t", "|": "il", "(": "c", "€": "e", "£": "l",
}
GAPS = " .-_*~'"
#: Costs in nats: a look-alike, a skipped gap, a skipped repetition.
LOOK_COST, GAP_COST, REPEAT_COST = 1.0, 0.2, 1.0
#: A sign at a word's edge that may be plain punctuation, left out.
EDGE_COST = 2.0
PREFIXES = (4, 5, 6)
CACHED = 400_000
#: Characters of texts that are counted in one array.
JOINED = 200_000
#: A mark's log odds are held to this many standard errors below their estimate,
#: and have to stay above LEAST.
ERRORS, LEAST = 2.0, 1.0

_LETTER = re.compile(r"[^\W\d_]")
_DISGUISED = re.compile(r"[\d@$!+|(€£._*~'-]|([^\W\d_])\1\1")
_TORN = re.compile(r"(?<!\S)(?:[^\W_]|[@$!+|(€£])(?:\s+(?:[^\W_]|[@$!+|(€£])){3,}(?![^\s.,;:!?])")
_AROUND = ".,;:?\"'()[]{}<>«»“”‘’"
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    found = np.zeros(0x110000, np.int64)
    found[[i for i in range(0x110000) if chr(i).isalpha()]] = 27
    found[ord("a") : ord("z") + 1] = range(1, 27)
    return found


def letter_counts(text: str) -> np.ndarray:
    """How often each three classes follow one another in a text, blanks around it."""
    return joined_counts([text])


def joined_counts(texts: list[str]) -> np.ndarray:
    """The sum of letter_counts over texts, as one array: a class of its own
    stands between them, and what holds it is not counted."""
    codes = np.frombuffer("\0".join(f" {text.lower()} ".replace("\0", " ") for text in texts).encode("utf-32-le"), np.uint32)
    at = _classes()[codes]
    three = (at[:-2] * CLASSES + at[1:-1]) * CLASSES + at[2:]
    border = codes == 0
    return np.bincount(three[~(border[:-2] | border[1:-1] | border[2:])], minlength=CLASSES**3)


def letter_model(docs: DataFrame) -> np.ndarray:
    """-log P(c | a, b) from the counts of all texts; CLASSES ** 3 cells reach
    the driver, however large the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            few, size = [], 0
            for text in batch.column(0).drop_null():
                few.append(text.as_py())
                size += len(few[-1])
                if size >= JOINED:
                    total += joined_counts(few)
                    few, size = [], 0
            if few:
                total += joined_counts(few)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["cell", "n"])

    cells = in_small_batches(docs).select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3)
    for cell, n in cells:
        counts[cell] = n
    return model_of(counts)


def model_of(counts: np.ndarray) -> np.ndarray:
    three = counts.reshape(CLASSES, CLASSES, CLASSES)
    two = three.sum(0)
    backed = (two + 0.5) / (two + 0.5).sum(1, keepdims=True)
    return -np.log((three + 5 * backed[None]) / (three.sum(2, keepdims=True) + 5))


def _class(letter: str) -> int:
    """The same as _classes, for the few letters of a disguise."""
    if "a" <= letter <= "z":
        return ord(letter) - 96
    return 27 if letter.isalpha() else 0


def restore(written: str, model: np.ndarray) -> str:
    """The cheapest word that a lower-case writing may stand for; several with
    blanks between, if it holds white space."""
    first = next((i for i, c in enumerate(written) if c.isalnum()), len(written))
    last_at = len(written) - next((i for i, c in enumerate(reversed(written)) if c.isalnum()), 0)
    states: dict[tuple[int, int, str], tuple[float, tuple]] = {(0, 0, ""): (0.0, ())}
    for at, sign in enumerate(written):
        following: dict[tuple[int, int, str], tuple[float, tuple]] = {}
        options = [(sign, 0.0)] if sign.isalpha() else [(c, LOOK_COST) for c in LOOKS.get(sign, "")]
        is_gap = sign in GAPS or sign.isspace()
        for (a, b, last), (cost, word) in states.items():
            moves = [((b, _class(c), c), cost + extra + float(model[a, b, _class(c)]), (word, c)) for c, extra in options]
            if is_gap:
                moves.append(((a, b, last), cost + GAP_COST, word))
                if sign.isspace() and b:
                    moves.append(((b, 0, ""), cost + float(model[a, b, 0]), (word, " ")))
            elif sign == last or any(c == last for c, _ in options):
                moves.append(((a, b, last), cost + REPEAT_COST, word))
            elif not options:
                moves.append(((a, b, last), cost + LOOK_COST, word))
            elif not first <= at < last_at:
                moves.append(((a, b, last), cost + EDGE_COST, word))
            for state, total, spelt in moves:
                if state not in following or total < following[state][0]:
                    following[state] = (total, spelt)
        states = following
    word = min(((cost + float(model[a, b, 0]) * (b > 0), word) for (a, b, _), (cost, word) in states.items()), key=lambda x: x[0])[1]
    letters = []
    while word:
        word, letter = word
        letters.append(letter)
    return "".join(reversed(letters))


class Reader:
    """Words of texts with disguises undone, from a cache of what was written."""

    def __init__(self, model: np.ndarray):
        self.model, self.cache = model, {}

    def word(self, written: str) -> str:
        bare = written.strip(_AROUND)
        if _LETTER.search(bare) and _DISGUISED.search(bare):
            return restore(bare, self.model)
        return _EDGES.sub("", written)

    def torn(self, low: str) -> Iterator[str]:
        """The words of torn runs, and each run as one word."""
        for found in _TORN.finditer(low):
            if _LETTER.search(found.group()):
                words = restore(found.group(), self.model).split(" ")
                yield from words
                if len(words) > 1:
                    yield "".join(words)

    def words(self, text: str) -> Iterator[str]:
        """Words in order, torn ones after the others."""
        low = text.lower()
        for written in low.split():
            found = self.cache.get(written)
            if found is None:
                if len(self.cache) > CACHED:
                    self.cache.clear()
                found = self.cache[written] = self.word(written)
            yield found
        yield from self.torn(low)


def marks_of(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)] if len(word) > 2 else []


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """(text, toxic) of the bounded sample, one row per text."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~is_held_out(F.col("doc_id")))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    few = known.filter("toxic = 1").orderBy(*order).limit(toxic).unionByName(known.filter("toxic = 0").orderBy(*order).limit(clean))
    few = F.broadcast(durable(few))  # at most toxic + clean rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(few, "doc_id")
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("text", "toxic")


def log_odds(n: int, m: int, scale: float) -> float:
    """The lower bound of a mark's log odds from n toxic and m clean contexts."""
    return math.log((n + 0.5) / (m + 0.5)) + scale - ERRORS * math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))


def learn_marks(rows: DataFrame, model: np.ndarray, contexts: int) -> dict[str, float]:
    """Marks and their weights: the lower bound of the log odds that a text
    holding the mark is toxic. All marks are weighed that could pass if no clean
    text held them; rows is the bounded sample, and so are its marks."""

    def seen(wanted: frozenset[str] | None) -> DataFrame:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(model)
            for batch in batches:
                pairs = set()
                for text in batch.column(0):
                    before = ""
                    for word in reader.words(text.as_py()):
                        if wanted is None:
                            pairs.update((mark, before) for mark in marks_of(word))
                        else:
                            pairs.update((mark, before) for mark in marks_of(word) if mark in wanted)
                        before = word
                marks, others = zip(*pairs, strict=True) if pairs else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array(others, pa.string())], names=["mark", "before"])

        chosen = rows.filter(f"toxic = {1 if wanted is None else 0}").select("text")
        return in_small_batches(chosen).mapInArrow(read, "mark string, before string").groupBy("mark", "before").count().groupBy("mark").count()

    sizes = dict(rows.groupBy("toxic").agg(F.sum(F.length("text"))).collect())
    scale = math.log((sizes.get(0) or 1) / (sizes.get(1) or 1))
    # the fewest toxic contexts that pass without a clean one
    least = max(contexts, math.ceil((math.exp(LEAST + ERRORS * math.sqrt(2) - scale) - 1) / 2))
    bad = {r[0]: r[1] for r in seen(None).filter(F.col("count") >= least).collect()}
    good = {r[0]: r[1] for r in seen(frozenset(bad)).collect()} if bad else {}
    weights = {mark: log_odds(n, good.get(mark, 0), scale) for mark, n in bad.items()}
    return {mark: weight for mark, weight in weights.items() if weight > LEAST}


class Scorer:
    def __init__(self, model: np.ndarray, weights: dict[str, float]):
        self.reader, self.weights, self.known = Reader(model), weights, {}

    def weight(self, word: str) -> float:
        return max((self.weights.get(mark, 0.0) for mark in marks_of(word)), default=0.0)

    def features(self, text: str) -> tuple[float, float]:
        """The strongest mark, and the log of all marks' sum."""
        known, low = self.known, text.lower()
        found = []
        for written in set(low.split()):
            weight = known.get(written)
            if weight is None:
                if len(known) > CACHED:
                    known.clear()
                weight = known[written] = self.weight(self.reader.word(written))
            if weight:
                found.append(weight)
        found += [w for word in self.reader.torn(low) if (w := self.weight(word))]
        return (max(found), math.log1p(sum(sorted(found)))) if found else (0.0, 0.0)


def measured(rows: DataFrame, model: np.ndarray, weights: dict[str, float], keep: str, kind: str) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, weights)
        for batch in batches:
            found = [scorer.features(t.as_py() or "") for t in batch.column(1)]
            most, all_of = ([x[i] for x in found] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(most, pa.float64()), pa.array(all_of, pa.float64())], names=[keep, "most", "all"])

    return in_small_batches(rows).select(keep, "text").mapInArrow(measure, f"{keep} {kind}, most double, all double")


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a little shrinkage."""
    full = np.column_stack([np.ones(len(x)), x])
    w, shrink = np.zeros(full.shape[1]), np.diag([1e-6] + [0.1] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + shrink, full.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(
    docs: DataFrame, labels: DataFrame, toxic: int = 3000, clean: int = 9000, contexts: int = 6
) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    model = letter_model(docs)
    rows = durable(training_rows(docs, labels, toxic, clean))
    weights = learn_marks(rows, model, contexts)
    known = measured(rows, model, weights, "toxic", "int").toPandas()  # at most toxic + clean rows of three numbers
    known = known.sort_values(["toxic", "most", "all"])
    y = known["toxic"].to_numpy(float)
    curve = fit_curve(known[["most", "all"]].to_numpy(float), y) if 0 < y.sum() < len(y) else np.array([-30.0, 0, 0])
    found = measured(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, weights, "doc_id", "long")
    raw = F.lit(float(curve[0])) + F.col("most") * float(curve[1]) + F.col("all") * float(curve[2])
    p = 1 / (1 + F.exp(-raw))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), p.alias("score"), (p >= 0.7).cast("int").alias("predicted"))



