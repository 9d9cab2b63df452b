"""Quality rules with an isolation forest on their statistics.

Every document gets the statistics of the rules, exactly and over its whole
text. Documents that fail a base rule are rejected. For the others, a forest of
random splits measures how soon they stand alone among the labelled good and
bad documents it was fitted on; the score above which a document is rejected is
calibrated on the labelled rows so that at most `lost` of the good ones go.

All labelled rows count: the box that trees split and the threshold come from
every one of them. Each tree grows on `per_tree` rows, drawn from all good ones,
as isolation forests are defined: on all rows at once, crowds would hide what is
odd. Statistics, scores and verdicts cover all rows. Without labelled rows
nothing is rejected but by base rules.

Null and empty texts have no words and fail the base rule. Null doc_ids are
scored like others but never join a label. Repeated rows are judged alike; of
rows that share a labelled doc_id, the one with the least statistics is learned
from. An
empty table gives an empty result. Other columns are ignored or kept."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Filter, at_rest, durable, in_small_batches, lookup, running

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
NAMES = [part.split()[0] for part in STATISTICS.split(", ")]
#: Columns of `features`.
AXES = ["chars", "symbols", "dup_lines", "repeats"]
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(i for i in range(256) if i not in _SYMBOLS)
_CONTINUES = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes]) -> int:
    """Words that some 3-word window covers which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    size = len(ids)
    if size < 2_000_000:
        key = (at[:-2] * size + at[1:-1]) * size + at[2:]
    else:
        pair = np.unique(at[:-2] * size + at[1:-1], return_inverse=True)[1]
        key = pair * size + at[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """The rules' statistics of one UTF-8 text, in the order of NAMES."""
    words = text.split()
    chars = len(text.translate(None, _CONTINUES + _SPACE))
    symbols = len(text.translate(None, _NOT_SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def measured(texts: pa.Array) -> pd.DataFrame:
    rows = [statistics((t.as_py() or "").encode()) for t in texts]
    return pd.DataFrame(np.array(rows, np.int64).reshape(-1, len(NAMES)), columns=NAMES)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics, one row per document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = measured(batch.column(1))
            arrays = [batch.column(0), *(pa.array(rows[n], pa.int64()) for n in NAMES)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *NAMES])

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(at_rest(measure), f"doc_id long, {STATISTICS}")


def features(rows: pd.DataFrame) -> np.ndarray:
    """Ratios that don't depend on a text's length."""
    words = np.maximum(rows["n_words"].to_numpy(float), 1)
    return np.stack(
        [
            rows["word_chars"].to_numpy(float) / words,
            np.log1p(100 * rows["n_symbols"].to_numpy(float) / np.maximum(rows["word_chars"].to_numpy(float), 1)),
            np.log1p(100 * rows["n_dup_lines"].to_numpy(float) / words),
            np.log1p(100 * rows["n_repeat_words"].to_numpy(float) / words),
        ],
        axis=1,
    )


def _expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth at which a random tree isolates one of n points."""
    n = np.asarray(n, float)
    deep = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def draws(n: int, trees: int, per_tree: int, seed: int = 7) -> list[np.ndarray]:
    """For each tree, which of n points it grows on."""
    random = np.random.default_rng(seed)
    return [random.choice(n, min(per_tree, n), replace=False) for _ in range(trees)]


class IsolationForest:
    """Trees as flat arrays: split column (-1: leaf), split value, children, depth.

    Trees grow on usual points, but split anywhere in the box that all known
    points span, so that what lies where no usual point does is isolated soon.
    `drawn` holds the rows of `points` that each tree grows on."""

    def __init__(
        self, points: np.ndarray, box: np.ndarray, trees: int = 100, per_tree: int = 256, seed: int = 7, drawn: list[np.ndarray] | None = None
    ):
        random = np.random.default_rng(seed)
        drawn = draws(len(points), trees, per_tree, seed) if drawn is None else drawn
        self.size = len(drawn[0])
        limit = 2 * math.ceil(math.log2(max(self.size, 2)))
        low, high = box.min(0), box.max(0)
        self.trees = [self._grow(points[rows], low, high, limit, random) for rows in drawn]

    def _grow(
        self, points: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int, random: np.random.Generator
    ) -> tuple[np.ndarray, ...]:
        column, value, left, right, depth = [], [], [], [], []

        def node(rows: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> int:
            at = len(column)
            for x, y in ((column, -1), (value, 0.0), (left, -1), (right, -1), (depth, level + float(_expected_path(len(rows))))):
                x.append(y)
            wide = np.flatnonzero(high > low)
            if level < limit and len(rows) > 1 and len(wide):
                j = int(random.choice(wide))
                cut = float(random.uniform(low[j], high[j]))
                below = rows[:, j] <= cut
                column[at], value[at] = j, cut
                middle = np.where(np.arange(len(low)) == j, cut, high), np.where(np.arange(len(low)) == j, cut, low)
                left[at] = node(rows[below], low, middle[0], level + 1)
                right[at] = node(rows[~below], middle[1], high, level + 1)
            return at

        node(points, low, high, 0)
        return tuple(map(np.array, (column, value, left, right, depth)))

    def scores(self, points: np.ndarray) -> np.ndarray:
        """0 to 1; near 1 when isolated at once."""
        total = np.zeros(len(points))
        for column, value, left, right, depth in self.trees:
            at = np.zeros(len(points), int)
            while True:
                inner = column[at] >= 0
                if not inner.any():
                    break
                rows, nodes = np.flatnonzero(inner), at[inner]
                below = points[rows, column[nodes]] <= value[nodes]
                at[rows] = np.where(below, left[nodes], right[nodes])
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_expected_path(self.size)), 1e-9))


def calibrate(scored: DataFrame, lost: float) -> float:
    """scored: score, good. The score that rejects the most bad rows, less the
    good ones it costs, while at most the share `lost` of the good ones score
    above it; the least of such scores. All rows are ranked, in ranges."""
    tally = scored.groupBy("score").agg(F.count_if("good").alias("fine"), F.count_if(~F.col("good")).alias("bad"))
    tally = running(tally, (F.desc("score"),), "place", more_fine="fine", more_bad="bad")
    fine, bad = tally.agg(F.sum("fine"), F.sum("bad")).first()
    if not fine:
        return math.inf
    tries = tally.filter(F.col("more_fine") <= fine - 1 - math.ceil((fine - 1) * (1 - lost)))
    gain = [F.desc(F.col("more_bad") / bad - F.col("more_fine") / fine)] if bad else []
    return tries.orderBy(*gain, "score").first()["score"]


class Judge:
    """A forest and its threshold; without a forest nothing is anomalous."""

    def __init__(self, forest: IsolationForest | None = None, limit: float = math.inf):
        self.forest, self.limit = forest, limit

    def verdicts(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base_failed, score and kept of each row of statistics."""
        words = rows["n_words"].to_numpy(np.int64)
        failed = (words < 50) | (100 * rows["n_repeat_words"].to_numpy(np.int64) > 50 * words)
        scores = self.forest.scores(features(rows)) if self.forest else np.zeros(len(rows))
        return failed, scores, ~failed & (scores <= self.limit)


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and quality, once; of contradicting labels the least."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    marked = marked.filter("doc_id is not null and quality is not null")
    return durable(marked.groupBy("doc_id").agg(F.min("quality").alias("quality")))


def grown(known: DataFrame, trees: int, per_tree: int) -> IsolationForest | None:
    """A forest on the rows of `known`, their features in AXES, that its trees draw.
    Only those, at most trees * per_tree rows of numbers, come to the driver."""
    ends = [f(axis) for f in (F.min, F.max) for axis in AXES]
    n, n_good, *box = known.agg(F.count("*"), F.count_if("good"), *ends).first()
    if n < 2:
        return None
    usual = running(known.filter("good") if n_good > 1 else known, (F.col("doc_id"),), "place")
    drawn = draws(n_good if n_good > 1 else n, trees, per_tree)
    places = np.unique(np.concatenate(drawn))
    few = known.sparkSession.createDataFrame(pa.table({"place": pa.array(places, pa.int64())}))
    few = usual.join(F.broadcast(few), "place").select("place", *AXES).toPandas().sort_values("place")
    rows = [np.searchsorted(places, at) for at in drawn]
    return IsolationForest(few[AXES].to_numpy(), np.array(box).reshape(2, -1), drawn=rows)


def fit(measured_rows: DataFrame, marked: DataFrame, trees: int = 100, per_tree: int = 256, lost: float = 0.002) -> Judge:
    """From the statistics of all rows that have a label in `marked`, or of more."""
    rows = lookup(measured_rows, marked, "doc_id", "inner")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(*NAMES)).alias("_s")).select("doc_id", "quality", "_s.*")
    rows = rows.filter("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array(batch.column(1).to_numpy(zero_copy_only=False) == 1)
            axes = features(batch.to_pandas()).T
            yield pa.RecordBatch.from_arrays([batch.column(0), good, *map(pa.array, axes)], names=["doc_id", "good", *AXES])

    known = durable(rows.mapInArrow(place, "doc_id long, good boolean, " + ", ".join(f"{axis} double" for axis in AXES)))
    forest = grown(known, trees, per_tree)
    if forest is None:
        return Judge()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = forest.scores(batch.select(AXES).to_pandas().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(scores), batch.column(1)], names=["score", "good"])

    scored = durable(known.mapInArrow(score, "score double, good boolean"))
    return Judge(forest, calibrate(scored, lost))


def judge(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """doc_id, the statistics, base_failed, score and kept, in one pass over texts."""
    rows = durable(rule_statistics(docs))
    judged = fit(rows, known_labels(labels), **options)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [pa.array(x) for x in judged.verdicts(batch.to_pandas())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["doc_id", *NAMES, "base_failed", "score", "kept"])

    kind = f"doc_id long, {STATISTICS}, base_failed boolean, score double, kept boolean"
    return rows.mapInArrow(decide, kind)


def keep_good(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The documents that pass, columns unchanged. Texts are not shuffled, and are
    measured once more only where they have a label or the filter of labels is full."""
    marked = known_labels(labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.col("doc_id"))
    labelled = Filter(marked.withColumnRenamed("doc_id", "digest")).told(own).filter("may")
    judged = fit(durable(rule_statistics(labelled)), marked, **options)
    at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judged.verdicts(measured(batch.column(at)))[2]))

    return in_small_batches(docs).mapInArrow(at_rest(choose), docs.schema)
