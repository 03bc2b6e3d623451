"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A text's statistics (shares of character kinds, word and line shapes, repetition) are standardised and mapped by random
Fourier features, which approximate a Gaussian kernel. Every partition sums its part of the normal equations over the
labelled rows; their total is solved for ridge weights. The raw score is then made a probability by isotonic regression
on labelled rows that the weights haven't seen.

Statistics are computed once for every whole text. The fit reads a bounded sample of labelled rows, FIT_ROWS about, chosen
by a hash; the parts of the normal equations come from FIT_PARTS tasks, so that what the driver adds up is bounded.

Defined cases: a null text has the statistics of an empty one and gets a score like any other; rows with a null label
aren't learned from; very long texts are read whole; of several labels of a document the largest counts; equal raw scores are
one place of the calibration; where the rows set aside for it, or the others, have one label only, all rows serve both; without
labelled rows every score is 0.5; repeated rows have equal scores; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import arrow_rows, cut
from larkspur.llm.text import column_bytes, slices, span_hashes, word_spans

FEATURES = 256
FIT_ROWS, FIT_PARTS = 200_000, 16
RIDGE = 1e-3
NAMES = (
    "log_words", "mean_word", "spread_word", "upper", "digit", "punctuation", "other_symbols", "exclamations", "non_ascii",
    "distinct_words", "top_word", "distinct_lines", "log_line_words", "short_lines", "capital_words", "symbol_words", "repeat_next", "sentence_ends",
)


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of statistics, in the order of NAMES, for each text."""
    rows = len(bounds) - 1
    n = np.diff(bounds).astype(float)
    chars = np.maximum(n, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(sums[bounds]) / chars

    starts, ends, first = word_spans(data, bounds)
    words = np.diff(first).astype(float)
    each = np.maximum(words, 1)
    owner = np.repeat(np.arange(rows), np.diff(first))
    length = (ends - starts).astype(float)
    per = lambda x: np.bincount(owner, x, rows)
    mean = per(length) / each
    spread = np.sqrt(np.maximum(per(length**2) / each - mean**2, 0))
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    plain = (data == 46) | (data == 44)
    symbol = ~letter & ~digit & ~plain & (data > 32)
    h = span_hashes(data, starts, ends)
    order = np.lexsort((h, owner))
    new = np.ones(len(h), dtype=bool)
    if len(h):
        new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=rows) / each
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(rows)
    np.maximum.at(top, owner[order][new], runs)
    same = np.zeros(len(h))
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    # lines: from one line feed to the next
    cuts = np.union1d(np.setdiff1d(np.flatnonzero(data == 10) + 1, bounds), bounds[:-1][n > 0])
    stops = np.append(cuts[1:], len(data)) if len(cuts) else cuts
    line_owner = np.searchsorted(bounds, cuts, side="right") - 1
    stops = np.minimum(stops, bounds[1:][line_owner]) if len(cuts) else stops
    lines = np.maximum(np.bincount(line_owner, minlength=rows), 1)
    line_hash = span_hashes(data, cuts, stops)
    distinct_lines = np.bincount(np.unique(np.stack([line_owner.astype(np.uint64), line_hash]), axis=1)[0].astype(np.int64), minlength=rows) / lines if len(cuts) else np.zeros(rows)
    short = np.bincount(line_owner, (stops - cuts) < 30, rows) / lines
    capital = per(upper[starts].astype(float)) / each if len(starts) else np.zeros(rows)
    ending = per((symbol[ends - 1] & (data[ends - 1] != 33) & (data[ends - 1] != 63)).astype(float)) / each if len(starts) else np.zeros(rows)
    stopped = per((data[ends - 1] == 46).astype(float)) / each if len(starts) else np.zeros(rows)
    return np.stack(
        [
            np.log1p(words), mean, spread, share(upper), share(digit), share(plain), share(symbol), share(data == 33), share(data >= 128),
            distinct, top / each, distinct_lines, np.log1p(words / lines), short, capital, ending, per(same) / each, stopped,
        ],
        axis=1,
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2.0 / self.directions.shape[1])
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.knots, self.levels)


def pooled(x: np.ndarray, y: np.ndarray) -> list[list[float]]:
    """The blocks of the non-decreasing least-squares fit of y to x, by pooling adjacent violators: sum, size, least and largest x."""
    order = np.argsort(x, kind="stable")
    places, first, sizes = np.unique(x[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(y[order].astype(float), first)
    blocks: list[list[float]] = []
    for place, total, size in zip(places, sums, sizes, strict=True):
        blocks.append([total, size, place, place])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total2, size2, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total2, blocks[-1][1] + size2, blocks[-1][2], high]
    return blocks


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the non-decreasing fit of y to x; levels are drawn a little from 0 and 1, the more the smaller the block."""
    blocks = pooled(x, y)
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    levels = np.array([v for b in blocks for v in ((b[0] + 0.5) / (b[1] + 1),) * 2])
    return knots, np.maximum.accumulate(levels)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of text, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(*column_bytes(batch.column("text")))
            flat = pa.array(x.astype(np.float32).ravel())
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)], names=["doc_id", "x"])

    arrow_rows(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def train(labelled: DataFrame, seed: int = 7) -> Model:
    """The model of labelled rows (x, label 0/1). Four fifths fit the weights, the rest calibrates."""
    labelled = labelled.where("label IS NOT NULL AND x IS NOT NULL")
    total = labelled.count()
    share = int(min(1.0, FIT_ROWS / max(total, 1)) * (1 << 30))
    hashed = labelled.select("x", F.col("label").cast("double").alias("label"), F.xxhash64("x", "label").alias("h"))
    sample = cut(hashed.where(F.pmod("h", F.lit(1 << 30)) < share).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(5))).repartition(FIT_PARTS))
    rng = np.random.default_rng(seed)
    wide = len(NAMES)
    model = Model(np.zeros(wide), np.ones(wide), rng.normal(0, 0.35, (wide, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    if total == 0:
        return model

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, a, b = 0, np.zeros(wide), np.zeros(wide)
        for batch in batches:
            x = _matrix(batch.column("x"))
            n, a, b = n + len(x), a + x.sum(axis=0), b + (x**2).sum(axis=0)
        yield pa.record_batch([pa.array([float(n)]), pa.array([a.tolist()]), pa.array([b.tolist()])], names=["n", "a", "b"])

    parts = sample.select("x").mapInArrow(moments, "n double, a array<double>, b array<double>").collect()
    n = sum(p["n"] for p in parts)
    model.mean = np.sum([p["a"] for p in parts], axis=0) / n
    model.scale = np.sqrt(np.maximum(np.sum([p["b"] for p in parts], axis=0) / n - model.mean**2, 1e-8))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for batch in batches:
            z, y = model.features(_matrix(batch.column("x"))), batch.column("label").to_numpy()
            gram, target, n = gram + z.T @ z, target + z.T @ y, n + len(y)
        yield pa.record_batch([pa.array([float(n)]), pa.array([gram.ravel().tolist()]), pa.array([target.tolist()])], names=["n", "gram", "target"])

    labels = {r["held"]: r["labels"] for r in sample.groupBy((F.col("part") == 0).alias("held")).agg(F.count_distinct("label").alias("labels")).collect()}
    apart = min(labels.get(True, 0), labels.get(False, 0)) > 1
    parts = (sample.where("part <> 0") if apart else sample).select("x", "label").mapInArrow(equations, "n double, gram array<double>, target array<double>").collect()
    gram = np.sum([p["gram"] for p in parts], axis=0).reshape(FEATURES + 1, FEATURES + 1)
    n = max(1.0, sum(p["n"] for p in parts))
    model.weights = np.linalg.solve(gram + RIDGE * n / FEATURES * np.eye(FEATURES + 1), np.sum([p["target"] for p in parts], axis=0))

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(model.raw(_matrix(batch.column("x")))), batch.column("label")], names=["raw", "label"])

    held = (sample.where("part = 0") if apart else sample).select("x", "label").mapInArrow(raws, "raw double, label double").toPandas()
    model.knots, model.levels = isotonic(np.round(held.raw.to_numpy(), 6), held.label.to_numpy())
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of stats (doc_id, x)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column("doc_id"), pa.array(shared.value.scores(_matrix(batch.column("x"))))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text), learned from labels (doc_id, label)."""
    stats = cut(with_statistics(docs))
    known = labels.where("label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    model = train(stats.join(known, "doc_id").select("x", "label"))
    return score(stats, model)
