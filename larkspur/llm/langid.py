"""Language identification by interpolated Kneser-Ney character models.

Each language has a 4-gram model over lower-cased letters (runs of other characters count as one blank). The models are
kept together in sorted arrays of 64-bit hashes, one for each order: beside each hash stand the log-probabilities that
all languages give that n-gram, so that one look-up serves all. A directory over the hashes' first bits makes it a
look-up of a few steps. What is unseen in every language backs off with each language's interpolation weight.

The language of least length-normalised cross-entropy is chosen. Rejection is calibrated: a text is cut into windows, each
scored by the language that suits it best, so that texts that mix known languages count as known; the mean of that lies above
its language's by some nats a symbol. Calibration documents that the models haven't seen, and pieces of them of every length,
tell how far known texts of a length lie above, and a text is rejected when it lies farther than all but FALSE_RATE of those
and a margin.

Training reads a bounded sample of labelled rows: of each language about TRAIN_DOCS documents and TRAIN_CHARS characters at most,
chosen by a hash.

Defined cases: a null text, or one without letters (digits, signs, emoji), is `und` with score 0 and rejected; letters beyond
the basic plane are letters like others; very long texts are read whole, in bounded pieces of memory; of languages with equal cross-entropy the
first by name is chosen; repeated rows have equal results; without any labelled row everything is `und`; an empty table gives
an empty result; extra columns are not read by predict(), and kept as they are by accepted().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import arrow_rows
from larkspur.llm.text import directory, slices, splitmix

ORDER = 4
TRAIN_DOCS, TRAIN_CHARS = 2000, 8_000_000
#: Symbols of a window; the share of known texts beyond the calibrated limit, and what is added to that in nats.
WINDOW, FALSE_RATE, MARGIN = 64, 0.001, 0.2
#: Lengths in symbols for which limits are measured, doubling; pieces of a document for each; log-probabilities held at once.
SHORTEST, LEVELS, PIECES, HELD = 8, 12, 4, 1 << 21
#: Characters that count at most in the score's certainty.
CERTAIN = 60
_BLANK = 32
_RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("deviation", pa.float64()), ("rejected", pa.bool_())])


def letter_table() -> np.ndarray:
    """For each code point of the basic plane, itself if it is a letter, or else the blank."""
    return np.array([c if chr(c).isalpha() else _BLANK for c in range(1 << 16)], dtype=np.uint16)


def beyond(points: np.ndarray) -> np.ndarray:
    """Symbols of code points beyond the basic plane: letters are dealt over its 8448 values that no letter has, the rest are blanks."""
    kinds, at = np.unique(points, return_inverse=True)
    codes = 0xD800 + splitmix(kinds.astype(np.uint64)) % np.uint64(0x2100)
    return np.where([chr(c).isalpha() for c in kinds.tolist()], codes, _BLANK).astype(np.uint16)[at]


def symbols(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' symbols one after another, each text led and ended by a blank; len + 1 offsets; letters in each."""
    lowered = [(x or "").lower() for x in texts]
    points = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(x) + 1 for x in lowered], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    s = letters[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        s[high] = beyond(points[high])
    letter = s != _BLANK
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    at = np.cumsum(keep)
    bounds = np.concatenate([[0], at])[starts]
    counts = np.concatenate([[0], np.cumsum(letter)])
    return s[keep], bounds, np.diff(counts[np.minimum(starts, len(letter))])


def grams(s: np.ndarray, order: int) -> np.ndarray:
    """For every symbol from the second on, itself and the order - 1 before it, as one integer; blanks stand before the first."""
    wide = s.astype(np.uint64)
    out = wide[1:].copy()
    for k in range(1, order):
        shifted = np.full(len(wide) - 1, _BLANK, dtype=np.uint64)
        shifted[max(0, k - 1) :] = wide[: len(wide) - max(k, 1)] if k else wide
        out |= shifted << np.uint64(16 * k)
    return out


@dataclass
class HashTable:
    """Sorted hashes with a row of values each, and a directory over their first bits."""

    hashes: np.ndarray
    values: np.ndarray
    bits: int = 0
    directory: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    longest: int = 1

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> HashTable:
        hashes = splitmix(keys.astype(np.uint64))
        order = np.argsort(hashes)
        hashes = hashes[order]
        bits = max(1, min(20, int(np.ceil(np.log2(max(len(keys), 1) * 2 + 1)))))
        starts = directory(hashes, bits)
        return cls(hashes, values[order].astype(np.float32), bits, starts, int(np.diff(starts).max(initial=1)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(keys), -1, dtype=np.int64)
        h = splitmix(keys)
        at = self.directory[(h >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        last = len(self.hashes) - 1
        np.minimum(at, last, out=at)
        out = np.where(self.hashes[at] == h, at, -1)
        todo = np.flatnonzero((out < 0) & (self.hashes[at] < h))
        for _ in range(self.longest):
            if not len(todo):
                break
            at[todo] = np.minimum(at[todo] + 1, last)
            there = self.hashes[at[todo]]
            hit = there == h[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[(there < h[todo]) & (at[todo] < last)]
        return out


@dataclass
class Model:
    languages: list[str]
    #: By order from 1: n-grams with their log-probabilities.
    grams: list[HashTable]
    #: By order from 2: contexts with the logarithm of the weight that goes to the order below.
    contexts: list[HashTable]
    floor: np.ndarray
    #: Each language's mean cross-entropy by windows; by length, from SHORTEST on doubling, how far above it known texts lie.
    mean: np.ndarray
    limits: np.ndarray

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """len(keys) rows of every language's natural log-probability of the last symbol after the others."""
        order = len(self.grams)
        rows = self.grams[order - 1].find(keys)
        out = self.grams[order - 1].values[rows]
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            out[missing] = self._below(keys[missing], order)
        return out

    def _below(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 1:
            return np.broadcast_to(self.floor, (len(keys), len(self.languages))).astype(np.float32)
        context = self.contexts[order - 2]
        rows = context.find(keys >> np.uint64(16))
        weight = np.where((rows >= 0)[:, None], context.values[rows] if len(context.values) else 0.0, 0.0)
        shorter = keys & np.uint64((1 << (16 * (order - 1))) - 1)
        found = self.grams[order - 2].find(shorter)
        out = self.grams[order - 2].values[found] if len(self.grams[order - 2].values) else np.zeros((len(keys), len(self.languages)), np.float32)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            out[missing] = self._below(shorter[missing], order - 1)
        return out + weight.astype(np.float32)

    def entropies(self, s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the cross-entropy of a symbol in nats by language, that by each window's best one, and the number of symbols."""
        sizes = np.diff(bounds)
        n, texts, languages = np.maximum(sizes, 1), len(sizes), len(self.languages)
        if len(s) < 2:
            return np.zeros((texts, languages)), np.zeros(texts), n
        parts = -(-sizes // WINDOW)
        first = np.concatenate([[0], np.cumsum(parts)])
        edges = np.repeat(bounds[:-1] - first[:-1] * WINDOW, parts) + np.arange(first[-1]) * WINDOW
        sums = np.zeros((len(edges), languages))
        keys = grams(s, len(self.grams))
        step = max(WINDOW, HELD // languages)
        for low in range(0, len(keys), step):
            part = self.logs(keys[low : low + step])
            a, b = np.searchsorted(edges, [low, low + len(part)], side="left")
            a -= a == len(edges) or edges[a] > low
            cuts = np.maximum(edges[max(a, 0) : b] - low, 0)
            sums[max(a, 0) : b] -= np.add.reduceat(part, cuts, axis=0, dtype=np.float64)
        owner = np.repeat(np.arange(texts), parts)
        whole = np.stack([np.bincount(owner, sums[:, k], texts) for k in range(languages)], axis=1)
        return whole / n[:, None], np.bincount(owner, sums.min(axis=1), texts) / n, n

    def deviations(self, s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """entropies() without the windows, the best language, and how far above it a text lies, 1 being its length's limit."""
        h, windows, n = self.entropies(s, bounds)
        best = h.argmin(axis=1)
        level = np.clip(np.log2(n / SHORTEST).astype(np.int64), 0, len(self.limits) - 1)
        return h, n, best, (windows - self.mean[best]) / self.limits[level]


def kneser_ney(counts: dict[int, tuple[np.ndarray, np.ndarray]], languages: list[str]) -> Model:
    """The model of 4-gram counts: for each language's index its distinct n-grams, sorted, and how often they occur."""
    masks = [np.uint64((1 << (16 * k)) - 1) if k < 4 else np.uint64(0xFFFFFFFFFFFFFFFF) for k in range(ORDER + 1)]
    per: list[list[dict]] = []
    for one in range(len(languages)):
        keys, n = counts[one]
        orders: list[dict] = [{} for _ in range(ORDER + 1)]
        n = n.astype(np.float64)
        for k in range(ORDER, 0, -1):
            ones, twos = np.sum(n == 1), np.sum(n == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, first, kinds = np.unique(keys >> np.uint64(16), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first)
            orders[k] = {"keys": keys, "n": n, "discount": discount, "context": context, "total": total, "weight": discount * kinds / total}
            lower, n = np.unique(keys & masks[k - 1], return_counts=True)
            keys, n = lower, n.astype(np.float64)
        per.append(orders)
    alphabet = np.unique(np.concatenate([o[1]["keys"] for o in per]))
    uniform = 1.0 / (len(alphabet) + 1)

    def lookup(keys: np.ndarray, table: np.ndarray, values: np.ndarray, absent: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, values[at], absent)

    def probability(one: int, keys: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full(len(keys), uniform)
        o = per[one][k]
        seen = lookup(keys, o["keys"], np.maximum(o["n"] - o["discount"], 0), 0.0)
        total = lookup(keys >> np.uint64(16), o["context"], o["total"], np.inf)
        weight = lookup(keys >> np.uint64(16), o["context"], o["weight"], 1.0)
        return seen / total + weight * probability(one, keys & masks[k - 1], k - 1)

    tables, contexts = [], []
    for k in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([o[k]["keys"] for o in per]))
        tables.append(HashTable.of(keys, np.log(np.stack([probability(one, keys, k) for one in range(len(languages))], axis=1))))
        if k > 1:
            context = np.unique(np.concatenate([o[k]["context"] for o in per]))
            contexts.append(HashTable.of(context, np.log(np.stack([lookup(context, o[k]["context"], o[k]["weight"], 1.0) for o in per], axis=1))))
    floor = np.log(np.array([o[1]["weight"][0] * uniform for o in per]))
    return Model(languages, tables, contexts, floor, np.zeros(len(languages)), np.full(LEVELS, np.inf))


def train(rows: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """The model of labelled rows (text, lang); None if there are none.

    A fifth of the sample isn't counted but calibrates rejection.
    """
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("h"))
    sizes = {r["lang"]: (r["docs"], r["chars"]) for r in rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, int(min(1.0, train_docs / sizes[k][0], TRAIN_CHARS / max(1, sizes[k][1])) * (1 << 30)))))
    sample = rows.where(F.col("h") < share[F.col("lang")]).select("text", F.col("lang").alias("l"), F.pmod(F.xxhash64("h"), F.lit(5)).alias("part"))
    index = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        found: dict[int, list] = {i: [] for i in range(len(languages))}
        for batch in slices(batches):
            groups: dict[int, list[str]] = {}
            for text, lang, part in zip(*(batch.column(c).to_pylist() for c in ("text", "l", "part")), strict=True):
                if part != 0:
                    groups.setdefault(index[lang], []).append(text)
            for one, texts in groups.items():
                s, _, _ = symbols(texts, letters)
                if len(s) > 1:
                    found[one].append(np.unique(grams(s, ORDER), return_counts=True))
        for one, parts in found.items():
            if parts:
                keys = np.concatenate([k for k, _ in parts])
                distinct, inverse = np.unique(keys, return_inverse=True)
                n = np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(distinct), one, np.int32)), pa.array(distinct.view(np.int64)), pa.array(n)], names=["one", "gram", "n"])

    arrow_rows(rows.sparkSession)
    counted = sample.mapInArrow(count, "one int, gram long, n long").groupBy("one", "gram").agg(F.sum("n").alias("n")).toArrow()
    one, keys, n = (counted.column(c).to_numpy() for c in ("one", "gram", "n"))
    counts = {}
    for k in range(len(languages)):
        mine = one == k
        by = keys[mine].view(np.uint64)
        order = np.argsort(by)
        counts[k] = (by[order], n[mine][order]) if len(by) else (np.array([_BLANK], np.uint64), np.ones(1, np.int64))
    model = kneser_ney(counts, languages)
    return _calibrated(model, sample.where("part = 0"), index)


def _calibrated(model: Model, held: DataFrame, index: dict[str, int]) -> Model:
    """model with each language's mean cross-entropy and the limits by length, from documents that weren't counted."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, m = letter_table(), shared.value
        for batch in slices(batches):
            s, bounds, letters_in = symbols(batch.column("text").to_pylist(), letters)
            own = np.array([index[x] for x in batch.column("l").to_pylist()])
            sizes = np.diff(bounds)
            parts = [(own, np.full(len(own), -1), m.entropies(s, bounds)[1], sizes)]
            for level in range(LEVELS):
                wide = SHORTEST << level
                for k in range(PIECES):
                    some = np.flatnonzero((sizes >= (k + 1) * wide) & (letters_in > 0))
                    if len(some):
                        at = np.repeat(bounds[some] + k * wide, wide) + np.tile(np.arange(wide), len(some))
                        edges = np.arange(len(some) + 1) * wide
                        parts.append((own[some], np.full(len(some), level), m.entropies(np.append(s[at], _BLANK), edges)[1], np.full(len(some), wide)))
            one, level, w, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
            yield pa.record_batch([pa.array(one), pa.array(level.astype(np.int64)), pa.array(w), pa.array(n.astype(np.float64))], names=["one", "level", "w", "n"])

    got = held.mapInArrow(measure, "one long, level long, w double, n double").toPandas()
    whole = got[(got.level < 0) & (got.n >= SHORTEST)]
    if not len(whole):
        return model
    weights = np.minimum(whole.n, 500)
    model.mean = np.full(len(model.languages), np.average(whole.w, weights=weights))
    for k, mine in whole.groupby("one"):
        model.mean[k] = np.average(mine.w, weights=weights[mine.index])
    above = got.w - model.mean[got.one]
    limit = np.inf
    for level in range(LEVELS):
        here = above[got.level == level]
        if len(here) >= 20:
            limit = min(limit, float(np.quantile(here, 1 - FALSE_RATE)) + MARGIN * (1 + 10 / np.sqrt(len(here))))
        model.limits[level] = max(limit, MARGIN)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, deviation, rejected of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, m = letter_table(), shared.value
        for batch in slices(batches):
            ids, rows = batch.column("doc_id"), batch.num_rows
            if m is None:
                yield pa.record_batch([ids, pa.array(["und"] * rows), pa.array([0.0] * rows), pa.array([None] * rows, pa.float64()), pa.array([True] * rows)], schema=_RESULT)
                continue
            s, bounds, letters_in = symbols(batch.column("text").to_pylist(), letters)
            h, n, best, off = m.deviations(s, bounds)
            odds = np.exp(-(h - h.min(axis=1)[:, None]) * np.minimum(n, CERTAIN)[:, None])
            fit = 1 / (1 + np.exp(np.clip(8 * (off - 1), -50, 50)))
            none = letters_in == 0
            yield pa.record_batch(
                [
                    ids,
                    pa.array(["und" if x else m.languages[k] for x, k in zip(none, best, strict=True)]),
                    pa.array(np.where(none, 0.0, fit / odds.sum(axis=1))),
                    pa.array(np.where(none, 0.0, off)),
                    pa.array(none | (off > 1)),
                ],
                schema=_RESULT,
            )

    arrow_rows(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, deviation double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, whose text the model doesn't reject; without a model, all that have letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, m = letter_table(), shared.value
        for batch in slices(batches):
            s, bounds, letters_in = symbols(batch.column("text").to_pylist(), letters)
            keep = letters_in > 0
            if m is not None:
                keep &= m.deviations(s, bounds)[3] <= 1
            yield batch.filter(pa.array(keep))

    arrow_rows(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
