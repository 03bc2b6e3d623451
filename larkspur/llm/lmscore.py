"""Language-model scores by subword lattices.

The model is a unigram model over pieces: those of a public vocabulary, of which a word's first one carries the mark of a
word's begin, and beside them every whole word of the training documents and an end. A text's probability is the sum over
all its segmentations, which the forward recursion computes in log space; since no piece crosses a word's begin, the sum
factors by words.

The vocabulary is one of byte-pair merges and has no unigram scores: the ranks of its merges, taken as those of a Zipf
law, start the model in their place. ROUNDS of expectation over all distinct training words give the pieces'
expected counts, which the scores are set from: each word counts once, since the pieces have to spell the words that
are rare or unseen. A whole word's weight is its count less DISCOUNT, and what is left goes to the spellings.

Words are counted over all training documents in a table that stays distributed; the most frequent BROADCAST_WORDS of it are
sent to the tasks, and the rest of the documents' words are joined with the table. The frequent ones are those above a count
that a histogram gives, so that nothing is sorted.

Defined cases: a null or empty text has the end token alone; repeated rows are scored each for itself; without training
documents all counts are zero and the vocabulary's own scores stay; very long texts and words are scored whole; words of equal
counts are all frequent or none; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import arrow_rows, cut
from larkspur.llm.text import column_bytes, directory, slices, span_hashes, splitmix, tables, word_spans

BROADCAST_WORDS = 1 << 17
#: Bytes of the default vocabulary's longest piece, with the mark as one; a lattice has its own from its vocabulary.
LONGEST = 25
#: Words up to so many bytes are summed together.
TOGETHER = 40
#: Ends of pieces in one long word that are looked up at once.
BAND = 1 << 14
#: Words that a task remembers at most, about.
REMEMBERED = 2_000_000
#: Bytes of distinct words that are summed at once.
CHUNK = 1 << 17
#: Words whose expected counts are taken together.
WORDS_AT_ONCE = 100_000
#: The mark of a word's begin as a byte that no UTF-8 text holds.
MARK = 0xFF
#: Rounds of expectation; what is taken from each word's count.
ROUNDS, DISCOUNT = 3, 0.5
#: What a piece keeps of the vocabulary's own score, as a number of tokens.
PRIOR = 1000.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Lattice:
    """Sorted hashes of the pieces with their natural log-probabilities."""

    hashes: np.ndarray
    logs: np.ndarray
    #: The lengths in bytes that pieces have: of those led by the mark, and of the others.
    marked: tuple[int, ...]
    inner: tuple[int, ...]

    def __post_init__(self) -> None:
        self.longest = max(*self.marked, *self.inner)
        self.bits = 17
        self.directory = directory(self.hashes, self.bits)
        self.steps = int(np.diff(self.directory).max(initial=1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index of each hash, -1 where it is no piece."""
        last = len(self.hashes) - 1
        at = np.minimum(self.directory[(h >> np.uint64(64 - self.bits)).astype(np.int64)], last)
        there = self.hashes[at]
        out = np.where(there == h, at, -1)
        todo = np.flatnonzero(there < h)
        at = at[todo]
        for _ in range(self.steps):
            at = np.minimum(at + 1, last)
            there = self.hashes[at]
            hit = there == h[todo]
            out[todo[hit]] = at[hit]
            more = (there < h[todo]) & (at < last)
            todo, at = todo[more], at[more]
            if not len(todo):
                break
        return out

    def _edges(self, words: np.ndarray) -> dict[int, list[tuple[int, np.ndarray, np.ndarray]]]:
        """By each end: the begins of what stands before it, with the pieces' indexes and their log-probabilities."""
        n = words.shape[1]
        powers = _powers(self.longest)
        columns = np.ascontiguousarray(tables()[0][words].T)
        edges: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {j: [] for j in range(1, n + 1)}
        padded = np.append(self.logs, -np.inf)
        for i in range(n):
            sizes = np.array([size for size in (self.inner if i else self.marked) if i + size <= n], dtype=np.uint64)
            longest = int(sizes[-1])
            running = np.cumsum(columns[i : i + longest] * powers[:longest, None], axis=0, dtype=np.uint64)
            h = splitmix(running[sizes.astype(np.int64) - 1] ^ sizes[:, None])
            for size, e in zip(sizes.tolist(), self.find(h.ravel()).reshape(h.shape), strict=True):
                if (e >= 0).any():
                    edges[i + size].append((i, e, padded[e]))
        return edges

    def forward(self, words: np.ndarray, edges: dict | None = None) -> np.ndarray:
        """The log-probability of each prefix, over all its segmentations: a row for each length, a column for each word."""
        edges = edges or self._edges(words)
        n = words.shape[1]
        alpha = np.full((n + 1, len(words)), -np.inf)
        alpha[0] = 0
        for j in range(1, n + 1):
            alpha[j] = _log_sum([alpha[i] + log for i, _, log in edges[j]], len(words))
        return alpha

    def expect(self, words: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> None:
        """Add to counts the expected number of each piece in the words, as often as weights says."""
        edges = self._edges(words)
        alpha = self.forward(words, edges)
        n = words.shape[1]
        beta = np.full((n + 1, len(words)), -np.inf)
        beta[n] = 0
        after: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {i: [] for i in range(n)}
        for j, found in edges.items():
            for i, e, log in found:
                after[i].append((j, e, log))
        for i in range(n - 1, -1, -1):
            beta[i] = _log_sum([beta[j] + log for j, _, log in after[i]], len(words))
        for j, found in edges.items():
            for i, e, log in found:
                there = np.flatnonzero(e >= 0)
                part = np.exp(alpha[i][there] + log[there] + beta[j][there] - alpha[n][there])
                counts += np.bincount(e[there], part * weights[there], len(counts))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log-probability of each word of data (lower-cased bytes)."""
        out = np.empty(len(starts))
        for index, matrix in by_length(data, starts, ends):
            out[index] = self.long(matrix[0]) if matrix.shape[1] > TOGETHER else self.forward(matrix)[-1]
        return out

    def _ending(self, word: np.ndarray, low: int) -> np.ndarray:
        """For each of the next BAND ends after low, a row of the pieces' indexes by their bytes, -1 where there is none."""
        high = min(len(word), low + BAND)
        first = max(low + 1 - self.longest, 0)
        values, powers = tables()[0][word[first:high]], _powers(self.longest)
        found = np.full((high - low, self.longest), -1, dtype=np.int64)
        for size in range(1, min(high, self.longest) + 1):
            a = max(low + 1 - size, 0)
            h = np.zeros(high - size + 1 - a, dtype=np.uint64)
            for k in range(size):
                h += values[a - first + k : a - first + k + len(h)] * powers[k]
            found[len(found) - len(h) :, size - 1] = self.find(splitmix(h ^ np.uint64(size)))
        return found

    def _prefixes(self, word: np.ndarray) -> np.ndarray:
        """The log-probability of each prefix of one long word, led by as many impossible ones as a piece is long."""
        padded = np.append(self.logs, -np.inf)
        alpha = np.full(len(word) + 1 + self.longest, -np.inf)
        alpha[self.longest] = 0
        for low in range(0, len(word), BAND):
            for j, logs in enumerate(padded[self._ending(word, low)], low + 1):
                terms = alpha[j : j + self.longest][::-1] + logs
                top = terms.max()
                alpha[j + self.longest] = top + np.log(np.exp(terms - top).sum())
        return alpha

    def long(self, word: np.ndarray) -> float:
        """The log-probability of one long word, in memory that does not grow with a piece's length."""
        return float(self._prefixes(word)[-1])

    def expect_long(self, word: np.ndarray, counts: np.ndarray) -> None:
        """Add to counts the expected number of each piece in one long word."""
        padded = np.append(self.logs, -np.inf)
        alpha = self._prefixes(word)
        beta = np.full(len(alpha), -np.inf)
        beta[-1] = 0
        back = np.arange(self.longest)
        for low in reversed(range(0, len(word), BAND)):
            found = self._ending(word, low)
            logs = padded[found]
            for j in range(low + len(found), low, -1):
                before = beta[j : j + self.longest]
                np.logaddexp(before, (beta[j + self.longest] + logs[j - low - 1])[::-1], out=before)
            ends = np.arange(low + 1, low + len(found) + 1)[:, None]
            part = np.exp(alpha[ends + self.longest - 1 - back] + logs + beta[ends + self.longest] - alpha[-1])
            there = found >= 0
            counts += np.bincount(found[there], part[there], len(counts))


def _log_sum(terms: list[np.ndarray], n: int) -> np.ndarray:
    """The logarithm of the sum of exponentials, place by place."""
    if not terms:
        return np.full(n, -np.inf)
    stacked = np.stack(terms)
    top = stacked.max(axis=0)
    top[np.isneginf(top)] = 0.0
    stacked -= top
    np.exp(stacked, out=stacked)
    with np.errstate(divide="ignore"):
        return np.log(stacked.sum(axis=0)) + top


class Remembered:
    """Log-probabilities of the words that a task has met, by their hashes."""

    def __init__(self, lattice: Lattice, hashes: np.ndarray, logs: np.ndarray) -> None:
        self.lattice, self.hashes, self.logs = lattice, hashes, logs

    def words(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log-probabilities of distinct words with sorted hashes h."""
        place = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        known = self.hashes[place] == h if len(self.hashes) else np.zeros(len(h), bool)
        out = np.where(known, self.logs[place], 0.0) if len(self.hashes) else np.zeros(len(h))
        new = np.flatnonzero(~known)
        out[new] = self.lattice.words(data, starts[new], ends[new])
        if len(self.hashes) > REMEMBERED:
            self.hashes, self.logs = h, out.copy()
        else:
            at = np.searchsorted(self.hashes, h[new])
            self.hashes, self.logs = np.insert(self.hashes, at, h[new]), np.insert(self.logs, at, out[new])
        return out


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, tables()[2], dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of equal length as rows of bytes, led by the mark; long ones each for itself."""
    lowered = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    sizes = ends - starts
    if not len(sizes):
        return
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for length, a, b in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        step = max(1, CHUNK // (length + 1)) if length + 1 <= TOGETHER else 1
        for low in range(a, b, step):
            index = order[low : min(b, low + step)]
            rows = np.empty((len(index), length + 1), dtype=np.uint8)
            rows[:, 0] = MARK
            rows[:, 1:] = lowered[starts[index][:, None] + np.arange(length)]
            yield index, rows


def vocabulary(path: str) -> Lattice:
    """The pieces of a vocabulary file with its own scores: a merge's rank is taken as the rank of a Zipf law.

    Pieces are byte strings; those of the vocabulary that its lower-casing maps together are one. All single bytes are pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else bytes([MARK]) * piece.startswith("▁") + piece.removeprefix("▁").encode()
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
        if raw and b"\xe2\x96\x81" not in raw:
            weight = 1e-9 if model.is_byte(i) else 1.0 / (10.0 - min(0.0, model.get_score(i)))
            scores[raw] = scores.get(raw, 0.0) + weight
    for b in (*range(65), *range(91, 256)):
        scores.setdefault(bytes([b]), 1e-9)
    pieces = list(scores)
    flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    stops = np.cumsum([len(x) for x in pieces])
    powers = _powers(max(map(len, pieces)))
    hashes = np.array([np.sum(tables()[0][flat[b - len(x) : b]] * powers[: len(x)], dtype=np.uint64) for x, b in zip(pieces, stops, strict=True)], dtype=np.uint64)
    hashes = splitmix(hashes ^ np.array([len(x) for x in pieces], dtype=np.uint64))
    weights = np.array(list(scores.values()))
    order = np.argsort(hashes)
    share = weights[order] / weights.sum()
    marked, inner = (tuple(sorted({len(x) for x in pieces if (x[0] == MARK) == led})) for led in (True, False))
    return Lattice(hashes[order], np.log(share), marked, inner)


def count_words(texts: DataFrame) -> DataFrame:
    """hash, word, n: every distinct word of texts (text) and how often it occurs, the word as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            hashes = np.concatenate([p[0] for p in pending])
            distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            n = np.bincount(inverse, np.concatenate([p[1] for p in pending])).astype(np.int64)
            words = pa.concat_arrays([p[2] for p in pending]).take(pa.array(first))
            return pa.record_batch([pa.array(distinct.view(np.int64)), words, pa.array(n)], names=["hash", "word", "n"])

        for batch in slices(batches):
            data, bounds = column_bytes(batch.column("text"))
            starts, ends, _ = word_spans(data, bounds)
            if not len(starts):
                continue
            h, first, n = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
            lowered = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
            s, sizes = starts[first], (ends - starts)[first]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            flat = lowered[np.repeat(s - offsets[:-1], sizes) + np.arange(offsets[-1])]
            words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            pending.append((h, n, words))
            size += len(h)
            if size > 1_500_000:
                whole = merged()
                if whole.num_rows > 1_000_000:
                    yield whole
                    pending, size = [], 0
                else:
                    pending = [(whole.column(0).to_numpy().view(np.uint64), whole.column(2).to_numpy(), whole.column(1))]
                    size = whole.num_rows
        if pending:
            yield merged()

    arrow_rows(texts.sparkSession)
    parts = texts.select("text").mapInArrow(run, "hash long, word binary, n long")
    return parts.groupBy("hash").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def learn(words: DataFrame, path: str) -> Lattice:
    """The vocabulary's lattice with its scores set from expected counts over words (word), each counted once."""
    lattice = first = vocabulary(path)
    for _ in range(ROUNDS):
        shared = words.sparkSession.sparkContext.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            counts = np.zeros(len(now.logs))

            def add(parts: list[pa.Array]) -> None:
                column = pa.concat_arrays(parts).cast(pa.large_binary())
                offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
                for index, matrix in by_length(data, offsets[:-1], offsets[1:]):
                    if matrix.shape[1] > TOGETHER:
                        now.expect_long(matrix[0], counts)
                    else:
                        now.expect(matrix, np.ones(len(index)), counts)

            held: list[pa.Array] = []
            for batch in batches:
                held.append(batch.column("word"))
                if sum(map(len, held)) >= WORDS_AT_ONCE:
                    add(held)
                    held = []
            if held:
                add(held)
            some = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["piece", "n"])

        expected = np.zeros(len(first.logs))
        for row in words.select("word").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toLocalIterator():
            expected[row["piece"]] = row["n"]
        counts = expected + PRIOR * np.exp(first.logs)
        lattice = replace(first, logs=np.log(counts / counts.sum()))
    return lattice


def frequent_from(words: DataFrame, most: int | None = None) -> int:
    """The least count such that at most so many words occur as often; counts are compared by eighths of a doubling."""
    eighth = F.floor(F.log2("n") * 8).cast("int")
    left = BROADCAST_WORDS if most is None else most
    least = None
    # at most 8 * 63 rows
    for row in words.where("n > 1").groupBy(eighth.alias("eighth")).agg(F.count("*").alias("c"), F.min("n").alias("least")).orderBy(F.desc("eighth")).collect():
        left -= row["c"]
        if left < 0:
            break
        least = row["least"]
    return (1 << 62) if least is None else least


def lattice_scores(docs: DataFrame, training: Column, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    training says which rows are learned from. base_score is the log10 probability under add-half smoothed word
    counts, score under the lattice.
    """
    spark = docs.sparkSession
    learned = docs.where(training)
    words = cut(count_words(learned))
    documents = learned.count()
    totals = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n, v = totals["n"] + documents, totals["v"] + (documents > 0)
    lattice = learn(words, path or default_vocabulary())
    left = DISCOUNT * v / n if n else 1.0
    stop = float(np.log10((documents - DISCOUNT) / n)) if n else -3.0
    frequent = words.where(F.col("n") >= frequent_from(words)).select("hash", "n").toArrow()
    order = np.argsort(frequent.column("hash").to_numpy())
    top_hashes, top_counts = frequent.column("hash").to_numpy()[order], frequent.column("n").to_numpy()[order]
    shared = spark.sparkContext.broadcast((lattice, top_hashes, top_counts))
    scale = np.log10(n + 0.5 * (v + 1))
    end = float(np.log10(documents + 0.5) - scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, top_hashes, top_counts = shared.value
        met = Remembered(lattice, np.zeros(0, np.uint64), np.zeros(0))
        for batch in slices(batches):
            data, bounds = column_bytes(batch.column("text"))
            starts, ends, first = word_spans(data, bounds)
            rows = batch.num_rows
            owner = np.repeat(np.arange(rows), np.diff(first))
            h, at, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            logs = met.words(h, data, starts[at], ends[at])
            signed = h.view(np.int64)
            place = np.minimum(np.searchsorted(top_hashes, signed), max(len(top_hashes) - 1, 0))
            hit = top_hashes[place] == signed if len(top_hashes) else np.zeros(len(h), bool)
            base = np.where(hit, np.log10(top_counts[place] + 0.5) - scale, 0.0) if len(top_hashes) else np.zeros(len(h))
            whole = np.where(hit, np.log(np.maximum(top_counts[place] - DISCOUNT, 1e-300) / n), -np.inf) if len(top_hashes) else np.full(len(h), -np.inf)
            spelt = logs + np.log(left)
            score = np.bincount(owner, np.where(hit, np.logaddexp(whole, spelt), 0.0)[inverse], rows).astype(float) / np.log(10)
            known = np.bincount(owner, hit[inverse], rows).astype(np.int64)
            sums = np.bincount(owner, base[inverse], rows).astype(float)
            rare = np.flatnonzero(~hit[inverse])
            rare_first = np.searchsorted(owner[rare], np.arange(rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(rare_first), pa.StructArray.from_arrays([pa.array(signed[inverse[rare]]), pa.array(spelt[inverse[rare]])], names=["hash", "spelt"]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(first) + 1), pa.array(known), pa.array(sums), pa.array(score), lists], names=["doc_id", "n_tokens", "known", "sums", "score", "rare"])

    schema = "doc_id long, n_tokens long, known long, sums double, score double, rare array<struct<hash: long, spelt: double>>"
    arrow_rows(spark)
    rows = docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id())
    rows = cut(rows)
    asked = rows.select("uid", F.explode("rare").alias("r")).groupBy("uid", "r.hash", "r.spelt").agg(F.count("*").alias("times"))
    log = F.log10(F.coalesce("n", F.lit(0)) + 0.5) - F.lit(float(scale))
    both = F.when(F.col("n") > 0, F.log10((F.col("n") - DISCOUNT) / F.lit(float(max(n, 1))) + F.exp("spelt"))).otherwise(F.col("spelt") / float(np.log(10)))
    joined = (
        asked.join(words.select("hash", "n"), "hash", "left")
        .groupBy("uid")
        .agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.col("times") * both).alias("better"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
    )
    return rows.drop("rare").join(joined, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0)) + F.lit(int(documents > 0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("more", F.lit(0.0)) + F.lit(end)).alias("base_score"),
        (F.col("score") + F.coalesce("better", F.lit(0.0)) + F.lit(stop)).alias("score"),
    )
