"""Benchmark decontamination by spaced-seed hashing.

Words are taken apart from punctuation and case. A spaced seed is a mask over consecutive words that ignores some
positions; its hash at a place covers the words at the other positions, so that a substituted word at an ignored position
leaves the hash alone. The hashes of all benchmark items under all masks form a sorted table; the documents' hashes are
joined with it, and around every hit the two texts are compared on the hit's diagonal: the run of words that
agrees in enough places is the overlap.

The benchmark is the query set: it is read in blocks of at most BLOCK_HASHES hashes, and TOGETHER blocks are sent to the tasks for
one scan, so that no task's memory grows with the benchmark. Documents aren't shuffled, and their words are hashed once a scan.

An overlap counts from MIN_WORDS words, or the whole item if it is shorter, of which SIMILARITY agree and the first and the last do. Items
of fewer than MIN_WORDS words are also looked for by three words in a row (SHORT_MASK), which every run of 6 to 12 words
with up to a fifth of them substituted keeps somewhere; items of 3 to 5 words have to agree in every word. Items of one or two
words are no evidence, and aren't looked for.

Defined cases: null and empty texts overlap nothing; very long texts are looked at whole; of several overlaps with an item the
one with most agreeing words counts, of equal ones the first by place; repeated rows and items are reported each; an empty table on
either side gives an empty result; extra columns are not read by overlaps(), and kept as they are by decontaminate().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import arrow_rows
from larkspur.llm.text import column_bytes, slices, span_hashes, word_spans

#: The masks, 1 where a word counts.
MASKS = ("111011", "1101011", "10110111")
SHORT_MASK = "111"
#: Words of an overlap, of an item, and of an item in which words may be substituted, at least; the share of agreeing words.
MIN_WORDS, SHORTEST, SUBSTITUTED, SIMILARITY = 13, 3, 6, 0.8
BLOCK_HASHES, TOGETHER = 1 << 19, 8
_RESULT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("n_equal", pa.int32()), ("item_words", pa.int32())])
SCHEMA = "doc_id long, item_id long, first_word int, n_words int, n_equal int, item_words int"


def plain_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without ASCII punctuation at their ends; words of nothing else don't count. And each text's first."""
    letter = np.zeros(256, dtype=bool)
    letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    starts, ends, first = word_spans(data, bounds)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), first
    good = letter[data]
    counts = np.concatenate([[0], np.cumsum(good)])
    at = np.flatnonzero(good)
    real = counts[ends] > counts[starts]
    kept = np.concatenate([[0], np.cumsum(real)])
    starts, ends = starts[real], ends[real]
    return span_hashes(data, at[counts[starts]], at[counts[ends] - 1] + 1), kept[first]


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash under mask at every place where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, len(mask), dtype=np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def longest_overlap(equal: np.ndarray, similarity: float) -> tuple[int, int]:
    """Start and end of the longest run, of equal ones the first, that begins and ends with agreement and agrees in the given share of places."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0
    least = round(similarity * 1000)
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1000 - least, -least))])
    begins, ends = score[at], score[at + 1]
    # a begin counts only if it lies below all before it; its end is the last that doesn't lie below it
    lowest = np.minimum.accumulate(begins)
    some = np.flatnonzero(np.concatenate([[True], begins[1:] < lowest[:-1]]))
    highest = np.maximum.accumulate(ends[::-1])[::-1]
    last = np.searchsorted(-highest, -begins[some], side="right") - 1
    sizes = at[last] + 1 - at[some]
    best = int(np.argmax(sizes))
    return int(at[some[best]]), int(at[last[best]]) + 1


class Block:
    """Some benchmark items' words and the sorted table of their hashes under all masks."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.items = items
        self.masks = (*MASKS, SHORT_MASK) if any(len(w) < MIN_WORDS for _, w in items) else MASKS
        hashes, places = [], []
        for k, (_, words) in enumerate(items):
            for m, mask in enumerate(self.masks):
                if mask == SHORT_MASK and len(words) >= MIN_WORDS:
                    continue
                h = seeds(words, mask)
                hashes.append(h)
                places.append(np.stack([np.full(len(h), k), np.full(len(h), m), np.arange(len(h))], axis=1))
        self.hashes = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.places = np.concatenate([*places, np.zeros((0, 3), np.int64)]).astype(np.int32)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.places = self.hashes[order], self.places[order]
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, m: int) -> Iterator[tuple[int, int, int]]:
        """Item, its place and the document's place of every equal hash under mask m."""
        h = seeds(words, self.masks[m])
        maybe = np.flatnonzero(self.filter[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        low = np.searchsorted(self.hashes, h[maybe], side="left")
        high = np.searchsorted(self.hashes, h[maybe], side="right")
        for at, a, b in zip(maybe[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            for k, mask, place in self.places[a:b].tolist():
                if mask == m:
                    yield k, place, at

    def overlaps(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """item_id, first word, words, agreeing words, the item's words of the best overlap with each item."""
        diagonals = {(k, at - place) for m in range(len(self.masks)) for k, place, at in self.hits(words, m)}
        best: dict[int, tuple[int, int, int, int, int]] = {}
        for k, shift in sorted(diagonals):
            item_id, item = self.items[k]
            low, high = max(0, shift), min(len(words), shift + len(item))
            equal = words[low:high] == item[low - shift : high - shift]
            a, b = longest_overlap(equal, SIMILARITY if len(item) >= SUBSTITUTED else 1.0)
            agreeing = int(equal[a:b].sum())
            if b - a >= min(MIN_WORDS, len(item)) and (k not in best or agreeing > best[k][3]):
                best[k] = (item_id, low + a, b - a, agreeing, len(item))
        return list(best.values())


def _blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark as blocks of a bounded number of hashes, read one after another."""
    items: list[tuple[int, np.ndarray]] = []
    size = 0
    for row in benchmark.select("item_id", F.col("text").alias("t")).where("t IS NOT NULL").toLocalIterator(prefetchPartitions=False):
        words, _ = plain_hashes(*column_bytes(pa.array([row["t"]])))
        if len(words) < SHORTEST:
            continue
        items.append((row["item_id"], words))
        size += (len(MASKS) + 1) * len(words)
        if size >= BLOCK_HASHES:
            yield Block(items)
            items, size = [], 0
    if items:
        yield Block(items)


def _scans(docs: DataFrame, benchmark: DataFrame) -> Iterator[list]:
    """The benchmark's blocks as broadcasts, TOGETHER of them for each scan of the documents."""
    some: list = []
    for block in _blocks(benchmark):
        some.append(docs.sparkSession.sparkContext.broadcast(block))
        if len(some) == TOGETHER:
            yield some
            some = []
    if some:
        yield some


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_equal, item_words: the best overlap of each document (doc_id, text) with each item (item_id, text)."""
    arrow_rows(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    found = None
    for blocks in _scans(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                words, first = plain_hashes(*column_bytes(batch.column("text")))
                rows = []
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), first[:-1], first[1:], strict=True):
                    rows += [(doc, *x) for block in blocks for x in block.value.overlaps(words[a:b])]
                if rows:
                    yield pa.record_batch([pa.array(x, type=t.type) for x, t in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)

        part = texts.mapInArrow(run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text overlaps no benchmark item."""
    arrow_rows(docs.sparkSession)
    for blocks in _scans(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                words, first = plain_hashes(*column_bytes(batch.column("text")))
                clean = [not any(block.value.overlaps(words[a:b]) for block in blocks) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
