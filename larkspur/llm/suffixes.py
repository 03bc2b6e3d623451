"""Suffix-array deduplication: remove every byte that a repeated string of LENGTH bytes covers.

Candidates. Every string of LENGTH bytes picks an anchor, the first of its GRAM-byte substrings of least hash, so that equal
strings pick equal anchors at equal places. A text falls into segments, one for each anchor: the strings that
picked it, in a row. Segments meet by their anchor's hash; what meets nothing can't repeat. Equal segments are one, and a
segment that occurs twice repeats as a whole.

Suffix arrays. The distinct segments that meet others are put together, in tasks by their anchors' hashes, and sorted in two
stages: only suffixes smaller than their successors are sorted directly, by comparing words of packed symbols; the others
follow in one scan over the buckets of first bytes, from each sorted suffix to the one before it. The common prefixes of
neighbours in the array tell which strings repeat.

What is frequent. Anchors that a sample shows to be very frequent are counted by segment before they are brought together, and
an anchor of more than PART distinct segments isn't sorted in one task: its strings are counted by two 64-bit hashes, dealt over all tasks.

Equal segments are told by two 64-bit hashes, of the anchor and of the segment, equal texts by one and their size.

Defined cases: a null text is empty; texts shorter than LENGTH bytes keep all bytes; very long texts are one text like others, and
strings that repeat within one text count; of equal segments any may stand for the others, since all are removed; repeated
rows cover each other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import HOT_SHARE, arrow_rows, cut, hot_keys, stash
from larkspur.llm.text import byte_hashes, column_bytes, slices, splitmix

LENGTH, GRAM = 200, 50
#: Distinct segments of an anchor up to which they are sorted in one task; bytes sorted together, about.
PART, SORTED_BYTES = 1500, 1 << 18


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of so many consecutive values the place of its least one.

    Values are compared by their high bits, and equal ones by place, the first counting as less: the low bits hold the place.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    blocks = -(-len(h) // width)
    bits = np.uint64(max(1, int(blocks * width).bit_length()))
    keys = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    keys[: len(h)] = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    grid = keys.reshape(blocks, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[:n], head[width - 1 : width - 1 + n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts one after another: each segment's text, first string there and number of strings, its anchor's hash and its own."""
    sizes = np.diff(bounds)
    strings = np.maximum(sizes - LENGTH + 1, 0)
    if not strings.any():
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    starts = np.arange(len(data) - GRAM + 1)
    grams = byte_hashes(data, starts, np.full(len(starts), GRAM))
    places = least_places(grams, LENGTH - GRAM + 1)
    offsets = np.concatenate([[0], np.cumsum(strings)])
    owner = np.repeat(np.arange(len(sizes)), strings)
    begin = np.repeat(bounds[:-1] - offsets[:-1], strings) + np.arange(offsets[-1])
    anchor = places[begin]
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(anchor)))
    at, begin, owner = anchor[first], begin[first], owner[first]
    own = byte_hashes(data, begin, count + LENGTH - 1)
    return owner, begin - bounds[owner], count, grams[at], splitmix(own ^ ((at - begin).astype(np.uint64) << np.uint64(32)))


def two_stage_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of text (small non-negative integers), exact up to depth; its last value must be a least one.

    Stage one sorts the suffixes that are smaller than their successors, by words of as many symbols as fit in 63 bits. Stage two goes through
    the buckets of first symbols in order: whatever suffix is met puts the one before it, if that is larger than its
    successor, at the next free place of its bucket's front.
    """
    n = len(text)
    rises = np.empty(n, dtype=bool)
    rises[-1] = True
    later = text[1:] != text[:-1]
    less = text[:-1] < text[1:]
    # a run of equal symbols rises if what follows it is larger
    change = np.append(np.flatnonzero(later), n - 1)
    ends = change[np.searchsorted(change, np.arange(n - 1))] if n > 1 else change[:0]
    rises[:-1] = np.where(ends < n - 1, less[np.minimum(ends, n - 2)] if n > 1 else True, False)
    used, small = np.unique(text, return_inverse=True)
    width = max(1, int(len(used) - 1).bit_length())
    step_size = 63 // width
    padded = np.concatenate([small.astype(np.uint64), np.zeros(depth + 2 * step_size, dtype=np.uint64)])
    word = np.zeros(n + depth + step_size, dtype=np.uint64)
    for k in range(step_size):
        word = (word << np.uint64(width)) | padded[k : k + len(word)]
    order = np.flatnonzero(rises)
    order = order[np.argsort(word[order], kind="stable")]
    group = np.concatenate([[0], np.cumsum(word[order][1:] != word[order][:-1])]) if len(order) else order
    for at in range(step_size, depth + 1, step_size):
        sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        tied = sizes[group] > 1 if len(group) else np.zeros(0, bool)
        if not tied.any():
            break
        index = np.flatnonzero(tied)
        part = order[index]
        deeper = word[part + at]
        inner = np.lexsort((deeper, group[index]))
        order[index] = part[inner]
        deeper, g = deeper[inner], group[index]
        new = np.zeros(len(group), dtype=bool)
        new[0] = False
        fresh = np.zeros(len(index), dtype=bool)
        fresh[1:] = (g[1:] == g[:-1]) & (deeper[1:] != deeper[:-1])
        step = np.zeros(len(group), dtype=np.int64)
        step[index[fresh]] = 1
        boundary = np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)])
        group = np.cumsum(boundary + step)
    symbols = int(text.max()) + 1 if n else 0
    sorted_small: list[np.ndarray] = np.split(order, np.searchsorted(text[order], np.arange(1, symbols)))
    waiting: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    out = []

    def induce(found: np.ndarray, symbol: int) -> np.ndarray:
        """Hand what stands before the found suffixes to their buckets; what belongs to this one is returned."""
        before = found[found > 0] - 1
        before = before[~rises[before]]
        if not len(before):
            return before
        values = text[before]
        by = np.argsort(values, kind="stable")
        before, values = before[by], values[by]
        keys, first = np.unique(values, return_index=True)
        same = before[:0]
        for key, part in zip(keys.tolist(), np.split(before, first[1:]), strict=True):
            if key == symbol:
                same = part
            else:
                waiting[key].append(part)
        return same

    for symbol in range(symbols):
        front = np.concatenate(waiting[symbol]) if waiting[symbol] else np.zeros(0, dtype=np.int64)
        while len(front):
            out.append(front)
            front = induce(front, symbol)
        if len(sorted_small[symbol]):
            out.append(sorted_small[symbol])
            induce(sorted_small[symbol], symbol)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def repeated_starts(parts: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Whether each part's strings, counts of them in a row, repeat anywhere: one boolean for each, part after part."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(begin[-1], dtype=np.uint16)
    flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
    inside = np.ones(begin[-1], dtype=bool)
    inside[begin[1:] - 1] = False
    text[inside] = flat.astype(np.uint16) + 1
    order = two_stage_order(text, LENGTH)
    wanted = np.zeros(len(text), dtype=bool)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    places = np.repeat(begin[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    wanted[places] = True
    order = order[wanted[order]]
    same = common_prefixes(text, order)
    hit = np.zeros(len(text), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit[places]


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each two neighbours of order have a common prefix of LENGTH symbols."""
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    padded = np.concatenate([text, np.zeros(8, dtype=text.dtype)])
    word = np.zeros(len(text), dtype=np.uint64)
    for k in range(4):
        word = (word << np.uint64(16)) | padded[k : k + len(text)].astype(np.uint64)
    for at in [*range(0, LENGTH - 3, 4)]:
        alive = alive[word[a[alive] + at] == word[b[alive] + at]]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def string_hashes(parts: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each part's strings, part after part."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(begin[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    other = splitmix(np.arange(256, dtype=np.uint64)).argsort().astype(np.uint8)[data]
    return byte_hashes(data, at, np.full(len(at), LENGTH)), byte_hashes(other, at, np.full(len(at), LENGTH))


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """The begin and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_COVERED = "key long, size int, a int, b int"


def _segments_of(docs: DataFrame) -> DataFrame:
    """key, size, anchor, own, first, n, again of all segments of docs (key, text); equal ones in a row, as periodic texts have, are one with again > 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, bounds = column_bytes(batch.column("text"))
            owner, first, n, anchor, own = segments(data, bounds)
            new = np.ones(len(first), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
            at = np.flatnonzero(new)
            again = np.diff(np.append(at, len(first))).astype(np.int32)
            owner, first, n, anchor, own = owner[at], first[at], n[at], anchor[at], own[at]
            keys, sizes = batch.column("key").to_numpy()[owner], np.diff(bounds)[owner].astype(np.int32)
            names = ["key", "size", "anchor", "own", "first", "n", "again"]
            yield pa.record_batch([pa.array(x) for x in (keys, sizes, anchor.view(np.int64), own.view(np.int64), first.astype(np.int32), n.astype(np.int32), again)], names=names)

    return docs.select("key", "text").mapInArrow(run, "key long, size int, anchor long, own long, first int, n int, again int")


_PART = [("key", pa.int64()), ("size", pa.int32()), ("anchor", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("single", pa.bool_()), ("part", pa.binary())]


def _cut_out(docs: DataFrame, many: bool) -> DataFrame:
    """key, size, anchor, first, n, single, part: the segments of docs (key, text, wanted) with their bytes, of anchors with many segments or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "wanted")), strict=True):
                raw = text.encode()
                rows += [(key, len(raw), w["anchor"], w["first"], w["n"], w["single"], raw[w["first"] : w["first"] + w["n"] + LENGTH - 1]) for w in wanted if w["many"] == many]
            columns = zip(*rows, strict=True) if rows else [()] * len(_PART)
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, _PART, strict=True)], names=[name for name, _ in _PART])

    return docs.mapInArrow(run, "key long, size int, anchor long, first int, n int, single boolean, part binary")


def _sorted_out(parts: DataFrame) -> DataFrame:
    """key, size, a, b: what the single segments' repeated strings cover, by suffix arrays over the anchors' segments."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        counts = np.array([r[4] for r in rows], dtype=np.int64)
        hit = repeated_starts([r[6] for r in rows], counts)
        ends = np.cumsum(counts)
        out = []
        for (key, size, _, first, n, single, _), end in zip(rows, ends.tolist(), strict=True):
            if single:
                out += [(key, size, first + a, first + b - 1 + LENGTH) for a, b in runs(hit[end - n : end])]
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["key", "size", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name, _ in _PART), strict=True):
                if rows and row[2] != last and size >= SORTED_BYTES:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[6]), row[2]
        if rows:
            yield flush(rows)

    return parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _COVERED)


def _counted_out(parts: DataFrame) -> DataFrame:
    """key, size, a, b: what the single segments' repeated strings cover, by counts of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                n = some.column("n").to_numpy().astype(np.int64)
                h, g = string_hashes(some.column("part").to_pylist(), n)
                owner = np.repeat(np.arange(some.num_rows), n)
                at = some.column("first").to_numpy()[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                columns = [pa.array(x) for x in (h.view(np.int64), g.view(np.int64), some.column("key").to_numpy()[owner], some.column("size").to_numpy()[owner], at.astype(np.int32))]
                yield pa.record_batch([*columns, some.column("single").take(pa.array(owner))], names=["h", "g", "key", "size", "at", "single"])

    strings = stash(parts.mapInArrow(run, "h long, g long, key long, size int, at int, single boolean"))
    twice = strings.groupBy("h", "g").count().where("count > 1").select("h", "g")
    return strings.where("single").join(twice, ["h", "g"], "left_semi").select("key", "size", F.col("at").alias("a"), (F.col("at") + LENGTH).alias("b"))


def _met(found: DataFrame) -> DataFrame:
    """The segments of found whose anchors others have too, with single: it has no equal, asked: its strings are to be looked at, many: with those of many others."""
    anchor, same = Window.partitionBy("anchor"), Window.partitionBy("anchor", "own")
    counted = found.withColumn("times", F.sum("again").over(same)).withColumn("turn", F.row_number().over(same.orderBy("key", "first")))
    met = counted.withColumn("all", F.sum("again").over(anchor)).withColumn("fewest", F.min("times").over(anchor)).withColumn("kinds", F.sum(F.when(F.col("turn") == 1, 1)).over(anchor))
    asked = (F.col("fewest") == 1) & (F.col("turn") == 1)
    return met.where("all > 1").select("key", "size", "anchor", "first", "n", "again", (F.col("times") == 1).alias("single"), asked.alias("asked"), (F.col("kinds") > PART).alias("many"))


def _met_often(found: DataFrame) -> DataFrame:
    """_met() for anchors that are very frequent: equal segments are counted where they are read, and no task gets an anchor's rows whole."""
    kinds = cut(found.groupBy("anchor", "own").agg(F.sum("again").alias("times"), F.min(F.struct("key", "first", "size")).alias("chosen")))
    named = found.join(kinds, ["anchor", "own"])
    chosen = (F.col("chosen.key") == F.col("key")) & (F.col("chosen.first") == F.col("first")) & (F.col("chosen.size") == F.col("size"))
    return named.select("key", "size", "anchor", "first", "n", "again", (F.col("times") == 1).alias("single"), chosen.alias("asked"), F.lit(True).alias("many"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """key, size, spans: for each text of docs (key, text) with repeats the spans of bytes that repeated strings cover.

    key is a hash of the text, size its bytes; a span's end is exclusive, and spans may overlap.
    """
    found = _segments_of(docs)
    hot = hot_keys(_segments_of(docs.sample(HOT_SHARE, seed=7)).select("anchor"), "anchor")
    if hot is None:
        met = stash(_met(found))
    else:
        found = stash(found)
        met = stash(_met(found.join(hot, "anchor", "left_anti")).unionByName(_met_often(found.join(hot.select("anchor"), "anchor", "left_semi"))))
    whole = met.where("NOT single").select("key", "size", F.col("first").alias("a"), (F.col("first") + F.col("n") * F.col("again") - 1 + LENGTH).alias("b"))
    # a frequent anchor's chosen segment stands once for each row that has its text
    listed = F.collect_list if hot is None else F.collect_set
    wanted = met.where("asked").groupBy("key", "size").agg(listed(F.struct("anchor", "first", "n", "single", "many")).alias("wanted"))
    mine = docs.withColumn("bytes", F.octet_length("text"))
    owners = mine.groupBy("key", F.col("bytes").alias("size")).agg(F.min("row").alias("row"))
    chosen = wanted.join(owners, ["key", "size"])
    texts = mine.join(chosen.withColumnRenamed("key", "k").withColumnRenamed("row", "r"), (F.col("key") == F.col("k")) & (F.col("row") == F.col("r")) & (F.col("bytes") == F.col("size")))
    texts = texts.select("key", "text", "wanted")
    covered = whole.unionByName(_sorted_out(_cut_out(texts, False)))
    if not met.where("asked AND many").isEmpty():
        covered = covered.unionByName(_counted_out(_cut_out(texts, True)))
    return covered.groupBy("key", "size").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("row"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of docs (doc_id, text)."""
    arrow_rows(docs.sparkSession)
    rows = _keyed(docs)
    spans = repeated_spans(rows.select("key", "text", "row")).withColumnRenamed("key", "k")
    joined = rows.join(spans, (F.col("key") == F.col("k")) & (F.octet_length("text") == F.col("size")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, bounds = column_bytes(batch.column("text"))
            spans = batch.column("spans")
            begin = np.repeat(bounds[:-1], np.asarray(pc.fill_null(pc.list_value_length(spans), 0)))
            flat = spans.flatten()
            edges = np.bincount(begin + flat.field("a").to_numpy(), minlength=len(data) + 1) - np.bincount(begin + flat.field("b").to_numpy(), minlength=len(data) + 1)
            gone = np.cumsum(edges)[:-1] > 0
            removed = np.concatenate([[0], np.cumsum(gone)])[bounds]
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            heads = bounds[:-1][bounds[:-1] < bounds[1:]]
            starts[heads] = gone[heads]
            begun = np.concatenate([[0], np.cumsum(starts)])[bounds]
            kept = data[~gone]
            offsets = (bounds - removed).astype(np.int32)
            whole = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(np.diff(removed)), pa.array(np.diff(begun)), whole], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
