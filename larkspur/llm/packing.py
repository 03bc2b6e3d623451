"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become byte-level BPE ids and an end id, and are cut into pieces only when they are longer than a
sequence. Full pieces are sequences of their own. All other pieces are dealt at random into buckets of bounded size.
Each bucket is solved by several islands, small populations of packings that begin differently. Crossover injects whole
well-filled bins of one parent into the other, removes bins that hold duplicates, and places the displaced pieces: in
place of one or two smaller ones where that fills a bin better, and else by best fit. After a first epoch the islands' elites migrate
to a common second epoch, whose best packing counts. A bucket stops as soon as it needs no more bins than its total length does.
Then the emptiest bins of many buckets are packed anew together, so that the buckets' own bounds aren't the last word.

Defined cases: a null or empty text is the end id alone (one piece of length 1). A very long text becomes pieces, of which only the
first may be short. Strings of added tokens in a text are those tokens, as the tokenizer has it. Pieces of equal length are
told apart by their place alone, and of equally good packings the first found counts. Repeated rows are packed as often as they
occur. An empty table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import arrow_rows, cut
from larkspur.llm.text import slices

#: Pieces in a bucket at most, about; islands of a bucket; packings in an island; generations of an epoch, more in smaller buckets.
BUCKET_ITEMS, ISLANDS, POPULATION, GENERATIONS = 4096, 3, 4, 6
#: Bins that a step tries to fill better by swaps; a bucket's emptiest bins that meet those of so many other buckets.
TRIES, LOOSE, MET = 400, 48, 32
#: Fixed value: what the pre-tokenizer named ByteLevel splits by; files only name it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizer file's own tokenizer gives them without special ones added.

    A byte-level vocabulary that numbers its tokens in the order of its merges is a table of merge ranks; encoding by ranks
    gives the same ids and needs a fraction of the time and memory. Added tokens that stand in a text are taken first, as
    the tokenizer does. Files of any other making are read by the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))
        added = model.get("added_tokens") or []
        before = model.get("pre_tokenizer") or {}
        odd = any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        options = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges") if model["model"].get(k)]
        if model["model"]["type"] != "BPE" or model.get("normalizer") or odd or options or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids
            return
        import tiktoken

        special = {x["content"]: x["id"] for x in added}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(shown[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
        found = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.encode = lambda text: found.encode(text, allowed_special="all") if any(x in text for x in special) else found.encode_ordinary(text)

    def __call__(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                size = n - capacity * ((n - 1) // capacity)
                while at < n:
                    for column, value in zip(out, (doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                        column.append(value)
                    at, k, size = at + size, k + 1, capacity
            yield pa.record_batch([pa.array(x, type=t.type) for x, t in zip(out, _PIECES, strict=True)], schema=_PIECES)

    arrow_rows(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(order: list[int], lengths: list[int], capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """bins with the items of order added, each to the fullest bin that has room for it."""
    free = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for item in order:
        size = lengths[item]
        at = bisect_left(free, (size, -1))
        if at == len(free):
            bins.append([item])
            insort(free, (capacity - size, len(bins) - 1))
        else:
            room, k = free.pop(at)
            bins[k].append(item)
            if room > size:
                insort(free, (room - size, k))
    return bins


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Larger is better: few bins first, then unevenly filled ones."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def swap_in(loose: list[int], bins: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator, tries: int = TRIES) -> list[int]:
    """Loose items put into bins in place of one or two smaller ones wherever that fills a bin better; what is loose after."""
    sizes = sorted((lengths[i], i) for i in loose)
    for k in rng.permutation(len(bins))[:tries].tolist():
        inside = bins[k]
        room = capacity - sum(lengths[i] for i in inside)
        if not room or not sizes:
            continue
        best, out, at = 0, (), -1
        for n, i in enumerate(inside):
            for j in (None, *inside[n + 1 :]):
                had = lengths[i] + (lengths[j] if j is not None else 0)
                found = bisect_left(sizes, (had + room + 1, -1)) - 1
                if found >= 0 and sizes[found][0] - had > best:
                    best, out, at = sizes[found][0] - had, (i,) if j is None else (i, j), found
        if best:
            _, new = sizes.pop(at)
            bins[k] = [i for i in inside if i not in out] + [new]
            for i in out:
                insort(sizes, (lengths[i], i))
    return [i for _, i in reversed(sizes)]


def crossover(mother: list[list[int]], father: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The father's well-filled bins whole, the mother's bins that share no item with them, the displaced ones by swaps and best fit."""
    fills = np.array([sum(lengths[i] for i in b) for b in father]) / capacity
    chosen = np.flatnonzero(fills >= np.quantile(fills, 0.5))
    chosen = rng.permutation(chosen)[: max(1, int(len(chosen) * rng.uniform(0.2, 0.8)))]
    child = [list(father[k]) for k in chosen]
    taken = {i for b in child for i in b}
    displaced: list[int] = []
    for b in mother:
        if taken.isdisjoint(b):
            child.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    displaced = swap_in(displaced, child, lengths, capacity, rng)
    return best_fit(displaced, lengths, capacity, child)


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The emptiest bins and a few others are taken apart and their items placed again."""
    fills = np.array([sum(lengths[i] for i in b) for b in bins])
    out = {*np.argsort(fills, kind="stable")[: 1 + int(rng.integers(0, 4))].tolist(), *map(int, rng.integers(0, len(bins), 2 + len(bins) // 50))}
    kept = [list(b) for k, b in enumerate(bins) if k not in out]
    loose = swap_in([i for k in out for i in bins[k]], kept, lengths, capacity, rng)
    return best_fit(loose, lengths, capacity, kept)


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[list[int]]], generations: int | None = None, population: int = POPULATION) -> list[list[int]]:
    """The best packing an island finds from the elites and from best-fit packings of its own.

    Islands differ: the first (seed divisible by ISLANDS) begins with best-fit decreasing, the others with ever noisier orders. An island
    ends when it needs no more bins than the total length does, which no packing can better.
    """
    rng = np.random.default_rng(seed)
    if generations is None:
        generations = GENERATIONS * min(10, max(1, BUCKET_ITEMS // max(1, len(lengths))))
    bound = math.ceil(sum(lengths) / capacity)
    key = lambda b: fitness(b, lengths, capacity)
    pool = [[list(b) for b in e] for e in elites]
    noise = 0.0 if seed % ISLANDS == 0 else capacity / 64 * (seed % ISLANDS)
    while len(pool) < population:
        blur = rng.normal(0, 1, len(lengths)) * noise
        order = sorted(range(len(lengths)), key=lambda i: -(lengths[i] + blur[i]))
        pool.append(best_fit(order, lengths, capacity, []))
        if len(pool[-1]) <= bound:
            return pool[-1]
        noise = noise * 1.5 or capacity / 64
    for _ in range(generations):
        pool.sort(key=key, reverse=True)
        if len(pool[0]) <= bound:
            break
        mother, father = pool[0], pool[1 + int(rng.integers(0, len(pool) - 1))]
        children = [crossover(mother, father, lengths, capacity, rng), crossover(father, mother, lengths, capacity, rng)]
        pool = sorted([*pool, *children, mutate(mother, lengths, capacity, rng), mutate(children[0], lengths, capacity, rng)], key=key, reverse=True)[:population]
    return max(pool, key=key)


def _islands(dealt: DataFrame, capacity: int, islands: int, loose: int) -> DataFrame:
    """uid, length, bucket, bin, offset, spare: each bucket (uid, length, bucket) packed; spare are the items of its loose emptiest bins."""

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], kind="stable")
        found = evolve(pdf.length.tolist(), capacity, int(pdf.bucket.iloc[0]) * 101 * ISLANDS + int(pdf.island.iloc[0]), [])
        place = np.empty(len(pdf), dtype=np.int64)
        for k, b in enumerate(found):
            place[b] = k
        return pdf.assign(bin=place)

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["island", "length", "uid"], kind="stable")
        elites = []
        for _, one in pdf.groupby("island"):
            bins: dict[int, list[int]] = {}
            for i, k in enumerate(one.bin):
                bins.setdefault(k, []).append(i)
            elites.append(list(bins.values()))
        one = pdf[pdf.island == pdf.island.iloc[0]]
        lengths, uids, bucket = one.length.tolist(), one.uid.tolist(), int(one.bucket.iloc[0])
        if min(map(len, elites)) > math.ceil(sum(lengths) / capacity):
            elites.append(evolve(lengths, capacity, bucket * 101 * ISLANDS + 77, elites, population=max(POPULATION, len(elites) + 1)))
        best = sorted(max(elites, key=lambda b: fitness(b, lengths, capacity)), key=lambda b: sum(lengths[i] for i in b))
        rows = []
        for k, b in enumerate(best):
            at = 0
            for i in b:
                rows.append((uids[i], lengths[i], bucket, k, at, k < loose))
                at += lengths[i]
        return pd.DataFrame(rows, columns=["uid", "length", "bucket", "bin", "offset", "spare"])

    spread = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    elites = spread.groupBy("bucket", "island").applyInPandas(first, "uid long, length long, bucket long, island int, bin long")
    return elites.groupBy("bucket").applyInPandas(second, "uid long, length long, bucket long, bin long, offset long, spare boolean")


def pack(items: DataFrame, capacity: int, bucket_items: int = BUCKET_ITEMS, islands: int = ISLANDS) -> DataFrame:
    """uid, sequence_id, offset for items (uid, length up to capacity): sequences that overlap nowhere.

    Buckets are dealt by a hash of uid, so no key or size of the input makes a large one. The emptiest bins of MET buckets
    are packed anew together, and so on with theirs until one bucket is left: what the buckets' bounds leave over meets.
    """
    n = items.count()
    buckets = max(1, math.ceil(n / bucket_items))
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("bucket"))
    done, turn = None, 0
    while True:
        last = buckets == 1
        packed = _islands(dealt, capacity, islands, 0 if last else LOOSE)
        packed = packed if last else cut(packed)
        placed = packed.where("NOT spare").select("uid", (F.lit(turn << 56) + F.col("bucket") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset")
        done = placed if done is None else done.unionByName(placed)
        if last:
            return done
        dealt = packed.where("spare").select("uid", "length", F.floor(F.col("bucket") / MET).alias("bucket"))
        buckets, turn = math.ceil(buckets / MET), turn + 1


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 1024, bucket_items: int = BUCKET_ITEMS, islands: int = ISLANDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text).

    tokenizer is the path of a tokenizer file that every executor can read.
    """
    cutting = cut(pieces(docs, tokenizer or default_tokenizer(), end_id, capacity).withColumn("uid", F.monotonically_increasing_id()))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cutting.where(F.col("length") == capacity).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cutting.where(F.col("length") < capacity)
    placed = pack(rest.select("uid", "length"), capacity, bucket_items, islands)
    return full.unionByName(rest.join(placed, "uid").select(*columns, "sequence_id", "offset"))
