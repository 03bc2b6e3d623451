import math
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from larkspur.llm import packing

TEXTS = [(1, "Hello world, it's fine.\n\n  Two  spaces 123 <|endoftext|> é日本"), (2, ""), (3, None), (4, "word " * 3000), (4, "word " * 3000), (5, "x" * 5000), (None, "no id")]


def brute(texts, capacity=1024):
    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = []
    for doc, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        at, k, size = 0, 0, len(ids) - capacity * ((len(ids) - 1) // capacity)
        while at < len(ids):
            rows.append((doc, k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at, k, size = at + size, k + 1, capacity
    return rows


def test_pieces_and_sequences(spark):
    texts = TEXTS + [(10 + i, "some text of its own " * (i % 97 + 1)) for i in range(300)]
    docs = spark.createDataFrame([(a, b, "clash") for a, b in texts], "doc_id long, text string, uid string")
    got = packing.best_fit_packing(docs, bucket_items=100).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(brute(texts), key=key)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= math.ceil(sum(r.length for r in got) / 1024) + 4


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.best_fit_packing(docs).collect() == []


def test_genetic_steps_keep_every_item_once():
    rng = np.random.default_rng(0)
    lengths = sorted(map(int, rng.integers(300, 600, 60)))
    found = packing.evolve(lengths, 1000, 1, [])
    assert sorted(i for b in found for i in b) == list(range(60))
    assert all(sum(lengths[i] for i in b) <= 1000 for b in found)
    a, b = packing.best_fit(list(range(60)), lengths, 1000, []), packing.best_fit(list(range(59, -1, -1)), lengths, 1000, [])
    child = packing.crossover(a, b, lengths, 1000, rng)
    assert sorted(i for x in child for i in x) == list(range(60)) and len(found) <= min(len(a), len(b))


def test_ids_equal_the_tokenizers():
    rng = np.random.default_rng(5)
    t = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.Encoder(packing.default_tokenizer())
    alphabet = list("abc AB'srtldm 019.,!?\n\t\u00a0\u2003\u0085\u200béßñ日本😀\u0301Ⅷ²_-") + ["'ll", "  ", "<|endoftext|>", "the "]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(1, 40)))
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def bounds(lengths, capacity, seeds=3):
    """Sequences by best-fit decreasing, by the islands and a common epoch, and at least."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    plain = packing.best_fit(order, lengths, capacity, [])
    elites = [packing.evolve(lengths, capacity, k, []) for k in range(seeds)]
    whole = packing.evolve(lengths, capacity, 77, elites)
    assert sorted(i for b in whole for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= capacity for b in whole)
    return len(plain), min(map(len, [*elites, whole])), math.ceil(sum(lengths) / capacity)


def test_genetic_steps_need_fewer_sequences_than_best_fit_decreasing():
    rng = np.random.default_rng(3)
    gained = 0
    for _ in range(4):
        lengths = rng.integers(20, 100, 400).tolist()
        plain, found, least = bounds(lengths, 150)
        assert least <= found <= plain
        gained += plain - found
    assert gained >= 3
    plain, found, least = bounds(rng.integers(250, 500, 300).tolist(), 1000)
    assert found < plain


def test_emptiest_bins_of_buckets_meet(spark):
    rng = np.random.default_rng(9)
    lengths = rng.integers(1, 1024, 1500).tolist()
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    found = packing.pack(items, 1024, bucket_items=60).select("sequence_id").distinct().count()
    before, packing.LOOSE = packing.LOOSE, 0
    try:
        apart = packing.pack(items, 1024, bucket_items=60).select("sequence_id").distinct().count()
    finally:
        packing.LOOSE = before
    assert math.ceil(sum(lengths) / 1024) <= found < apart - 5


def test_added_tokens_are_taken_first():
    encode = packing.Encoder(packing.default_tokenizer())
    assert np.frombuffer(encode("x <|endoftext|> y"), "<u4").tolist() == [87, 220, 50256, 331]
