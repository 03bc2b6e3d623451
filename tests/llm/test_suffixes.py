import random
from collections import Counter

import numpy as np

from larkspur.llm import common, suffixes


def test_suffix_order_matches_brute_force():
    rng = random.Random(1)
    for t in range(200):
        n, symbols = rng.randint(1, 150), rng.choice([1, 2, 3, 20])
        text = [rng.randrange(1, symbols + 1) for _ in range(n)] if t % 3 else ([1, 2] * n)[:n]
        got = suffixes.two_stage_order(np.array([*text, 0], dtype=np.uint16), 400)
        assert got.tolist() == sorted(range(n + 1), key=lambda i: [*text, 0][i:])


def test_least_places_match_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        h = np.array([rng.randrange(6) << 40 for _ in range(rng.randint(1, 60))], dtype=np.uint64)
        width = rng.randint(1, 12)
        want = [min(range(i, i + width), key=lambda j: (h[j], j)) for i in range(len(h) - width + 1)]
        assert suffixes.least_places(h, width).tolist() == want


def brute(texts):
    length = suffixes.LENGTH
    seen = Counter(raw[i : i + length] for raw in texts for i in range(len(raw) - length + 1))
    out = []
    for raw in texts:
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(raw), int(gone.sum()), len(suffixes.runs(gone)), bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage, base = fresh(420), fresh(1500)
    rows = [None, "", "x" * 700, "ab" * 300, "short", passage[:199], passage[:200]]
    for k in range(60):
        text = fresh(rng.randint(0, 500))
        if k % 3 == 0:
            cut = rng.randint(0, 200)
            text += passage[cut : cut + rng.randint(150, 400)] + fresh(100)
        if k % 3 == 1:
            near = list(base)
            for _ in range(rng.randint(0, 12)):
                near[rng.randrange(len(near))] = "#"
            text = "".join(near)
        if k % 20 == 5:
            text = text + text
        rows.append(text)
    return rows + rows[10:14]


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(rows)], "doc_id long, text string, key int").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()}
    want = brute([(t or "").encode() for t in rows])
    for i in range(len(rows)):
        assert got[i] == want[i], (i, rows[i], got[i][:3], want[i][:3])


def test_removed_bytes_match_brute_force(spark):
    check(spark, corpus(3))


def test_split_anchors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 3)
    monkeypatch.setattr(suffixes, "SORTED_BYTES", 1000)
    check(spark, corpus(4))


def test_frequent_anchors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_SHARE", 1.0)
    monkeypatch.setattr(common, "HOT_TIMES", 4)
    check(spark, corpus(6))


def test_two_hashes_of_strings(spark):
    parts = [bytes(random.Random(k).randrange(256) for _ in range(200 + k)) for k in range(5)] + [b"a" * 210]
    counts = np.array([k + 1 for k in range(5)] + [11])
    h, g = suffixes.string_hashes(parts, counts)
    strings = [p[i : i + 200] for p, n in zip(parts, counts) for i in range(n)]
    assert len(h) == len(strings) and len(set(zip(h.tolist(), g.tolist()))) == len(set(strings)) and (h != g).all()
    assert len({(x, y) for x, y, t in zip(h.tolist(), g.tolist(), strings) if t == b"a" * 200}) == 1


def test_very_long_texts(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(60000))
    check(spark, [long, long[20000:20500] + "!", "ab" * 20000, "unique " + long[:150], long[59000:] + long[:300]])


def test_repeated_ids_and_empty_tables(spark):
    text = "".join(random.Random(5).choice("abcdef") for _ in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (1, "y" + text[:250])], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(docs).collect())
    assert got == [(0, 0), (251, 250), (300, 300), (300, 300), (300, 300)]
    assert suffixes.remove_repeats(docs.where("false")).collect() == []
