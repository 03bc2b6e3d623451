import random

import numpy as np

from larkspur.llm import decontaminate as dc


def sentence(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def brute_overlap(equal, share):
    best = (0, 0)
    for a in range(len(equal)):
        for b in range(a + 1, len(equal) + 1):
            if equal[a] and equal[b - 1] and sum(equal[a:b]) >= share * (b - a) - 1e-9 and b - a > best[1] - best[0]:
                best = (a, b)
    return best


def test_longest_overlap_matches_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        equal = np.array([rng.random() < rng.choice([0.3, 0.8]) for _ in range(rng.randint(1, 30))])
        a, b = dc.longest_overlap(equal, 0.8)
        x, y = brute_overlap(equal.tolist(), 0.8)
        assert (a, b) == (x, y), (equal, (a, b), (x, y))


def test_planted_overlaps_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(6)
    items = [(i, " ".join(sentence(rng, rng.randint(14, 40)))) for i in range(30)] + [(98, "a b"), (99, None)]
    docs, want = [], {}
    for d in range(200):
        words = sentence(rng, rng.randint(0, 120))
        if d % 4 == 0:
            i = rng.randrange(30)
            part = items[i][1].split()
            for k in range(len(part)):
                if d % 8 == 0 and k % 9 == 5:
                    part[k] = "changed"
            if d % 3 == 0:
                part = [w.upper() + "," for w in part]
            words = words + part + sentence(rng, 10)
            want[d] = i
        docs.append((d, " ".join(words), 1))
    docs += [(900, None, 1), (901, "", 1), (902, "... !!! ---", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.overlaps(frame, bench).collect()}
    assert got == {(d, i) for d, i in want.items()}
    kept = dc.decontaminate(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, _, _ in docs} - set(want)


def test_blocks_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "doc_id long, text string")
    bench = docs.selectExpr("doc_id + 10 item_id", "text")
    before, dc.BLOCK_HASHES = dc.BLOCK_HASHES, 1
    try:
        assert dc.overlaps(docs, bench).count() == 4
    finally:
        dc.BLOCK_HASHES = before
    assert dc.overlaps(docs.where("false"), bench).count() == 0 and dc.overlaps(docs, bench.where("false")).count() == 0
    assert dc.decontaminate(docs, bench).count() == 0


def brute_overlaps(words, items):
    """Every diagonal on which a mask's words agree, by plain loops."""
    out = []
    for item_id, item in items:
        best = None
        for shift in range(-len(item), len(words) + 1):
            pairs = [(k + shift, words[k + shift] == item[k]) for k in range(len(item)) if 0 <= k + shift < len(words)]
            equal = [e for _, e in pairs]
            masks = (*dc.MASKS, dc.SHORT_MASK) if len(item) < dc.MIN_WORDS else dc.MASKS
            if not any(all(equal[i + k] for k, on in enumerate(m) if on == "1") for m in masks for i in range(len(equal) - len(m) + 1)):
                continue
            a, b = brute_overlap(equal, 0.8 if len(item) >= dc.SUBSTITUTED else 1.0)
            if b - a >= min(dc.MIN_WORDS, len(item)) and (best is None or sum(equal[a:b]) > best[3]):
                best = (item_id, pairs[0][0] + a, b - a, sum(equal[a:b]), len(item))
        if best and len(item) >= dc.SHORTEST:
            out.append(best)
    return out


def test_overlaps_match_brute_force(spark):
    rng = random.Random(11)
    items = [(i, [f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 10, 12, 13, 20, 30]))]) for i in range(40)]
    docs = []
    for d in range(300):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 60))]
        for _ in range(2):
            part = list(rng.choice(items)[1])
            for k in range(len(part)):
                if rng.random() < 0.12:
                    part[k] = "other"
            at = rng.randint(0, len(words))
            words = words[:at] + part[rng.randint(0, 3) :] + words[at:]
        docs.append((d, words))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first_word, r.n_words, r.n_equal, r.item_words) for r in dc.overlaps(frame, bench).collect())
    want = sorted((d, *x) for d, w in docs for x in brute_overlaps(w, items))
    assert len(want) > 60 and got == want


def test_short_items_with_substitutions(spark):
    bench = spark.createDataFrame([(1, "what is the fastest land animal"), (2, "name all of the planets that go around the sun"), (3, "who wrote hamlet")], "item_id long, text string")
    texts = ["so what are the fastest land animal", "name all of the moons which go around the sun", "and who wrote Hamlet?", "who read hamlet", "who wrote"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.overlaps(docs, bench).collect()) == [(0, 1), (1, 2), (2, 3)]


def test_very_long_text_clashing_columns_and_ties(spark):
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven twelve thirteen", "x")], "item_id long, text string, first_word string")
    item = bench.first().text
    docs = spark.createDataFrame([(1, "filler " * 200000 + item, 5), (1, item + " and " + item, 5), (2, "clean", 5)], "doc_id long, text string, item_id int")
    assert sorted((r.doc_id, r.first_word) for r in dc.overlaps(docs, bench).collect()) == [(1, 0), (1, 200000)]
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", 5)]
