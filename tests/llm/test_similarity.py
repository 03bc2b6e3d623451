import random

import numpy as np
import pyarrow as pa

from larkspur.llm import common, similarity
from larkspur.llm.components import components


def sets(texts, words):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute(rows, words, percent):
    s = sets([t for _, t in rows], words)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: (len(s[i]), least[top(i)], links[i]) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    fresh = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    line, base = fresh(30), fresh(150)
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "two words"), (1006, "a b c d")]
    for i in range(n):
        kind = i % 6
        words = list(base) if kind < 3 else fresh(rng.randint(1, 90))
        if kind in (1, 2):
            for _ in range(rng.randint(0, 8)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if kind == 3:
            words = line + words[: rng.randint(0, 6)]
        if kind == 4 and rows[-1][1]:
            words = rows[-rng.randint(1, 7)][1].split() if rows[-1][1] else words
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed, words, percent in ((1, 3, 90), (2, 5, 80)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in similarity.similarity_join(docs, words, percent).collect()}
        assert got == brute(rows, words, percent)


def test_split_families_match_brute_force(spark, monkeypatch):
    rows = corpus(3, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(similarity, "BLOCK_SHINGLES", 1200)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in similarity.similarity_join(docs, 3, 90).collect()}
    assert got == brute(rows, 3, 90)


def test_hot_shingles_and_shuffled_tables_match_brute_force(spark, monkeypatch):
    rows = corpus(4, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(similarity, "HOT_SHARE", 1.0)
    monkeypatch.setattr(common, "HOT_TIMES", 4)
    monkeypatch.setattr(common, "SENT_BYTES", 0)
    monkeypatch.setattr(similarity, "BLOCK_SHINGLES", 1500)
    assert similarity.hot_tokens(docs, 3, 90, 6).count() > 20
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in similarity.similarity_join(docs, 3, 90).collect()}
    assert got == brute(rows, 3, 90)


def test_hot_keys_are_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(k,) for k in range(40) for _ in range(k)], "token long")
    monkeypatch.setattr(common, "HOT_TIMES", 10)
    assert {r.token for r in common.hot_keys(rows, "token").collect()} == set(range(10, 40))
    monkeypatch.setattr(common, "HOT_KEYS", 25)
    assert 0 < common.hot_keys(rows, "token").count() <= 25 and common.hot_keys(rows.where("token < 5"), "token") is None


def test_very_long_texts_and_the_exact_limit(spark):
    long = " ".join(f"w{k}" for k in range(60000))
    same = [f"x{k}" for k in range(39)]
    rows = [(1, long), (2, long + " more"), (3, " ".join(same)), (4, " ".join([*same[:37], "other", "words"])), (5, " ".join(same[:-1])), (6, "y " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in similarity.similarity_join(docs, 3, 90).collect()}
    assert got == brute(rows, 3, 90) and got[2][1] == 1 and got[6][0] == 1


def test_one_of_each_keeps_clashing_columns(spark):
    schema = "doc_id long, text string, gone string, text_hash long, __drop int, __hash int, node string"
    docs = spark.createDataFrame([(1, "a b c d e f", "g", 2, 3, 4, "n"), (1, "a b c d e f", "g", 2, 3, 4, "n"), (2, "a b c d e f", "g", 2, 3, 4, "n"), (3, "other", "g", 2, 3, 4, "n")], schema)
    kept = similarity.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", "g", 2, 3, 4, "n"), (3, "other", "g", 2, 3, 4, "n")]
    assert similarity.one_of_each(docs.where("false")).collect() == []


def test_adaptive_links_match_brute_force():
    for seed in range(6):
        rows = corpus(10 + seed, 100)
        grams, begin = similarity.shingle_sets(pa.array([t for _, t in rows]), 3)
        got = {tuple(sorted((r, int(o)))) for r, others in similarity.adaptive_links(grams, begin, 90) for o in others}
        s = sets([t for _, t in rows], 3)
        assert got == {(j, i) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 90 * len(s[i] | s[j])}
        assert [len(x) for x in s] == np.diff(begin).tolist()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = similarity.similarity_join(docs, 3, 90).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {1} and {r.n_links for r in got} == {3}
    assert similarity.similarity_join(docs.where("false")).collect() == []
    assert sorted((r.doc_id or 0) for r in similarity.one_of_each(docs).collect()) == [0, 1]


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(200 + i, 200) for i in range(30)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in components(frame).collect()}
    slow = {r.node: r.label for r in components(frame, few=5).collect()}
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        root[top(a)] = top(b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    for found in (got, slow):
        assert set(found) == nodes
        assert all((found[a] == found[b]) == (top(a) == top(b)) for a in nodes for b in nodes)
