import hashlib
import random

from pyspark.sql import functions as F

from larkspur.llm import fingerprints as fp


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def run(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        docs = docs.withColumn("hash", F.lit("x")).withColumn("pid", F.lit(1))
    return fp.compare_with_edits(docs).collect()


def test_edited_texts_match_brute_force(spark):
    rng = random.Random(3)
    texts = {i * 7: words(rng, rng.randint(1, 60)) for i in range(40)} | {5: None, 6: "", 8: "é😀x", 9: "A b C"}
    got = {r.doc_id: r for r in run(spark, list(texts.items()), True)}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].next_fp == got[order[(k + 1) % len(order)]].fp
    assert got[5].fp == got[6].fp == 0


def test_votes_match_brute_force(spark):
    text = "The cat sat on the cat  sat down\tthe"
    hashes = spark.createDataFrame([(text,)], "text string").select(F.explode(fp.term_hashes(F.col("text"))).alias("h")).collect()
    expected = 0
    for b in range(64):
        ones = sum((r.h >> b) & 1 for r in hashes)
        expected |= (1 << b) * (2 * ones > len(hashes))
    got = fp.simhash(spark.createDataFrame([(1, text)], "k long, text string"), ["k"]).first().fp
    assert got % (1 << 64) == expected and len(hashes) == 8


def test_repeated_rows_and_single_rows(spark):
    assert run(spark, []) == []
    (only,) = run(spark, [(4, "abcd")])
    assert only.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and only.next_fp == only.fp
    got = run(spark, [(1, "same text here"), (1, "same text here"), (2, "other"), (None, "none")])
    assert len(got) == 4 and len({r.fp for r in got if r.doc_id == 1}) == 1
    got = run(spark, [(1, "one text"), (1, "another text"), (2, "other")])
    assert len(got) == 3


def test_neighbours_match_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(30)]
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(63), k))
    all_fps = base + [flip(x, k) for x in base for k in (0, 1, 2, 3, 4, 5)]
    docs = spark.createDataFrame(list(enumerate(all_fps)), "doc_id long, fp long")
    queries = docs.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r.doc_id, r.distance) for r in fp.neighbours(queries, docs, 3).collect()}
    want = {(q, d, n) for q in range(0, len(all_fps), 5) for d, y in enumerate(all_fps) if (n := ((all_fps[q] ^ y) & ((1 << 64) - 1)).bit_count()) <= 3}
    assert got == want


def test_counts_of_neighbours_match_brute_force(spark):
    rng = random.Random(6)
    base = words(rng, 40)
    texts = [base] * 30 + [base + f" {k}" for k in range(40)] + [words(rng, 30) for _ in range(60)] + ["", None]
    rows = [(i * 5, t) for i, t in enumerate(texts)] + [(0, base), (None, base)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None or r.doc_id % 50:
            assert r.n_near is None
        else:
            assert r.n_near == sum(((r.fp ^ o.fp) & ((1 << 64) - 1)).bit_count() <= fp.RADIUS for o in got) - 1
    assert max(r.n_near or 0 for r in got) >= 30


def test_very_long_texts_and_ties_of_votes(spark):
    long = "alpha beta " * 150000
    got = {r.doc_id: r for r in run(spark, [(1, long), (2, long), (3, "alpha beta")])}
    assert got[1].fp == got[2].fp and got[1].n_chars == len(long)
    one, two = (spark.range(1).select(F.xxhash64(F.lit(a), F.lit(b)).alias("h")).first().h for a, b in (("a", "b"), ("b", "c")))
    tied = fp.simhash(spark.createDataFrame([(1, "a b c")], "k long, text string"), ["k"]).first().fp
    assert tied & ((1 << 64) - 1) == one & two & ((1 << 64) - 1)
