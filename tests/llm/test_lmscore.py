import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import lmscore


def pieces_of(lattice, raw):
    """All pieces that raw, a marked word, can be cut into, by brute force over substrings."""
    powers = lmscore._powers(lmscore.LONGEST)
    found = {}
    for i in range(len(raw)):
        for j in range(i + 1, min(len(raw), i + lmscore.LONGEST) + 1):
            part = np.frombuffer(raw[i:j], np.uint8)
            h = np.sum(lmscore.tables()[0][part] * powers[: j - i], dtype=np.uint64)
            k = np.searchsorted(lattice.hashes, lmscore.splitmix(np.array([h ^ np.uint64(j - i)])))[0]
            if k < len(lattice.hashes) and lattice.hashes[k] == lmscore.splitmix(np.array([h ^ np.uint64(j - i)]))[0]:
                found[i, j] = lattice.logs[k]
    return found


def brute_word(lattice, word):
    raw = bytes([lmscore.MARK]) + word.encode()
    found = pieces_of(lattice, raw)

    def total(i):
        return 1.0 if i == len(raw) else sum(math.exp(p) * total(b) for (a, b), p in found.items() if a == i)

    return math.log(total(0))


def test_words_match_the_sum_over_segmentations():
    lattice = lmscore.vocabulary(lmscore.default_vocabulary())
    assert abs(np.exp(lattice.logs).sum() - 1) < 1e-6
    words = ["the", "nation", "été", "x", "thhaing", "日本"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    got = lattice.words(data, np.concatenate([[0], ends[:-1]]), ends)
    for w, x in zip(words, got, strict=True):
        assert math.isclose(x, brute_word(lattice, w), rel_tol=1e-9), w
        assert math.isclose(x, lattice.long(np.frombuffer(bytes([lmscore.MARK]) + w.encode(), np.uint8)), rel_tol=1e-9)


def test_expected_counts_of_a_word_cover_it_once():
    lattice = lmscore.vocabulary(lmscore.default_vocabulary())
    raw = np.frombuffer(bytes([lmscore.MARK]) + b"station", np.uint8)[None, :]
    counts = np.zeros(len(lattice.logs))
    lattice.expect(raw, np.array([2.0]), counts)
    assert 2.0 <= counts.sum() <= 16.0


def test_long_words_are_expected_as_short_ones(monkeypatch):
    lattice = lmscore.vocabulary(lmscore.default_vocabulary())
    raw = np.frombuffer(bytes([lmscore.MARK]) + "https://example.org/internationalization?ключевые=日本語の文章".encode(), np.uint8)
    want = np.zeros(len(lattice.logs))
    lattice.expect(raw[None, :], np.ones(1), want)
    for band in (1 << 14, 7, 64):
        monkeypatch.setattr(lmscore, "BAND", band)
        got = np.zeros(len(lattice.logs))
        lattice.expect_long(raw, got)
        assert np.allclose(got, want, atol=1e-9)
        assert math.isclose(lattice.long(raw), lattice.forward(raw[None, :])[-1][0], rel_tol=1e-9)


def test_no_piece_of_the_vocabulary_is_left_out():
    lattice = lmscore.vocabulary(lmscore.default_vocabulary())
    assert lattice.longest == lmscore.LONGEST
    whole = ["representation", "responsibility", "infrastructure"]
    data = np.frombuffer("".join(whole).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in whole])
    got = lattice.words(data, ends - [len(w) for w in whole], ends)
    for w, x in zip(whole, got, strict=True):
        assert (0, 1 + len(w)) in pieces_of(lattice, bytes([lmscore.MARK]) + w.encode())
        assert math.isclose(x, brute_word(lattice, w), rel_tol=1e-9), w


def test_long_words_teach_the_scores(spark):
    clause = "これは長い文章であり空白がひとつもない文字列です"
    words = spark.createDataFrame([(k, (clause * k).encode()) for k in range(1, 200, 20)], "hash long, word binary")
    before = lmscore.vocabulary(lmscore.default_vocabulary())
    raw = np.frombuffer(bytes([lmscore.MARK]) + clause.encode(), np.uint8)
    assert lmscore.learn(words, lmscore.default_vocabulary()).long(raw) > before.long(raw) + 1


ROWS = [(1, "The cat sat on the mat"), (2, "the dog\tsat"), (3, None), (4, ""), (5, "zebra " * 3 + "the"), (6, "w" * 300 + " the"), (6, "the"), (7, "the cat")]


def brute_base(rows, training):
    counts = Counter()
    for d, t in rows:
        if training(d):
            counts.update([*(t or "").lower().split(), "<end>"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        tokens = [*(t or "").lower().split(), "<end>"]
        out.append((d, len(tokens), sum(counts[x] > 0 for x in tokens), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), 9)))
    return sorted(out)


def test_base_scores_match_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, n long")
    for bound in (1 << 17, 1):
        monkeypatch.setattr(lmscore, "BROADCAST_WORDS", bound)
        got = lmscore.lattice_scores(docs, F.col("doc_id") % 2 == 1).collect()
        assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got) == brute_base(ROWS, lambda d: d % 2 == 1)
        assert all(r.score < 0 for r in got)
    assert lmscore.lattice_scores(docs, F.lit(False)).count() == len(ROWS)
    assert lmscore.lattice_scores(docs.where("false"), F.lit(True)).collect() == []


def test_scores_match_brute_force_and_prefer_the_corpus(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    learned = docs.where("doc_id % 2 = 1")
    lattice = lmscore.learn(lmscore.count_words(learned), lmscore.default_vocabulary())
    counts = Counter()
    for d, t in ROWS:
        if d % 2 == 1:
            counts.update([*(t or "").lower().split(), "<end>"])
    n, left = sum(counts.values()), lmscore.DISCOUNT * len(counts) / sum(counts.values())
    want = []
    for d, t in ROWS:
        score = math.log10((counts["<end>"] - lmscore.DISCOUNT) / n)
        for w in (t or "").lower().split():
            spelt = lattice.long(np.frombuffer(bytes([lmscore.MARK]) + w.encode(), np.uint8)) + math.log(left)
            score += np.logaddexp(math.log((counts[w] - lmscore.DISCOUNT) / n), spelt) / math.log(10) if counts[w] else spelt / math.log(10)
        want.append((d, score))
    got = sorted((r.doc_id, r.score) for r in lmscore.lattice_scores(docs, F.col("doc_id") % 2 == 1).collect())
    assert np.allclose([s for _, s in got], [s for _, s in sorted(want)], rtol=1e-9)


def test_scores_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = lmscore.lattice_scores(docs, ~held).toPandas()
    print(got.score.sum(), got.base_score.sum())
    assert np.isfinite(got.score).all() and np.corrcoef(got.score, got.base_score)[0, 1] > 0.95


def test_frequent_words_are_those_above_a_count(spark):
    counts = [1] * 50 + [2] * 30 + [5] * 20 + [1000] * 3
    words = spark.createDataFrame(list(enumerate(counts)), "hash long, n long")
    assert [lmscore.frequent_from(words, most) for most in (1000, 60, 53, 52, 22, 3, 2)] == [2, 2, 2, 5, 1000, 1000, 1 << 62]


def test_repeated_rows_and_very_long_texts_score_alike(spark, monkeypatch):
    rows = [(1, "the cat sat " * 40000), (1, "the cat sat " * 40000), (2, "x" * 100000), (3, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in lmscore.lattice_scores(docs, F.lit(True)).collect())
    assert [g[1] for g in got] == [120001, 120001, 2, 3] and got[0] == got[1] and all(np.isfinite(g[2]) for g in got)
