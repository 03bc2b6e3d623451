import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import quality
from larkspur.llm.common import remainder
from larkspur.llm.text import column_bytes


def test_statistics_of_single_texts_equal_those_in_a_batch():
    texts = ["", None, "One two. Two!\nThree three\n\nx", "ALL CAPS!! 123", "é ü\n", "\n", "word " * 50]
    whole = quality.statistics(*column_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.statistics(*column_bytes(pa.array([t], pa.string())))[0]), t
    by = dict(zip(quality.NAMES, whole[2], strict=True))
    assert np.isclose(by["log_words"], np.log1p(6)) and np.isclose(by["distinct_words"], 5 / 6) and np.isclose(by["exclamations"], 1 / 28)
    assert np.isclose(by["repeat_next"], 1 / 6) and np.isclose(by["distinct_lines"], 1.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 1)), min_size=1, max_size=40))
def test_isotonic_is_monotone_and_keeps_the_mean_order(rows):
    x, y = np.array([a for a, _ in rows], float), np.array([b for _, b in rows])
    knots, levels = quality.isotonic(x, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= 0).all() and ((levels > 0) & (levels < 1)).all()


def test_quality_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality label")
    known = labels.where(remainder("doc_id", 4) != 2)
    got = quality.classify(docs, known).join(labels.where(remainder("doc_id", 4) == 2), "doc_id").toPandas()
    good, bad = got[got.label == 1].score.to_numpy(), got[got.label == 0].score.to_numpy()
    auc = np.mean(good[:, None] > bad[None, :]) + 0.5 * np.mean(good[:, None] == bad[None, :])
    assert auc > 0.9, auc
    assert ((got.score >= 0.7) == (got.label == 1)).mean() > 0.9


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, "", 4), (2, "a b c", 5)], "doc_id long, text string, label int")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5] * 3
    assert quality.classify(docs.where("false"), none).collect() == []
    one = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, label int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, one).collect())


def slow_statistics(text):
    """The statistics of one text, by plain loops."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [w.lower() for w in words]
    each = max(1, len(words))
    lines = re.findall(rb"[^\n]*\n|[^\n]+", raw)
    of = max(1, len(lines))
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    symbol = lambda c: not letter(c) and not 48 <= c <= 57 and c not in b".," and c > 32
    mean = sum(map(len, words)) / each
    return [
        math.log1p(len(words)), mean, math.sqrt(max(0, sum(len(w) ** 2 for w in words) / each - mean**2)), sum(65 <= c <= 90 for c in raw) / n, sum(48 <= c <= 57 for c in raw) / n,
        sum(c in b".," for c in raw) / n, sum(map(symbol, raw)) / n, raw.count(b"!") / n, sum(c >= 128 for c in raw) / n, len(set(low)) / each, max(Counter(low).values(), default=0) / each,
        len({x.lower() for x in lines}) / of if lines else 0, math.log1p(len(words) / of), sum(len(x) < 30 for x in lines) / of, sum(65 <= w[0] <= 90 for w in words) / each,
        sum(symbol(w[-1]) and w[-1] not in b"!?" for w in words) / each, sum(a == b for a, b in zip(low, low[1:])) / each, sum(w[-1:] == b"." for w in words) / each,
    ]


TEXTS = [None, "", " ", "\n\n", "One two. Two!\nThree three\n\nthree", "ALL CAPS!! 123 #tag* (x)", "é ü 日本\n", "word " * 70000, "a\ta\ta A. b, c? d;\nA. b"]


def test_statistics_match_plain_loops(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = quality.statistics(*column_bytes(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert np.allclose(got[i], slow_statistics(t), atol=1e-6), (t and t[:100], dict(zip(quality.NAMES, zip(got[i], slow_statistics(t)))))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 1)), min_size=1, max_size=30))
def test_pooling_matches_the_extremes_of_means(rows):
    x, y = np.array([a for a, _ in rows], float), np.array([b for _, b in rows], float)
    blocks = quality.pooled(x, y)
    places = sorted(set(x))
    mean = lambda a, b: y[(x >= places[a]) & (x <= places[b])].mean()
    for i, place in enumerate(places):
        want = max(min(mean(a, b) for b in range(i, len(places))) for a in range(i + 1))
        (got,) = [total / size for total, size, low, high in blocks if low <= place <= high]
        assert math.isclose(got, want, abs_tol=1e-12)


def test_scores_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality label").where(remainder("doc_id", 4) != 2)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    stats = quality.with_statistics(docs)
    rows = stats.join(labels.where("label IS NOT NULL"), "doc_id", "left").selectExpr("doc_id", "x", "cast(label AS double) label", "pmod(xxhash64(xxhash64(x, label)), 5) part").collect()
    x = np.array([slow_statistics(None)] * len(rows))
    text = {r.doc_id: r.text for r in docs.collect()}
    x = np.array([slow_statistics(text[r.doc_id]) for r in rows]).astype(np.float32).astype(float)
    known = np.array([r.label is not None for r in rows])
    y, part = np.array([r.label or 0.0 for r in rows]), np.array([r.part for r in rows])
    rng = np.random.default_rng(7)
    wide = len(quality.NAMES)
    directions, phases = rng.normal(0, 0.35, (wide, quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.clip((x - x[known].mean(axis=0)) / np.sqrt(np.maximum(x[known].var(axis=0), 1e-8)), -6, 6)
    waves = np.array([[math.sqrt(2 / quality.FEATURES) * math.cos(sum(a * b for a, b in zip(row, directions[:, k])) + phases[k]) for k in range(quality.FEATURES)] for row in z])
    features = np.concatenate([waves, np.ones((len(z), 1))], axis=1)
    fit = known & (part != 0)
    ridge = math.sqrt(quality.RIDGE * fit.sum() / quality.FEATURES)
    weights = np.linalg.lstsq(np.concatenate([features[fit], ridge * np.eye(quality.FEATURES + 1)]), np.concatenate([y[fit], np.zeros(quality.FEATURES + 1)]), rcond=None)[0]
    raw = features @ weights
    held = known & (part == 0)
    knots, levels = quality.isotonic(np.round(raw[held], 6), y[held])
    want = np.interp(raw, knots, levels)
    apart = np.abs(want - np.array([got[r.doc_id] for r in rows]))
    assert len(knots) >= 4 and np.quantile(apart, 0.99) < 1e-3, np.sort(apart)[-10:]


def test_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(k // 2, ("Good text here. " if k % 4 < 2 else "BAD!! #") * 5) for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(40)] + [(0, 0), (1, None)], "doc_id long, label int")
    got = {}
    for r in quality.classify(docs, labels).collect():
        got.setdefault(r.doc_id % 2, set()).add(r.score)
    assert len(got[0]) == len(got[1]) == 1 and min(got[0]) > max(got[1])
