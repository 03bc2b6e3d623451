import math
from collections import Counter, defaultdict

import numpy as np

from larkspur.llm import langid
from larkspur.llm.common import remainder


def test_symbols_and_grams():
    letters = langid.letter_table()
    s, bounds, n = langid.symbols(["Ab, 1c", None, "é"], letters)
    texts = ["".join(map(chr, s[a:b])) for a, b in zip(bounds, bounds[1:])]
    assert "".join(map(chr, s)) == " ab c é " and n.tolist() == [3, 0, 1] and "".join(texts) in " ab c é "
    keys = langid.grams(s, 4)
    assert len(keys) == len(s) - 1
    padded = "   " + "".join(map(chr, s))
    for i, key in enumerate(keys.tolist()):
        assert "".join(chr(key >> (16 * k) & 0xFFFF) for k in (3, 2, 1, 0)) == padded[i + 1 : i + 5]


def brute(text_grams, order=4):
    """Interpolated Kneser-Ney of one language as plain dictionaries."""
    tables = {order: Counter(text_grams)}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    alphabet = len(tables[1])

    def p(g):
        if not g:
            return 1 / (alphabet + 1)
        t = tables[len(g)]
        ones, twos = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        follow = [v for x, v in t.items() if x[:-1] == g[:-1]]
        if not follow:
            return p(g[1:])
        return max(t[g] - d, 0) / sum(follow) + d * len(follow) / sum(follow) * p(g[1:])

    return p


def test_probabilities_match_brute_force():
    text = "  the cat sat on the mat and the bat that sat there ate "
    letters = langid.letter_table()
    s, _, _ = langid.symbols([text], letters)
    keys = langid.grams(s, 4)
    model = langid.kneser_ney({0: np.unique(keys, return_counts=True)}, ["en"])
    to_text = lambda key: "".join(chr(int(key) >> (16 * k) & 0xFFFF) for k in (3, 2, 1, 0))
    p = brute([to_text(k) for k in keys])
    asked, _, _ = langid.symbols(["the rat hat zq eat a cab"], letters)
    for key, log in zip(langid.grams(asked, 4), model.logs(langid.grams(asked, 4))[:, 0], strict=True):
        assert math.isclose(log, math.log(p(to_text(key))), rel_tol=1e-4, abs_tol=1e-4), to_text(key)


def test_languages_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(remainder("doc_id", 5) != 0))
    held = {r.doc_id: r.lang for r in docs.where(remainder("doc_id", 5) == 0).collect()}
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert np.mean([got[d].lang_pred == lang for d, lang in held.items()]) > 0.97
    assert np.mean([r.rejected for r in got.values()]) < 0.01
    odd = [(1, None), (2, ""), (3, "123 !!"), (6, "\U0001f600"), (7, "\U0001f44d\U0001f44d \U0001f389"), (8, "\U00020000\U00020001"), (4, "日本語の文章です。これは別の言語です。" * 5), (4, "x"), (5, "q" * 300000)]
    rows = defaultdict(list)
    for r in langid.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect():
        rows[r.doc_id].append(r)
        assert 0 <= r.score <= 1
    assert [rows[k][0].lang_pred for k in (1, 2, 3, 6, 7)] == ["und"] * 5 and rows[8][0].lang_pred != "und"
    assert any(r.rejected for r in rows[4]) and rows[5][0].rejected
    kept = langid.accepted(spark.createDataFrame(odd, "doc_id long, text string"), model)
    assert {r.doc_id for r in kept.collect()} <= {4, 8} and langid.accepted(docs, model).count() >= 0.99 * docs.count()
    assert langid.train(docs.where("false")) is None
    assert {r.lang_pred for r in langid.predict(docs.limit(3), None).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).collect() == []


def test_windows_match_brute_force_in_any_pieces():
    rng = np.random.default_rng(2)
    letters = langid.letter_table()
    model = langid.kneser_ney({k: np.unique(langid.grams(langid.symbols([t], letters)[0], 4), return_counts=True) for k, t in enumerate(["the cat sat on that mat " * 9, "der hund und die katze " * 9])}, ["a", "b"])
    texts = ["".join(rng.choice(list("thedrcauns ")) for _ in range(n)) for n in (0, 1, 63, 64, 65, 400, 3000)] + [None]
    s, bounds, _ = langid.symbols(texts, letters)
    logs = -model.logs(langid.grams(s, 4)).astype(float)
    before, langid.HELD = langid.HELD, 300
    try:
        h, w, n = model.entropies(s, bounds)
    finally:
        langid.HELD = before
    for k, (a, b) in enumerate(zip(np.minimum(bounds, len(logs)), np.minimum(bounds[1:], len(logs)))):
        assert np.allclose(h[k], logs[a:b].sum(axis=0) / max(1, n[k])) and n[k] == max(1, bounds[k + 1] - bounds[k])
        assert np.isclose(w[k], sum(logs[i : min(i + 64, b)].sum(axis=0).min() for i in range(a, b, 64)) / n[k])


def test_unlearned_languages_are_rejected_and_mixed_known_ones_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 700")
    model = langid.train(docs.where("lang <> 'de'"))
    text = {lang: [r.text for r in docs.where(f"lang = '{lang}'").orderBy("doc_id").limit(60).collect()] for lang in ("de", "fr", "es", "en")}
    rows = [(size * 1000 + i, t[:size]) for size in (40, 120, 600) for i, t in enumerate(text["de"])]
    rows += [(700_000 + i, a[:300] + " " + b[:300]) for i, (a, b) in enumerate(zip(text["fr"], text["es"]))]
    rows += [(900_000 + i, t[:40]) for i, t in enumerate(text["en"])]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    share = lambda low, high: np.mean([r.rejected for d, r in got.items() if low <= d < high])
    assert share(40_000, 41_000) > 0.6 and share(120_000, 121_000) > 0.85 and share(600_000, 601_000) > 0.9
    assert share(700_000, 800_000) == 0 and share(900_000, 1_000_000) < 0.05
    mixed = docs.where("lang <> 'de'")
    assert langid.accepted(mixed, model).count() >= 0.995 * mixed.count()


def test_accepted_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en", 1.5, True)] * 30, "doc_id long, text string, lang string, score double, rejected boolean")
    kept = langid.accepted(docs, langid.train(docs))
    assert kept.columns == docs.columns and kept.count() == 30 and {r.score for r in kept.collect()} == {1.5}


def test_ties_and_repeated_rows(spark):
    rows = [("the cat sat on the mat and the dog", lang) for lang in ("b", "a") for _ in range(40)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, "the cat sat"), (1, "the cat sat"), (2, "the cat sat")], "doc_id long, text string"), model).collect()
    assert {(r.lang_pred, r.rejected) for r in got} == {("a", False)} and len({r.score for r in got}) == 1 and len(got) == 3
