import random
import zlib

import numpy as np

import corpus_pipeline
from larkspur.llm import decontaminate, langid, packing, secrets, similarity
from tests.llm.test_secrets import ASSIGN, brute_markov


def test_stages_on_planted_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first()
    clean = docs.where("length(text) > 900").orderBy("doc_id").first()
    planted = [
        (90001, clean.text, "en", "s", len(clean.text)),
        (90002, clean.text + " word", "en", "s", len(clean.text) + 5),
        (90003, "Some words before it. " + item.text + " Some words after.", "en", "s", 1),
        (90004, "日本語の文章です。" * 40, None, None, 1),
        (90005, "Of the and " + " ".join(f"the{k}" for k in range(20)) + " token=abcdefgh12345 of and", "en", "s", 1),
        (90006, None, None, None, None),
    ]
    spark.createDataFrame(planted, docs.schema).unionByName(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = now
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        ids[name] = {r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in now.select("doc_id").collect()}
    assert {90004, 90006} <= ids["language_id"] and len(ids["language_id"]) <= 4
    assert {90001, 90002} <= ids["near_duplicates"] and clean.doc_id not in ids["near_duplicates"]
    assert 90003 in ids["benchmark_decontamination"] and not ids["secret_masking"]
    masked = now.where("doc_id = 90005").first()
    assert "abcdefgh12345" not in masked.text and masked.n_chars == len(masked.text)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in now.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == pieces.count()
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5
    assert all((decontaminate, langid, packing, secrets, similarity))


def slow_overlap(words, item):
    """Whether some run on a diagonal of the two begins and ends with agreement, agrees in four fifths and is long enough."""
    for shift in range(-len(item), len(words) + 1):
        equal = [words[k + shift] == item[k] for k in range(len(item)) if 0 <= k + shift < len(words)]
        for a in range(len(equal)):
            for b in range(a + min(13, len(item)), len(equal) + 1):
                if equal[a] and equal[b - 1] and 5 * sum(equal[a:b]) >= 4 * (b - a):
                    return True
    return False


def test_stages_match_slow_ones(spark, tmp_path):
    """Near-duplicates, decontamination, masking and packing in plain Python, from what the language stage kept."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    item = fresh(20)
    texts = []
    for k in range(120):
        words = fresh(rng.randint(5, 80))
        if k % 5 == 1 and texts:
            words = texts[-1].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if k % 11 == 3:
            words = words + item[rng.randint(0, 4) :]
        if k % 13 == 4:
            words.append("password=" + "".join(rng.choice("abcdef0123456789") for _ in range(16)))
        texts.append(" ".join(words))
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(500, texts[3], "en", "s", 1), (3, texts[3], "en", "s", len(texts[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    here = str(tmp_path)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, docs, here).collect()]
    assert len(kept) >= 0.95 * len(rows)

    def sets(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    kept = sorted(set(kept))
    shingles = [sets(t) for _, t in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j]):
                group = [group[j] if g == group[i] else g for g in group]
    left = [kept[i] for i in range(len(kept)) if kept[i][0] == min(kept[j][0] for j in range(len(kept)) if group[j] == group[i])]
    left = [(d, t) for d, t in left if not slow_overlap(t.split(), item)]
    models = secrets.fit(spark.createDataFrame(left, "doc_id long, text string"))
    want = {}
    for d, t in left:
        spans = [(m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8] + [(s, e) for s, _, _, e in (brute_markov(t, models) if models else [])]
        for s, e in sorted(spans, reverse=True):
            t = t[:s] + "[SECRET]" + t[e:]
        want[d] = t
    assert len(want) < len(kept) - 15 and sum("[SECRET]" in t for t in want.values()) >= 4
    got = corpus_pipeline.run(spark, here).collect()
    tokens = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    encode = packing.Encoder(packing.default_tokenizer())
    assert tokens == {d: len(encode(t)) // 4 + 1 for d, t in want.items()}
    ids = {d: np.append(np.frombuffer(encode(t), "<u4"), np.uint32(2)).astype("<u4") for d, t in want.items()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in got)


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    odd = docs.selectExpr("*", "1 AS node", "'x' AS found", "doc_id AS gone", "2.5D AS score", "true AS rejected", "'k' AS __key", "3L AS uid", "4 AS item_id", "'t' AS text_hash")
    odd = odd.unionByName(spark.createDataFrame([(90001, "w " * 120000, None, None, None, 1, "x", 9, 2.5, True, "k", 3, 4, "t"), (None, None, None, None, None, 1, "x", 9, 2.5, True, "k", 3, 4, "t")], odd.schema))
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, odd, "/root/testdata/sf0.001")
        got = now.collect()
        if name != "best_fit_packing":
            assert now.columns == odd.columns and all(r.found == "x" and r.uid == 3 for r in got if r.doc_id is not None)
        assert len(got) >= (1 if name == "benchmark_decontamination" else 30), name
        assert stage(spark, odd.where("false"), "/root/testdata/sf0.001").collect() == []
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
