"""The corpus operators' queries for the entry module, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, fingerprints, html, langid, lmscore, packing, quality, secrets, similarity, suffixes
from larkspur.llm.common import remainder, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similarity_join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(F.coalesce(remainder("doc_id", 5) != 0, F.lit(True))).select("text", "lang"))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    found = quality.classify(table(spark, sf_dir, "documents"), labels)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.said("fp").alias("fingerprint"),
        fingerprints.said("edited_fp").alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.coalesce(remainder("doc_id", 5) != 1, F.lit(True))
    found = lmscore.lattice_scores(table(spark, sf_dir, "documents"), training)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_language_id": op4_language_id,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scans": op8_secret_scans,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_html_extraction": op10_html_extraction,
}
#: The other operators hold models, hashes or searches that SQL has no words for; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT x, y FROM pairs WHERE 100 * c >= 90 * (na + nb - c)),
both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.y FROM reach r JOIN both_ways l ON l.x = r.b),
components AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
links AS (SELECT x AS doc_id, count(*) AS n FROM both_ways GROUP BY x),
sizes AS (SELECT g, count(*) AS n FROM s GROUP BY g)
SELECT s.doc_id, len(s.g) AS n_shingles, c.component_id, coalesce(l.n, 0) AS n_links, CASE WHEN len(s.g) = 0 THEN 1 ELSE z.n END AS class_size
FROM s JOIN components c USING (doc_id) LEFT JOIN links l USING (doc_id) JOIN sizes z ON s.g = z.g
""",
}
