"""The dealt queries over the driver's tables, one an operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, langid, licenses, lines, packing, pii, quality, simhash, toxicity
from .common import fold, materialize, read

LANG_FOLDS, TOXIC_FOLDS, TOXIC_HELD = 5, 3, 1


def learnable_labels(labels: DataFrame) -> DataFrame:
    """Labels of the rows that a toxicity model may learn from."""
    return labels.where(fold(F.col("doc_id"), TOXIC_FOLDS) != TOXIC_HELD)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("n_soft").cast("long").alias("n_soft"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    at = fold(F.col("doc_id"), LANG_FOLDS)
    filters = langid.fit(docs.where(at != 0))
    out = langid.identify(docs.select("doc_id", F.coalesce(at == 0, F.lit(False)).alias("held_out"), "text"), filters)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, learnable_labels(read(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id"), TOXIC_FOLDS) == TOXIC_HELD, F.lit(False))
    out = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    predicted = F.when(F.col("score") >= model.settings.threshold, 1).otherwise(0)
    return out.select("doc_id", "held_out", "score", predicted.alias("predicted"), "n_segments")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = lines.drop_boilerplate(docs)
    return out.select("doc_id", F.col("__brindle_lines").alias("n_lines"), F.col("__brindle_cut").alias("n_cut"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = materialize(pii.candidates(docs).drop("text"), "pii-candidates")
    out = pii.decide(found, pii.train(pii.found_counts(found)))
    counts = [F.size(F.filter("pii_base", pii.by(k, lambda k, s: s["kind"] == k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.show(F.col("pii_base")), 256).alias("base_sha256"), pii.show(F.col("pii_spans")).alias("spans"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_language_id, op3_toxicity, op4_license_scan, op5_line_dedup, op6_simhash_dedup, op7_embedding_dedup, op8_packing, op9_pii, op10_bpe)
}

_R, _S = quality.Rules(), lines.Spread()

OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, t,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT r, k, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] AS gram
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS k FROM w WHERE len(words) >= 3)),
dup AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT k + o) AS n FROM dup, (VALUES (0), (1), (2)) AS v(o) GROUP BY r),
c AS (SELECT w.r, doc_id, host, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep ON w.r = rep.r),
f AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_pct} * n_words AS base_failed,
             (n_symbols * 100 > word_chars * {_R.max_symbol_pct})::INT + (n_dup_lines * 100 > n_lines * {_R.max_dup_line_pct})::INT
             + (word_chars < n_words * {_R.min_mean_chars} OR word_chars > n_words * {_R.max_mean_chars})::INT AS n_soft FROM c),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR n_soft > 0) AS bad FROM f GROUP BY host),
m AS (SELECT sum(n) AS total, sum(bad) / sum(n)::DOUBLE AS mean, sum(bad * bad / n::DOUBLE) / sum(n) AS squares FROM h),
p AS (SELECT mean, CASE WHEN squares - mean * mean <= 0 THEN {_R.most_strength}
                   ELSE least(greatest(mean * (1 - mean) / (squares - mean * mean) - 1, {_R.least_strength}), {_R.most_strength}) END AS strength FROM m),
v AS (SELECT host, (bad + mean * strength) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND rate < {_R.block_rate} AND n_soft <= CASE WHEN rate < {_R.watch_rate} THEN 1 ELSE 0 END AS kept,
       n_soft::BIGINT AS n_soft
FROM f JOIN v USING (host)
"""

OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, source, k, line AS raw, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded
      FROM (SELECT r, doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM d)),
b AS (SELECT line, min(doc_id) AS first FROM l WHERE worded GROUP BY line HAVING count(DISTINCT source) >= {_S.min_sites}),
k AS (SELECT l.r, l.k, l.raw, l.worded AND b.line IS NOT NULL AND l.doc_id IS DISTINCT FROM b.first AS cut FROM l LEFT JOIN b ON l.line = b.line),
a AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_cut, string_agg(raw, chr(10) ORDER BY k) FILTER (WHERE NOT cut) AS kept FROM k GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_cut, 0) AS n_cut, sha256(coalesce(kept, '')) AS text_sha256
FROM d LEFT JOIN a USING (r)
"""

ORACLE_SQL = {"op1_quality_rules": OP1_SQL, "op4_license_scan": licenses.scan_sql(), "op5_line_dedup": OP5_SQL}
