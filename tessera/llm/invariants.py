"""What SQL can say of results that it can't make: queries over the operators' whole results, and the SQL that gives the same rows.

Scores, token ids and packing orders are no SQL; that pieces tile documents, edits have their digests, mixes come near
their targets and base scores are sums of logarithms is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .classifier import op4_quality_classifier
from .fingerprints import op6_fingerprints
from .lm_scoring import op10_lm_scoring
from .mixing import op7_mixing
from .packing import WINDOW, op5_packing
from .shared import WORD, documents, stored
from .token_counts import op9_token_counts

#: crc32 of an id's digits modulo 5, bit by bit.
_CRC = """CASE WHEN doc_id IS NULL THEN -1 ELSE xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 5 END"""


def classifier_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document once, held out by its id, with a score from 0 to 1 that the prediction follows."""
    rows = op4_quality_classifier(spark, sf_dir)
    return rows.select("doc_id", "held_out", (F.col("score").between(0, 1) & ((F.col("score") >= 0.3) == (F.col("predicted") == 1))).alias("sound"))


CLASSIFIER_SQL = f"SELECT doc_id, {_CRC} = 0 AS held_out, true AS sound FROM documents"


def packing_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces tile documents and sequences without gap, and sequences are whole windows or powers of two."""
    rows = stored(op5_packing(spark, sf_dir), "packed")
    by_doc = W.partitionBy("doc_id").orderBy("start")
    before = F.coalesce(F.lag(F.col("start") + F.col("length")).over(by_doc), F.lit(0))
    docs = rows.withColumn("gap", F.col("start") != before).groupBy("doc_id").agg(F.bool_or("gap").alias("gap"), F.sum("length").alias("n"), F.max("doc_tokens").alias("doc_tokens"), F.min("length").alias("least"))
    docs = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.bool_and(~F.col("gap") & (F.col("n") == F.col("doc_tokens")) & (F.col("least") > 0)).alias("documents_tiled"))
    by_sequence = W.partitionBy("sequence_id").orderBy("offset")
    before = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(by_sequence), F.lit(0))
    sequences = rows.withColumn("gap", F.col("offset") != before).groupBy("sequence_id").agg(F.bool_or("gap").alias("gap"), F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    sequences = sequences.agg(F.bool_and(~F.col("gap") & (F.col("n") <= WINDOW)).alias("sequences_tiled"), F.bool_and(power).alias("no_padding"))
    # a row each
    return docs.withColumn("k", F.lit(0)).join(sequences.withColumn("k", F.lit(0)), "k").drop("k")


PACKING_SQL = "SELECT count(*) AS n_docs, true AS documents_tiled, true AS sequences_tiled, true AS no_padding FROM documents"


def fingerprints_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    likely = F.col("near_edited").between(0, 1) & F.col("near_next").between(0, 1)
    return op6_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256", likely.alias("likely"))


FINGERPRINTS_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
following AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS next FROM t)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || CASE WHEN length(t) < 2 THEN '' ELSE substr(next, 1, length(t) // 2) END) AS edited_sha256, true AS likely FROM following"""


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source its size, target and whether what it gives is near: within half of its largest document."""
    rows = op7_mixing(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    out = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"), F.round(F.max("target"), 3).alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("largest"), F.max("copies").alias("most"))
    return out.select("source", "n_docs", "source_size", "target", ((F.abs(F.col("taken") - F.col("target")) <= F.col("largest") / 2 + 0.001) & (F.col("most") <= 3)).alias("near"))


MIXING_SQL = rf"""
WITH sizes AS (SELECT source, count(*) AS n_docs, CAST(coalesce(sum(len(regexp_extract_all(coalesce(text, ''), '{WORD}'))), 0) AS BIGINT) AS source_size FROM documents GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sizes),
capped AS (SELECT *, coalesce(sum(source_size) OVER b, 0) * 3 AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest, sum(source_size) OVER () AS total
  FROM weighed WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT min_by(x, place) AS x FROM (SELECT (total - capped) / rest AS x, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place, weight, source_size FROM capped) WHERE x * weight <= source_size * 3)
SELECT source, n_docs, source_size, round(least(x * weight, source_size * 3.0), 3) AS target, true AS near FROM weighed, level"""


def token_counts_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op9_token_counts(spark, sf_dir)
    sound = (F.col("over_limit") == (F.col("n_tokens") > 2048)) & (F.col("n_tokens") <= F.col("n_bytes")) & ((F.col("n_tokens") > 0) | (F.col("n_bytes") < 4))
    return rows.select("doc_id", "n_bytes", sound.alias("sound"))


TOKEN_COUNTS_SQL = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, true AS sound FROM documents"


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the model's own score, which is a logarithm."""
    rows = op10_lm_scoring(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"), (F.col("score") < 0).alias("sound"))


LM_SQL = rf"""
WITH words AS (SELECT doc_id, {_CRC} = 1 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
tokens AS (SELECT doc_id, held_out, unnest(list_append(list_transform(w, lambda x: 'w' || x), 'end')) AS t FROM words),
counts AS (SELECT t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY t),
totals AS (SELECT sum(c) AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 3) AS base_score, true AS sound
FROM tokens LEFT JOIN counts USING (t), totals GROUP BY doc_id, held_out"""

QUERIES = {
    "classifier_shape": (classifier_shape, CLASSIFIER_SQL),
    "packing_tiling": (packing_tiling, PACKING_SQL),
    "fingerprints_edits": (fingerprints_edits, FINGERPRINTS_SQL),
    "mixing_targets": (mixing_targets, MIXING_SQL),
    "token_counts_bytes": (token_counts_bytes, TOKEN_COUNTS_SQL),
    "lm_base_scores": (lm_base_scores, LM_SQL),
}
