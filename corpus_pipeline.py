"""From documents to packed training sequences: five stages, each a Parquet table that the next one reads.

1. quality classifier: documents that score below its cut go.
2. line dedup: lines of runs that earlier documents have go; n_chars follows. Documents that had words and have none left
   were repeats as wholes, and go.
3. n-gram Jaccard join, of five words and 0.8: of each component the document with the smallest id (of several texts with
   this id, that with the smallest hash) stays.
4. mixing: each document comes as often as the mix of sources takes it.
5. packing: a row for each piece of a sequence.

Rows with a null id pass stages 2 and 3 unchanged. Rows with one id and different texts are different documents. Of rows with
one id and one text, stage 3 keeps one. Stages keep further columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import classifier, line_dedup, mixing, ngram_join, packing
from tessera.llm.shared import WORD, discard, documents, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.accepted(docs, classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = "had_words"
    while before in docs.columns:
        before += "_"
    known = docs.withColumn(before, F.coalesce("text", F.lit("")).rlike(WORD))
    out = line_dedup.line_dedup(known, counts=False)
    out = out.where(~F.col(before) | F.col("text").rlike(WORD)).drop(before)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(docs, words=5, percent=80).where("doc_id IS NOT NULL")
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "tag")).alias("x")).select("x.*")
    stay = first.unionByName(found.where("component IS NULL").select("doc_id", "tag").distinct())
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.where("doc_id IS NOT NULL").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", tag.alias("tag"))
    kept = rows.join(stay.hint("shuffle_hash"), ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"])
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: The classifier's weights can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            discard(before)
    return docs
