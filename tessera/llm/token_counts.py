"""Token counts by a digest cache: a text is encoded once for each tokenizer version, whoever asks again reads the count.

The key is the SHA-256 of the normalised text (runs of ASCII white space become one space, which the tokenizer does
itself) with the SHA-256 of the tokenizer's file. Texts whose key the cache lacks are grouped by key, with map-side
combining, encoded once for each distinct key, and appended. A lasting cache is a folder that the caller names, or the
session's setting `tessera.token.cache`; where neither is there, the cache is of one call. Counts come back to the rows by
a join that broadcasts the few keys of many rows, so that a text that a third of all rows have is spread over all tasks.

A null text counts as an empty one, with 0 tokens. Rows with the same id or text each get a row. A null id stays.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, documents, small_batches, spread_join, stored, temporary
from .tidying import tidied

WORD_BPE = "word_bpe_49k.json"
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
CACHE_SETTING = "tessera.token.cache"

#: Latin letters, digits and common punctuation, where Python's classes and the tokenizer's split alike.
_PLAIN = re.compile("[\x09-\x0d\x20-\x7e\xa0-įı-ɏ–—‘-„•…€]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[0-9²³¹¼-¾]|(?:[^\s\w]|_)+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts tokens of many texts as encode() does.

    With `pieces`, the file is the lower-casing word BPE: its pre-tokenizer cuts a text into pieces that are merged
    independently, so that a piece's count is remembered. Texts that need more than the plain rules (other scripts,
    control characters, the file's special strings) go through encode() whole.
    """

    def __init__(self, path: str, pieces: bool, remembered: int = 1 << 18):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.pieces, self.remembered, self.known = pieces, remembered, {}

    def __call__(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        whole = []
        for k, text in enumerate(texts):
            if self.pieces and "<|" not in text and _PLAIN.fullmatch(text):
                found = _PIECE.findall(text.lower())
                try:
                    out[k] = sum(map(self.known.__getitem__, found))
                except KeyError:
                    if len(self.known) > self.remembered:
                        self.known.clear()
                    new = list(set(found).difference(self.known))
                    self.known.update(zip(new, self._lengths(new), strict=True))
                    out[k] = sum(map(self.known.__getitem__, found))
            else:
                whole.append(k)
        for k in whole:
            out[k] = self._lengths([texts[k]])[0]
        return out

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encode(texts, add_special_tokens=False)]


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """One for each Python worker, which serves many partitions."""
    if path not in _counters:
        _counters[path] = Counter(path, os.path.basename(path) == WORD_BPE)
    return _counters[path]


def _encode(path: str):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(count(texts), pa.int64())], ["digest", "n_tokens"])

    return run


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE, " "), 256))


def _cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest and n_tokens, a row for each; several where tables were appended at the same time count once."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    return known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str | None = None, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs(doc_id, text).

    tokenizer: a file for the tokenizers library; word_bpe_49k.json unless given. cache: a folder of Parquet tables, read
    before and appended to after.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or tokenizer_path(WORD_BPE)
    with open(path, "rb") as f:  # a file of the installed package, on every machine
        version = hashlib.sha256(f.read()).hexdigest()
    cache = cache or spark.conf.get(CACHE_SETTING, None) or temporary(spark, "token-cache")
    text = F.coalesce("text", F.lit(""))
    keyed = stored(docs.select("doc_id", digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "token-keys")

    own = docs.select(digest(text).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    missing = own.join(_cached(spark, cache, version).hint("shuffle_hash"), "digest", "left_anti")
    counted = missing.mapInArrow(_encode(path), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    return spread_join(keyed, _cached(spark, cache, version), ["digest"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
