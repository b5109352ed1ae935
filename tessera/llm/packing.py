"""Lexical retrieval packing: documents fill windows of tokens with their nearest neighbours by BM25.

Numbers of documents by term, of all documents, and their mean length are those of the whole corpus. Documents are dealt by
content to shards of about `shard_docs` documents of usual length (a document counts as 1,024 and its tokens, a shard holds
2,048 * `shard_docs` of these): by the term that weighs most in them, terms in turn until a shard is full. A term of more
documents has several shards, by the term that weighs second, and a pair of terms of more documents has several by a
hash of the row. A shard holds one inverted index over its documents' token ids; neighbours in other shards aren't found. A
seed starts a window; the unused documents that BM25 ranks highest for all the seed's terms follow (`near` of them are ranked
at a time, then the next) until the window is full or none of them is left. The document that crosses a window's end is
cut there; its rest starts the next window, as its seed. What a shard has left at its end, less than a window, is cut at
powers of two, the largest first: no sequence is padded.

Weights are whole multiples of 1/32, so that sums are exact in whatever order they are made and a task that runs again packs
alike. Common terms of a shard are scored by products of matrices, others by their postings. A shard's documents, index and
scores, of at most 2 * `shard_docs` documents, are one task's memory, whatever the corpus's size; a document larger than a
shard has one alone. Defined cases: a null text counts as an empty one and gives the end token only. Rows with the same id
each get their pieces. A null id is an id like others, and rows of one id are spread over shards like others.
"""

from __future__ import annotations

import functools
import json
import math
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, documents, parts, small_batches, stored
from .tidying import squeezed, tidied, unsqueezed
from .token_counts import _PLAIN, tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
END = 1
WINDOW = 2048
SHARD_DOCS = 2048
NEAR = 32
USUAL = 1024
VOCABULARY = 1 << 16
#: Terms scored by one product of matrices, and the part of a shard's documents that a term needs for it.
_TERMS, _COMMON = 512, 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict = {}


class Encoder:
    """Token ids as the tokenizers library gives them for a byte-level BPE file.

    Texts of common characters go through tiktoken, which merges by the same ranks about four times as fast; others, and
    those with strings like the file's special ones, go through tokenizers.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path = path
        with open(path) as f:
            data = json.load(f)
        # byte-level files write a byte as a printable character: itself, or else the next code point from 256
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {x["content"] for x in data["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in data["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> list[int]:
        if "<|" not in text and _PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Corpus:
    """What BM25 takes from all documents: how many there are, how many have each term, and their mean length."""

    def __init__(self, df: np.ndarray, docs: int, tokens: int):
        self.df, self.docs, self.mean = df, docs, max(tokens / max(docs, 1), 1.0)
        self.idf = np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32)

    @staticmethod
    def of(ids: list[np.ndarray]) -> Corpus:
        return Corpus(np.bincount(occurrences(ids)[1], minlength=VOCABULARY), len(ids), sum(map(len, ids)))

    def weight(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
        return self.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / self.mean))

    def keys(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The two terms that weigh most in each document, of those that others have; of equal weights the smaller terms."""
        doc, term, tf = occurrences(ids)
        weight = self.weight(term, tf.astype(np.float32), np.fromiter(map(len, ids), np.float32, len(ids))[doc])
        n = np.bincount(doc, minlength=len(ids))
        first = np.cumsum(n) - n
        key = np.rint(np.where(self.df[term] > 1, weight * 32 + 1, 0)).astype(np.int64) << 16 | 0xFFFF - term
        one = np.maximum.reduceat(key, first) if len(ids) else key
        key[key == one[doc]] = -1
        two = np.maximum.reduceat(key, first) if len(ids) else key
        return 0xFFFF - (one & 0xFFFF), 0xFFFF - (np.where(two < 0, one, two) & 0xFFFF)


def occurrences(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of each term of a document, in this order."""
    doc = np.repeat(np.arange(len(ids), dtype=np.uint32 if len(ids) <= 1 << 16 else np.uint64), np.fromiter(map(len, ids), np.int64, len(ids)))
    key, tf = np.unique(doc << doc.dtype.type(16) | np.concatenate([*ids, np.zeros(0, np.uint16)]).astype(doc.dtype), return_counts=True)
    return (key >> key.dtype.type(16)).astype(np.int64), (key & key.dtype.type(0xFFFF)).astype(np.int64), tf


class Deal:
    """Shards by content, from the sizes of documents by their first term, and by pairs of terms that fill a shard alone."""

    def __init__(self, terms: dict[int, int], pairs: dict[tuple[int, int], int], capacity: int):
        rest = dict(terms)
        self.pairs: list[tuple[int, int, int, int]] = []  # two terms, first shard, number of shards
        self.terms: list[tuple[int, int, int]] = []
        shard = filled = 0
        for (first, second), n in sorted(pairs.items()):
            rest[first] -= n
            self.pairs.append((first, second, shard, math.ceil(n / capacity)))
            shard += math.ceil(n / capacity)
        for term, n in sorted(rest.items()):
            if filled and filled + n > capacity:
                shard, filled = shard + 1, 0
            self.terms.append((term, shard, max(1, math.ceil(n / capacity))))
            filled += n
            if n > capacity:
                shard, filled = shard + self.terms[-1][2], 0
        self.shards = shard + 1


class Index:
    """BM25 over one shard: postings by term, with each posting's weight, and all scores by common terms."""

    def __init__(self, ids: list[np.ndarray], corpus: Corpus | None = None):
        n = self.n = len(ids)
        corpus = corpus or Corpus.of(ids)
        doc, term, tf = occurrences(ids)
        weight = np.rint(32 * corpus.weight(term, tf, np.fromiter(map(len, ids), np.int64, n)[doc])).astype(np.float32)
        df = np.bincount(term, minlength=VOCABULARY)
        # a term of one document only finds nobody
        common = df >= max(2, n // _COMMON)
        self.matched = self._products(doc, term, weight, np.flatnonzero(common))
        rare = np.flatnonzero(~common[term] & (df[term] > 1))
        order = rare[np.argsort(term[rare], kind="stable")]
        self.doc, self.weight = doc[order], weight[order]
        held, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(order))
        # a document's own terms, as places in `held`
        self.by_doc, self.at = np.searchsorted(held, term[rare]), np.searchsorted(doc[rare], np.arange(n + 1))

    def _products(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, common: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, self.n), np.float32)
        for begin in range(0, len(common), _TERMS):
            own = common[begin : begin + _TERMS]
            column = np.full(VOCABULARY, -1)
            column[own] = np.arange(len(own))
            at = column[term]
            keep = at >= 0
            has, weighs = np.zeros((self.n, len(own)), np.float32), np.zeros((self.n, len(own)), np.float32)
            has[doc[keep], at[keep]] = 1
            weighs[doc[keep], at[keep]] = weight[keep]
            out += has @ weighs.T
        return out

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents, by all terms of the seed."""
        rows = self.by_doc[self.at[seed] : self.at[seed + 1]]
        size = self.first[rows + 1] - self.first[rows]
        where = np.repeat(self.first[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.matched[seed] + np.bincount(self.doc[where], self.weight[where], self.n)


def order_of(ids: list[np.ndarray], window: int = WINDOW, near: int = NEAR, corpus: Corpus | None = None) -> list[int]:
    """The order in which a shard's documents are laid one after another. near: how many are ranked at a time."""
    index, n = Index(ids, corpus), len(ids)
    free = np.ones(n, bool)
    out: list[int] = []
    filled, oldest = 0, 0
    while len(out) < n:
        while not free[oldest]:
            oldest += 1
        seed = oldest
        out.append(seed)
        free[seed] = False
        filled += len(ids[seed])
        score: np.ndarray | None = None
        ranked: list[int] = []
        while filled % window and len(out) < n:
            if score is None:
                score, ranked = index.scores(seed), []
            if not ranked:
                score[~free] = 0.0
                best = np.argpartition(score, -near)[-near:] if n > near else np.arange(n)
                best = best[np.lexsort((best, -score[best]))]
                ranked = [int(x) for x in best[::-1] if score[x] > 0]
            if ranked:
                chosen = ranked.pop()
            else:
                while not free[oldest]:
                    oldest += 1
                chosen = oldest
            out.append(chosen)
            free[chosen] = False
            before = filled // window
            filled += len(ids[chosen])
            if filled // window > before:  # its rest starts a window
                seed, score = chosen, None
    return out


def cuts(total: int, window: int = WINDOW) -> np.ndarray:
    """Where sequences begin in a shard's total tokens, and their end: whole windows, then falling powers of two."""
    out = list(range(0, total - total % window + 1, window))
    for bit in range(window.bit_length() - 1, -1, -1):
        if total % window & (1 << bit):
            out.append(out[-1] + (1 << bit))
    return np.array(out, np.int64)


def pack_shard(shard: int, doc_ids: list, ids: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None, near: int = NEAR) -> pa.RecordBatch:
    rows: list[tuple] = []
    edges = cuts(sum(map(len, ids)), window)
    at = 0
    for k in order_of(ids, window, near, corpus):
        n, start = len(ids[k]), 0
        sequence = int(np.searchsorted(edges, at, "right")) - 1
        while start < n:
            length = min(n - start, int(edges[sequence + 1]) - at)
            crc = zlib.crc32(ids[k][start : start + length].astype("<u4").tobytes())
            rows.append((doc_ids[k], start, length, crc, n, (shard << 32) + sequence, at - int(edges[sequence])))
            start, at, sequence = start + length, at + length, sequence + 1
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)


#: A row for each document, and one for each batch: documents by term, then the number of documents and that of tokens.
_CODED = "doc_id long, ids binary, terms binary"


def _tokens(path: str):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            # 16 bits hold an id of this vocabulary
            coded = []
            for text in batch.column("text").to_pylist():
                own = encode(text or "")
                own.append(END)
                coded.append(np.frombuffer(array("H", own), np.uint16))  # little-endian machines
            n = np.zeros(VOCABULARY + 2, np.int64)
            for _, ids in _some(coded):
                n[:-2] += np.bincount(occurrences(ids)[1], minlength=VOCABULARY)
            n[-2:] = len(coded), sum(map(len, coded))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in coded], pa.binary()), pa.nulls(len(coded), pa.binary())], ["doc_id", "ids", "terms"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([squeezed(n.tobytes())], pa.binary())], ["doc_id", "ids", "terms"])

    return run


def _some(ids: list[np.ndarray], tokens: int = 1 << 19) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Consecutive documents of about so many tokens, at most 2^16 of them, and the place of the first."""
    begin = total = 0
    for k, own in enumerate(ids):
        if k > begin and (total + len(own) > tokens or k - begin == 1 << 16):
            yield begin, ids[begin:k]
            begin, total = k, 0
        total += len(own)
    if begin < len(ids):
        yield begin, ids[begin:]


@tidied
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(VOCABULARY + 2, np.int64)
    for batch in batches:
        for blob in batch.column("terms"):
            n += np.frombuffer(unsqueezed(blob.as_py()), np.int64)
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["term", "n"])


def _keys(corpus):
    """The two terms that weigh most in each document, and its size, beside it."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), "<u2") for x in batch.column("ids")]
            found = [corpus.value.keys(own) for _, own in _some(ids)]
            a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([USUAL + len(x) for x in ids], pa.int64()), batch.column("doc_id"), batch.column("ids")], ["a", "b", "size", "doc_id", "ids"])

    return run


def _pack(window: int, corpus, near: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc_ids, ids = None, [], []
        for batch in batches:
            for shard, doc_id, own in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if shard != now and ids:
                    yield pack_shard(now, doc_ids, ids, window, corpus.value, near)
                    doc_ids, ids = [], []
                now = shard
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(own, "<u2"))
        if ids:
            yield pack_shard(now, doc_ids, ids, window, corpus.value, near)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_docs: int = SHARD_DOCS, near: int = NEAR) -> DataFrame:
    """A row for each piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    window: a power of two. tokenizer: a byte-level BPE file with less than 65,536 ids; byte_bpe_50k.json unless given.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path, capacity = tokenizer or tokenizer_path(BYTE_BPE), 2 * USUAL * shard_docs
    coded = stored(docs.select("doc_id", "text").mapInArrow(_tokens(path), _CODED), "pack-tokens")
    counted = dict(coded.where("terms IS NOT NULL").select("terms").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    df = np.array([counted.get(k, 0) for k in range(VOCABULARY)])
    corpus = spark.sparkContext.broadcast(Corpus(df, counted.get(VOCABULARY, 0), counted.get(VOCABULARY + 1, 0)))
    keyed = coded.where("terms IS NULL").select("doc_id", "ids").mapInArrow(_keys(corpus), "a long, b long, size long, doc_id long, ids binary")
    keyed = stored(keyed, "pack-keys")
    discard(coded)
    # both bounded: a row for each id of the vocabulary, and one for each shard at most
    sizes = keyed.groupBy("a", "b").agg(F.sum("size").alias("n"))
    terms = dict(sizes.groupBy("a").agg(F.sum("n")).collect())
    deal = Deal(terms, {(r.a, r.b): r.n for r in sizes.where(F.col("n") > capacity).collect()}, capacity)
    by_term = F.broadcast(spark.createDataFrame(deal.terms, "a long, base long, width long"))
    by_pair = spark.createDataFrame(deal.pairs, "a long, b long, pair_base long, pair_width long")
    row = F.xxhash64("doc_id", "ids", F.monotonically_increasing_id())
    dealt = keyed.withColumn("row", row).join(by_term, "a").join(F.broadcast(by_pair), ["a", "b"], "left")
    shard = F.coalesce(F.col("pair_base") + F.pmod("row", "pair_width"), F.col("base") + F.pmod(F.xxhash64("b"), F.col("width")))
    dealt = dealt.select(shard.alias("shard"), "doc_id", "ids").repartition(min(deal.shards, max(parts(spark), 1)), "shard").sortWithinPartitions("shard", "doc_id", "ids")
    return dealt.mapInArrow(_pack(window, corpus, near), SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"))
