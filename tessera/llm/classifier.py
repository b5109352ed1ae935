"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of CHUNK bytes that overlap by CHUNK - HOP and cover all of it, the last one padded
with zero bytes. Bytes are embedded, filters of WIDTH bytes slide over each chunk by STRIDE bytes, and a filter's
largest response in a chunk is kept. The mean and the maximum of these over all chunks give one probability.

Training sees only a bounded sample of labelled rows, and of these rows whole texts, all chunks: of the rows whose
crc32(doc_id as text) mod 5 is not 0, those with the smallest hash of their id, `per_class` labelled 0 and 2 * `per_class`
labelled 1, until the texts of a label have `sample_bytes` bytes. They are sorted by id, so that reruns learn the same
weights. Scoring covers whole texts, one task's rows at a time; the weights are a few kilobytes. Chunks are worked through
in blocks, in training too, so that a very long text takes little memory.

Defined cases: a null text counts as an empty one, which is scored as one chunk of padding. Rows with the same id each
get a row. A null id is not held out. Without labels of both classes every score is 0.5. Labels other than 0 and 1 are
passed over; of contradicting labels of one id the smaller counts, and of several texts of one id the one with the smallest hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import documents, stored
from .tidying import tidied
from .words import binary, chunks

CHUNK, HOP, STRIDE, WIDTH, DIM, FILTERS = 512, 448, 4, 8, 8, 48
PER_CLASS, SAMPLE_BYTES = 1600, 1 << 24
CUT = 0.3
POSITIONS = CHUNK // STRIDE - 1
#: Chunks worked through at a time.
BLOCK = 512
Weights = dict[str, np.ndarray]


def cut_up(text: bytes) -> np.ndarray:
    """The chunks of a text, one in each row."""
    n = max(1, -(-(len(text) - CHUNK) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


def _responses(x: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Embedded blocks of chunks x, and every filter's response at every position."""
    blocks = w["embed"][x].reshape(len(x), CHUNK // STRIDE, STRIDE * DIM)
    return blocks, blocks[:, :-1] @ w["left"] + blocks[:, 1:] @ w["right"]


def _tops(x: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Every filter's largest response in each chunk, and where."""
    top, where = np.zeros((len(x), FILTERS), np.float32), np.zeros((len(x), FILTERS), np.int64)
    for at in range(0, len(x), BLOCK):
        _, response = _responses(x[at : at + BLOCK], w)
        own = response.argmax(1)
        where[at : at + BLOCK] = own
        top[at : at + BLOCK] = np.take_along_axis(response, own[:, None], 1)[:, 0]
    return top, where


def _gradients(x: np.ndarray, where: np.ndarray, dh: np.ndarray, w: Weights) -> Weights:
    """Of embedding and filters, from those of the largest responses."""
    g = {k: np.zeros_like(w[k]) for k in ("embed", "left", "right")}
    for begin in range(0, len(x), BLOCK):
        own, at, d = x[begin : begin + BLOCK], where[begin : begin + BLOCK], dh[begin : begin + BLOCK]
        row = np.arange(len(own))[:, None]
        blocks = w["embed"][own].reshape(len(own), CHUNK // STRIDE, STRIDE * DIM)
        for part, shift in (("left", 0), ("right", 1)):
            g[part] += np.einsum("nfs,nf->sf", blocks[row, at + shift], d)
            back = (d[:, :, None] * w[part].T).reshape(-1, DIM)
            symbol = own[row[:, :, None], (at + shift)[:, :, None] * STRIDE + np.arange(STRIDE)].ravel()
            for j in range(DIM):
                g["embed"][:, j] += np.bincount(symbol, back[:, j], 256)
    return g


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 1) -> Weights:
    """Adam on the log loss of whole texts."""
    rng = np.random.default_rng(seed)
    size = STRIDE * DIM
    w: Weights = {
        "embed": rng.normal(0, 0.5, (256, DIM)), "left": rng.normal(0, size**-0.5, (size, FILTERS)), "right": rng.normal(0, size**-0.5, (size, FILTERS)),
        "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "shift": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    mean, square, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), batch):
            own = order[begin : begin + batch]
            cut = [cut_up(texts[k]) for k in own]
            x, count = np.concatenate(cut), np.array([len(c) for c in cut])
            first = np.cumsum(count) - count
            doc = np.repeat(np.arange(len(own)), count)
            top, where = _tops(x, w)
            top += w["bias"]
            h = np.maximum(top, 0)
            most = np.maximum.reduceat(h, first)
            u = np.concatenate([np.add.reduceat(h, first) / count[:, None], most], 1)
            p = 1 / (1 + np.exp(-(u @ w["out"] + w["shift"])))
            d = ((p - labels[own]) / len(own)).astype(np.float32)
            g: Weights = {"out": u.T @ d + 1e-4 * w["out"], "shift": d.sum(keepdims=True)}
            du = d[:, None] * w["out"]
            dh = (du[:, :FILTERS] / count[:, None])[doc] + du[:, FILTERS:][doc] * (h == most[doc])
            dh = (dh * (top > 0)).astype(np.float32)
            g["bias"] = dh.sum(0)
            g |= _gradients(x, where, dh, w)
            step += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for k in w:
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.01 * (g[k] ** 2 - square[k])
                w[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def scores(texts: list[bytes], w: Weights) -> np.ndarray:
    out = np.zeros(len(texts))
    for begin, own in chunks(texts, 1 << 17):
        count = np.array([max(1, -(-(len(t) - CHUNK) // HOP) + 1) for t in own])
        length = (count - 1) * HOP + CHUNK
        start = np.cumsum(length) - length
        buf = np.frombuffer(b"".join(t + bytes(int(n) - len(t)) for t, n in zip(own, length, strict=True)), np.uint8)
        blocks = w["embed"][buf].reshape(len(buf) // STRIDE, STRIDE * DIM)
        response = blocks[:-1] @ w["left"]
        response += blocks[1:] @ w["right"]
        first = np.cumsum(count) - count
        low = (np.repeat(start, count) + (np.arange(int(count.sum())) - np.repeat(first, count)) * HOP) // STRIDE
        edges = np.stack([low, np.minimum(low + POSITIONS, len(response) - 1)], 1).ravel()
        top = np.maximum.reduceat(response, edges)[::2]
        # the very last chunk's last position, which reduceat's end leaves out
        top[-1] = np.maximum(top[-1], response[-1])
        h = np.maximum(top + w["bias"], 0)
        u = np.concatenate([np.add.reduceat(h, first) / count[:, None], np.maximum.reduceat(h, first)], 1)
        out[begin : begin + len(own)] = 1 / (1 + np.exp(-(u @ w["out"] + w["shift"]).astype(np.float64)))
    return out


def remainder(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Weights | None:
    """Weights learned from docs(doc_id, text) and labels(doc_id, quality)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder() != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    hashed = known.withColumn("u", F.xxhash64("doc_id"))
    sample = hashed.where("quality = 0").orderBy("u", "doc_id").limit(per_class).union(hashed.where("quality = 1").orderBy("u", "doc_id").limit(2 * per_class))
    sample = stored(sample.select("doc_id", F.col("quality").cast("int").alias("quality"), "u"), "label-sample")
    # at most 3 * per_class rows are broadcast, and half as many texts of 2 * sample_bytes in all come to the driver
    text = F.coalesce("text", F.lit("")).cast("binary")
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id")
    found = found.groupBy("doc_id", "quality", "u").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "quality", "u", "t.text")
    found = stored(found, "label-texts")
    upto = F.sum(F.octet_length("text")).over(W.partitionBy("quality").orderBy("u", "doc_id"))  # at most 2 * per_class rows
    chosen = found.select("doc_id", "quality", upto.alias("upto"), "u", "text").where(F.col("upto") <= sample_bytes)
    rows = chosen.select("doc_id", "quality", "text").toArrow().sort_by("doc_id").to_pydict()
    y = np.array(rows["quality"], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    return train(rows["text"], y)


def _score(w: Weights | None):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(len(batch), 0.5) if w is None else scores(binary(batch.column(batch.num_columns - 1)), w)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, w: Weights | None) -> DataFrame:
    """doc_id and score of each row of docs(doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_score(w), "doc_id long, score double")


def _accept(w: Weights | None, cut: float):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(len(batch), 0.5) if w is None else scores(binary(batch.column("text")), w)
            yield batch.filter(pa.array(out >= cut))

    return run


def accepted(docs: DataFrame, w: Weights | None, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, that score at least `cut`."""
    return docs.mapInArrow(_accept(w, cut), docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(remainder() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
