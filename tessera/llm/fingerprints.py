"""Document fingerprints as invertible Bloom lookup tables over paragraph digests.

A text's paragraphs are its lines, cut further after words whose hash ends in four zero bits, so that an edit changes the
pieces around it only. The k-th copy of a piece has a digest of its own. A fingerprint is a table of cells: each digest is
added to one cell of each of three parts, a cell keeping the count, and the exclusive or of digests and of their check
hashes. Two tables of one size subtract cell by cell: common digests vanish, and peeling cells that hold a single digest
recovers the digests that differ. difference() does so with two fingerprints as the query returns them, which hold 3 * CELLS
cells each and so give up to about 15 differing digests; where that fails, differences() of the texts builds both tables
twice as large, until it succeeds.

Likeness of two texts is the number of common digests over that of all, known from both sizes and the recovered
differences; two texts without words are alike (1).

For the edited texts, the next document in descending order of ids lies in the next row: rows are dealt by ranges of ids
and, of equal ids, of text hashes, and sorted, one shuffle of the texts. Rows that are equal in both are spread over ranges by
a salt. Only a partition's last row needs the first row of the next; these rows, two for each partition, are joined after, by
the number of the partition. Defined cases: a null text counts as an empty one; null ids come last; rows with the same id are ordered
by a hash of their text; a table with one row has itself as next document.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, parts, small_batches, stored
from .tidying import tidied
from .words import _PLACE, Words, chunks, mix

_U = np.uint64
#: Cells of each of the three parts of a stored fingerprint.
CELLS = 8
_CELL = np.dtype([("count", "<i2"), ("digest", "<u8"), ("check", "<u2")])


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of all texts together, and which text each is of."""
    found = Words(texts)
    n = len(found.hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(found.first))
    lines = np.cumsum(found.buf == 10)[found.starts]
    ends = (found.hashes & _U(15)) == 0
    begins = np.append(True, ends[:-1] | (text[1:] != text[:-1]) | (lines[1:] != lines[:-1]))
    first = np.flatnonzero(begins)
    offset = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    piece = mix(np.add.reduceat(found.hashes * _PLACE[offset % 63] + offset.astype(np.uint64), first))
    text = text[first]
    order = np.lexsort((piece, text))
    p, t = piece[order], text[order]
    new = np.append(True, (p[1:] != p[:-1]) | (t[1:] != t[:-1]))
    start = np.flatnonzero(new)
    copy = np.arange(len(p)) - np.repeat(start, np.diff(np.append(start, len(p))))
    return mix(p + copy.astype(np.uint64) * _PLACE[0]), t


class Tables:
    """The tables of many texts side by side: cells[k] is that of text k, of three parts of `cells` cells."""

    def __init__(self, keys: np.ndarray, text: np.ndarray, texts: int, cells: int, bits: int = 32):
        self.texts, self.cells, self.mask = texts, cells, _U((1 << bits) - 1)
        size = texts * 3 * cells
        self.count, self.digest, self.check = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.add(keys, text, np.ones(len(keys), np.int64))

    def places(self, keys: np.ndarray, text: np.ndarray) -> np.ndarray:
        return np.concatenate([text * 3 * self.cells + part * self.cells + (mix(keys + _PLACE[10 + part]) % _U(self.cells)).astype(np.int64) for part in range(3)])

    def add(self, keys: np.ndarray, text: np.ndarray, sign: np.ndarray) -> None:
        at = self.places(keys, text)
        np.add.at(self.count, at, np.tile(sign, 3))
        np.bitwise_xor.at(self.digest, at, np.tile(keys, 3))
        np.bitwise_xor.at(self.check, at, np.tile(checks(keys) & self.mask, 3))

    def minus(self, other: "Tables") -> "Tables":
        out = Tables(np.zeros(0, np.uint64), np.zeros(0, np.int64), self.texts, self.cells)
        out.mask = self.mask
        out.count, out.digest, out.check = self.count - other.count, self.digest ^ other.digest, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests only in the first (sign 1) or only in the second (-1): keys, texts and signs; and which texts gave all."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = np.arange(len(self.count))
        while True:
            at = at[np.abs(self.count[at]) == 1]
            digest, part = self.digest[at], at % (3 * self.cells) // self.cells
            home = (mix(digest + _PLACE[10 + part]) % _U(self.cells)).astype(np.int64)
            pure = at[(self.check[at] == checks(digest) & self.mask) & (home == at % self.cells)]
            if not len(pure):
                break
            text, keys, sign = pure // (3 * self.cells), self.digest[pure], self.count[pure]
            order = np.lexsort((keys, text))
            text, keys, sign = text[order], keys[order], sign[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]))
            text, keys, sign = text[new], keys[new], sign[new]
            found.append((keys, text, sign))
            self.add(keys, text, -sign)
            at = np.unique(self.places(keys, text))
        left = (self.count != 0) | (self.digest != 0) | (self.check != 0)
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys, text, sign = (np.concatenate(x) for x in zip(none, *found, strict=True))
        return keys, text, sign, ~left.reshape(self.texts, -1).any(axis=1)

    @staticmethod
    def parsed(fingerprint: bytes) -> tuple[int, "Tables"]:
        """The number of digests and the table of what raw() has written."""
        cells = np.frombuffer(fingerprint[4:], _CELL)
        out = Tables(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, len(cells) // 3, 16)
        out.count, out.digest, out.check = cells["count"].astype(np.int64), cells["digest"].copy(), cells["check"].astype(np.uint64)
        return int.from_bytes(fingerprint[:4], "little"), out

    def raw(self, sizes: np.ndarray) -> list[bytes]:
        """Each text's number of digests (4 bytes) and cells, counts and checks modulo 65,536."""
        out = np.zeros(len(self.count), _CELL)
        out["count"], out["digest"], out["check"] = self.count.astype(np.int16), self.digest, self.check.astype(np.uint16)
        raw, step = out.tobytes(), 3 * self.cells * _CELL.itemsize
        return [int(n).to_bytes(4, "little") + raw[k * step : k * step + step] for k, n in enumerate(sizes)]


def checks(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ _PLACE[20]) >> _U(32)


Pieces = tuple[np.ndarray, np.ndarray]


def difference(a: str, b: str) -> tuple[set[int], set[int]] | None:
    """Digests that only the one text has and that only the other has, from two fingerprints in base64; None where they differ in too many."""
    left, right = (Tables.parsed(base64.b64decode(x))[1] for x in (a, b))
    table = left.minus(right)
    table.count = (table.count + (1 << 15)) % (1 << 16) - (1 << 15)
    keys, _, sign, done = table.peel()
    return (set(keys[sign > 0].tolist()), set(keys[sign < 0].tolist())) if done[0] else None


def differences(a: str, b: str, cells: int = CELLS) -> tuple[set[int], set[int]]:
    """As difference(), of two texts: by tables twice as large after each failure."""
    found = digests([a.encode()]), digests([b.encode()])
    while True:
        left, right = (Tables(*x, 1, cells) for x in found)
        keys, _, sign, done = left.minus(right).peel()
        if done[0]:
            return set(keys[sign > 0].tolist()), set(keys[sign < 0].tolist())
        cells *= 2


def _only(found: Pieces, wanted: np.ndarray) -> Pieces:
    """The digests of the wanted texts, these numbered anew."""
    new = np.full(len(wanted), -1, np.int64)
    new[wanted] = np.arange(int(wanted.sum()))
    keep = wanted[found[1]]
    return found[0][keep], new[found[1][keep]]


def likeness(a: Pieces, b: Pieces, texts: int, cells: int = CELLS) -> np.ndarray:
    """Likeness of text k of a and text k of b, by tables of `cells` cells in each part, then twice as many, and so on."""
    out = np.zeros(texts)
    open_ = np.ones(texts, bool)
    sizes = np.bincount(a[1], minlength=texts) + np.bincount(b[1], minlength=texts)
    while open_.any():
        n = int(open_.sum())
        left, right = (Tables(*_only(x, open_), n, cells) for x in (a, b))
        _, text, _, done = left.minus(right).peel()
        which = np.flatnonzero(open_)[done]
        differ = np.bincount(text, minlength=n)[done]
        common = (sizes[which] - differ) / 2
        out[which] = np.where(common + differ > 0, common / np.maximum(common + differ, 1), 1.0)
        open_[which] = False
        cells *= 2
    return out


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_rows(ids: list, texts: list[str], following: list[str]) -> Iterator[pa.RecordBatch]:
    coded = [x.encode() for x in texts]
    for begin, own in chunks(coded, 1 << 19):
        span = slice(begin, begin + len(own))
        new = [edited(x, y).encode() for x, y in zip(texts[span], following[span], strict=True)]
        n = len(own)
        a, b, c = digests(own), digests(new), digests([x.encode() for x in following[span]])
        size_a, size_b = np.bincount(a[1], minlength=n), np.bincount(b[1], minlength=n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[span], pa.int64()),
                pa.array([len(x) for x in texts[span]], pa.int64()),
                pa.array([hashlib.sha256(x).digest() for x in new], pa.binary()),
                pa.array(Tables(*a, n, CELLS).raw(size_a), pa.binary()),
                pa.array(Tables(*b, n, CELLS).raw(size_b), pa.binary()),
                pa.array(likeness(a, b, n)),
                pa.array(likeness(a, c, n)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


_SCHEMA = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


@tidied
def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in order, each with the next. The first and the last row's texts come as rows of their own."""
    names = [*(x.split()[0] for x in _SCHEMA.split(", ")), "head", "tail"]

    def out(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(len(batch), pa.string()) for _ in range(2))], names)

    ids, texts, head = [], [], None
    for batch in batches:
        ids += batch.column("doc_id").to_pylist()
        texts += [x or "" for x in batch.column("text").to_pylist()]
        if texts and head is None:
            head = texts[0]
        if len(texts) > 1:
            for rows in fingerprint_rows(ids[:-1], texts[:-1], texts[1:]):
                yield out(rows)
            ids, texts = ids[-1:], texts[-1:]
    if texts:
        empty = [pa.nulls(1, x) for x in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *empty, pa.array([head]), pa.array(texts)], names)


@tidied
def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from fingerprint_rows(*(batch.column(c).to_pylist() for c in ("doc_id", "tail", "following")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (in base64), near_edited and near_next of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    by = [F.desc_nulls_last("doc_id"), F.asc("hash"), F.asc("salt")]
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    rows = rows.repartitionByRange(parts(spark), *by).sortWithinPartitions(*by).select("doc_id", "text")
    done = rows.mapInArrow(_sorted_rows, _SCHEMA + ", head string, tail string").withColumn("part", F.spark_partition_id())
    done = stored(done, "fingerprints")
    # two texts for each partition, and a number for each on the driver
    edges = done.where("tail IS NOT NULL").select("doc_id", "part", "head", "tail")
    order = sorted(r.part for r in edges.select("part").collect())
    follows = spark.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "part int, next int")
    edges = edges.join(F.broadcast(follows), "part").drop("head").join(edges.select(F.col("part").alias("next"), F.col("head").alias("following")), "next")
    edges = edges.select("doc_id", "tail", "following")
    out = done.where("tail IS NULL").drop("head", "tail", "part").unionByName(edges.mapInArrow(_edges, _SCHEMA))
    coded = {c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")}
    return out.withColumns(coded | {"edited_sha256": F.lower(F.hex("edited_sha256"))})


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
