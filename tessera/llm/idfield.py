"""A bit field of fixed size that ids are hashed to: rows whose id is surely not among them need not be shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tidying import tidied
from .words import mix

BITS = 25
_U = np.uint64


def _bit(ids: pa.Array) -> np.ndarray:
    return mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> _U(64 - BITS)


@tidied
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = _bit(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int64)), pa.array((_U(1) << (at & _U(63))).view(np.int64))], ["word", "bits"])


def id_field(ids: DataFrame) -> np.ndarray:
    """The field of one column of ids. At most 2**BITS / 64 rows come to the driver, and 2**BITS / 8 bytes are broadcast."""
    table = ids.mapInArrow(_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    field = np.zeros(1 << (BITS - 6), np.uint64)
    field[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return field


def maybe_in(field: np.ndarray, ids: pa.Array) -> np.ndarray:
    """False for ids that are surely not among those of the field."""
    at = _bit(ids)
    return (field[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)
