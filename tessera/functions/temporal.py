from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_bucket(value: Column, width: int) -> Column:
    """The largest multiple of width that value reaches, below zero too."""
    return value - F.pmod(value, F.lit(width).cast("long"))


def time_bucket(time: Column, width_micros: int) -> Column:
    """floor_bucket of a timestamp in microseconds since 1970."""
    return floor_bucket(F.unix_micros(time.cast("timestamp")), width_micros)
