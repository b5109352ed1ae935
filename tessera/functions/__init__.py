"""Column functions whose meaning differs from Spark's own."""

from .numeric import divide, integer_average, unique_value
from .temporal import floor_bucket, time_bucket

__all__ = ["divide", "floor_bucket", "integer_average", "time_bucket", "unique_value"]
