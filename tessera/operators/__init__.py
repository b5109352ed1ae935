"""Each relational operator as a function of a frame; Catalyst plans them."""

from .aggregation import aggregate
from .relational import distinct, filter_rows, limit, project, sample, schema_rows

__all__ = ["aggregate", "distinct", "filter_rows", "limit", "project", "sample", "schema_rows"]
