"""Tables: schemas, ingest, the versioned store, and connections to other stores of blocks."""

from .ingest import expand_maps, rows_to_frame
from .schema import ColumnDef, SortKey, TableSchema
from .store import Store, Table

__all__ = ["ColumnDef", "SortKey", "Store", "Table", "TableSchema", "expand_maps", "rows_to_frame"]
