"""Where rows come from: generated ranges, Parquet paths, catalog tables."""

from tablewright.sources.files import TABLES, load_table, read_files
from tablewright.sources.generate import range_source

__all__ = ["TABLES", "load_table", "range_source", "read_files"]
