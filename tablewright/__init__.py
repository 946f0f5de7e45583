"""tablewright: reproducible table jobs written as Spark DataFrame and SQL plans."""

__version__ = "0.1.0"

from tablewright.config import JobSpec, config_sha256, load_config, make_run_id
from tablewright.names import TableName, resolve_table
from tablewright.plans.job import run

__all__ = ["__version__", "TableName", "JobSpec", "config_sha256", "load_config", "make_run_id", "resolve_table", "run"]
