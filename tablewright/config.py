"""Job parameters: one typed description, built from the config dict before Spark is used."""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
import re
import tomllib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tablewright.names import is_name

if TYPE_CHECKING:
    from pyspark.sql import SparkSession


class ConfigError(SystemExit):
    """A config that cannot be run; names the key and what it should be."""


# What a value may be: a test, and how an error says it.
Kind = tuple[Callable[[Any], bool], str]


def _texts(v: Any) -> bool:
    return isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v)


def _pairs(v: Any) -> bool:
    return isinstance(v, (list, tuple)) and all(isinstance(x, (list, tuple)) and len(x) == 2 and all(isinstance(y, str) for y in x) for x in v)


NAME: Kind = (is_name, "a name of letters, digits and underscores")
PATH: Kind = (lambda v: isinstance(v, str) and v != "", "a path")
TEXT: Kind = (lambda v: isinstance(v, str) and v != "", "a text")
FORMAT: Kind = (lambda v: isinstance(v, str) and v.replace("_", "").isalnum(), "a format name such as parquet")
COUNT: Kind = (lambda v: isinstance(v, int) and not isinstance(v, bool) and v > 0, "a positive integer")
# Fixed value: the form of a published run's id (see make_run_id).
RUN_ID = re.compile(r"\d{8}_\d{6}-[0-9a-f]{8}")
RUN_FORM = "a published run's id, which is like 20260101_000000-1a2b3c4d"
INTERVAL: Kind = (lambda v: isinstance(v, str) and re.fullmatch(r"[1-9]\d* (second|minute|hour|day|week)s?", v) is not None, "a time span such as 7 days")
SWITCH: Kind = (lambda v: isinstance(v, bool), "true or false")
COLUMNS: Kind = (_texts, "a list of column names")
PREDICATE: Kind = (lambda v: isinstance(v, (str, Column)), "a SQL predicate")
EXPRESSIONS: Kind = (lambda v: isinstance(v, Mapping) and all(isinstance(k, str) and isinstance(e, (str, Column)) for k, e in v.items()), "a table of name = expression")
OPTIONS: Kind = (lambda v: isinstance(v, Mapping) and all(isinstance(k, str) for k in v), "a table of reader options")
IDS: Kind = (lambda v: isinstance(v, Mapping) and isinstance(v.get("end"), int), "a table with an end, and a start, step and partitions if wanted")
SCHEMA: Kind = (lambda v: isinstance(v, (str, StructType, DataType)), "a schema")
EXPECTED: Kind = (_pairs, "a list of (column, type) pairs")


def setting(key: str, kind: Kind, default: Any = None) -> Any:
    """A field of ``JobSpec`` that is read from ``section.name``."""
    told = {"key": key, "kind": kind}
    return field(default_factory=default, metadata=told) if callable(default) else field(default=default, metadata=told)


@dataclass(frozen=True)
class JobSpec:
    """Everything a job can be told. A key that is absent or null has its default;
    keys that are not listed here are the caller's own."""

    table: str | None = setting("table.name", NAME)
    catalog: str | None = setting("table.catalog", NAME)
    database: str | None = setting("table.database", NAME)
    table_format: str = setting("table.format", FORMAT, "parquet")
    location: str | None = setting("table.location", PATH)
    evolve: bool = setting("table.evolve", SWITCH, False)
    output_path: str | None = setting("output.path", PATH)
    output_format: str = setting("output.format", FORMAT, "parquet")
    max_file_bytes: int | None = setting("output.max_file_bytes", COUNT)
    input_path: str | None = setting("source.path", PATH)
    input_format: str = setting("source.format", FORMAT, "parquet")
    input_options: Mapping[str, Any] = setting("source.options", OPTIONS, dict)
    input_schema: Any = setting("source.schema", SCHEMA)
    input_glob: str | None = setting("source.glob", TEXT)
    ids: Mapping[str, int] | None = setting("source.range", IDS)
    expected: Any = setting("schema.expected", EXPECTED)
    quarantine: str | None = setting("schema.quarantine", NAME)
    predicate: Any = setting("processing.filter", PREDICATE)
    dedup: bool = setting("processing.enable_deduplication", SWITCH, False)
    dedup_keys: Any = setting("processing.dedup_keys", COLUMNS)
    dedup_order: Any = setting("processing.dedup_order", COLUMNS)
    derived: Mapping[str, Any] = setting("processing.derive", EXPRESSIONS, dict)
    max_partitions: int | None = setting("processing.max_partitions", COUNT)
    lineage: bool = setting("run.lineage", SWITCH, False)
    runs_root: str | None = setting("run.root", PATH)
    run_id: str | None = setting("run.id", TEXT)
    job: str = setting("run.job", TEXT, "job")
    note: str | None = setting("run.note", TEXT)
    environment: str | None = setting("run.environment", TEXT)
    checkpoint: str | None = setting("streaming.checkpoint", PATH)
    max_files: int | None = setting("streaming.max_files_per_trigger", COUNT)
    horizon: str | None = setting("streaming.horizon", INTERVAL)

    @classmethod
    def of(cls, cfg: Mapping[str, Any]) -> "JobSpec":
        """The description of a config; raises ``ConfigError`` for what could not run."""
        told: dict[str, dict[str, Any]] = {}
        for name in {f.metadata["key"].split(".")[0] for f in fields(cls)}:
            part = cfg.get(name) or {}
            if not isinstance(part, Mapping):
                raise ConfigError(f"invalid config: {name} must be a table")
            told[name] = {k: v for k, v in part.items() if v is not None}
        values = {}
        for f in fields(cls):
            section, name = f.metadata["key"].split(".")
            fits, says = f.metadata["kind"]
            if name in told[section]:
                if not fits(told[section][name]):
                    raise ConfigError(f"invalid config: {section}.{name} must be {says}")
                values[f.name] = told[section][name]
        spec = cls(**values)
        for a, b in (("table.name", "output.path"), ("source.path", "source.range")):
            given = [k for k in (a, b) if k.split(".")[1] in told[k.split(".")[0]]]
            if len(given) != 1:
                raise ConfigError(f"invalid config: needs exactly one of {a}, {b}")
        if spec.max_partitions and spec.max_file_bytes:
            raise ConfigError("invalid config: needs at most one of processing.max_partitions, output.max_file_bytes")
        if spec.runs_root and spec.run_id and not RUN_ID.fullmatch(spec.run_id):
            raise ConfigError(f"invalid config: run.id must be {RUN_FORM}")
        return spec


def reader_options(options: Mapping[str, Any] | None) -> dict[str, str]:
    """Option values as Spark reads them: booleans as true/false, the rest as text."""
    return {k: (str(v).lower() if isinstance(v, bool) else str(v)) for k, v in (options or {}).items()}


def config_sha256(cfg: Mapping[str, Any]) -> str:
    """SHA-256 of the canonical JSON text: key order and whitespace do not matter."""
    text = json.dumps(cfg, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


# The release id format. UTC time as %Y%m%d_%H%M%S, a dash,
# then the first 8 hex digits of a SHA-256 (here of the config), e.g.
# "20260101_000000-1a2b3c4d". It keeps a non-digit, so a partition folder
# named after it reads back as a string.
RUN_TIME_FORMAT = "%Y%m%d_%H%M%S"


def make_run_id(cfg: Mapping[str, Any], at: _dt.datetime | str | None = None) -> str:
    if at is None:
        at = _dt.datetime.now(_dt.timezone.utc)
    stamp = at if isinstance(at, str) else at.strftime(RUN_TIME_FORMAT)
    return f"{stamp}-{config_sha256(cfg)[:8]}"


#: A config file is a few hundred bytes; a larger file is not one.
CONFIG_BYTES = 1 << 20


def load_config(spark: "SparkSession", path: str) -> tuple[dict[str, Any], dict[str, str]]:
    """Parse a TOML config file read through Spark's file systems (any path the
    cluster can read, object stores included); return it with audit metadata.

    ``meta["sha256"]`` is the SHA-256 of the file's bytes, ``meta["path"]``
    where it came from, ``meta["modified_at"]`` when it was last changed (UTC). The path must be one file of at most ``CONFIG_BYTES``,
    which is checked before its content is read; malformed TOML raises
    ``tomllib.TOMLDecodeError``.
    """
    files = spark.read.format("binaryFile").load(path)
    changed = F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    found = files.select("path", "length", changed.alias("modified_at")).limit(2).collect()
    if len(found) != 1:
        raise FileNotFoundError(f"expected one config file at {path!r}, found {'more' if found else 'none'}")
    if found[0]["length"] > CONFIG_BYTES:
        raise ValueError(f"{path!r} has {found[0]['length']} bytes, more than a config file")
    body = bytes(files.select("content").first()["content"])
    meta = {"sha256": hashlib.sha256(body).hexdigest(), "path": found[0]["path"], "modified_at": found[0]["modified_at"]}
    return tomllib.loads(body.decode("utf-8")), meta
