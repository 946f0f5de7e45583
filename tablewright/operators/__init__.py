"""DataFrame -> DataFrame operators."""

from tablewright.operators.compare import compare, write_digested
from tablewright.operators.dedup import deduplicate
from tablewright.operators.derive import derive, double_id
from tablewright.operators.filter import count_rows, filter_count, filter_rows
from tablewright.operators.latest import latest_per_key
from tablewright.operators.lineage import stamp_lineage
from tablewright.operators.manifest import manifest, stamp_manifest
from tablewright.operators.partitions import cap_partitions, rebalance, sized
from tablewright.operators.pick import pick_per_key
from tablewright.operators.schema import misfits, schema_check
from tablewright.operators.sketches import estimates, manifest_sketches, merge_sketches

__all__ = [
    "cap_partitions",
    "compare",
    "count_rows",
    "deduplicate",
    "derive",
    "double_id",
    "estimates",
    "filter_count",
    "filter_rows",
    "latest_per_key",
    "manifest",
    "manifest_sketches",
    "merge_sketches",
    "misfits",
    "pick_per_key",
    "rebalance",
    "schema_check",
    "sized",
    "stamp_lineage",
    "stamp_manifest",
    "write_digested",
]
