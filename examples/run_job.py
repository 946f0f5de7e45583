"""Drive the table job from any session: here a local one, on the test data.

    python examples/run_job.py [sf_dir]

The job is a function of (SparkSession, dict), so the same call works from a
cluster's batch entry point, a notebook or an interactive session.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewright import run  # noqa: E402
from tablewright.names import DATABASE_CONF  # noqa: E402
from tablewright.plans import DEFAULT_CONFIG  # noqa: E402
from tablewright.session import fresh_path, fresh_table_suffix, local_session  # noqa: E402
from tablewright.streaming import run_incremental  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session()
    spark.conf.set(DATABASE_CONF, "default")

    # The original job: ids 0..999 and their doubles; a second run appends them again.
    cfg = {**DEFAULT_CONFIG, "table": {"name": f"example_{fresh_table_suffix()}", "location": fresh_path(spark, "tables")}}
    print("after one run:", run(spark, cfg).count())
    print("after two runs:", run(spark, cfg).count())

    # The incremental form: new files are appended once, however often it starts.
    inc = {
        "table": {"name": f"orders_{fresh_table_suffix()}", "location": fresh_path(spark, "tables")},
        "source": {"path": f"{sf_dir}/orders.parquet*"},
        "processing": {"derive": {"double": "o_orderkey * 2"}},
        "streaming": {"checkpoint": fresh_path(spark, "streams")},
    }
    print("incremental, first start:", run_incremental(spark, inc).count())
    table = run_incremental(spark, inc)
    print("incremental, second start:", table.count())
    table.show(3)
    spark.stop()


if __name__ == "__main__":
    main()
