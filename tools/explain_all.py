"""Write PLANS.md: the executed physical plan of every registered query.

Usage: python tools/explain_all.py [sf_dir]   (default /root/testdata/sf0.01)
Each query is run first, so adaptive plans show their final form with the
runtime statistics of each shuffle stage. For queries that write, the plan
shown is that of the result read back. (A diagnostic tool: it collects the
small sf0.01 results to make the explained DataFrame run.)
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tablewright.plans.job import build_frame  # noqa: E402
from tablewright.plans.registry import QUERIES, documents_job_config  # noqa: E402
from tablewright.session import local_session  # noqa: E402

DETAILS = ("ReadSchema", "PushedFilters", "PartitionFilters")


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summary(text: str) -> list[str]:
    lines = text.splitlines()
    tree = []
    for line in lines[1:]:
        if not line.strip() or "== Initial Plan ==" in line:
            break
        tree.append(line)
    details = [line for line in lines if line.startswith(DETAILS) and line.split(":", 1)[1].strip() not in ("", "[]")]
    return tree + [""] + details


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    out = [
        "# PLANS",
        "",
        f"Executed physical plans of the registered queries on `{sf_dir}`, made by",
        "`tools/explain_all.py` (`explain(\"formatted\")` after running the query: the final adaptive",
        "plan with each shuffle stage's runtime statistics, then the scan details). `*` marks",
        "operators inside whole-stage codegen.",
        "",
    ]
    plans = dict(QUERIES)
    # The job's own work is the frame it appends, not the table read back.
    plans["job_documents (the frame it appends)"] = lambda s, d: build_frame(s, documents_job_config(s, d))
    for name, fn in plans.items():
        df = fn(spark, sf_dir)
        df.collect()
        out += [f"## {name}", "", "```", *summary(formatted(df)), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
