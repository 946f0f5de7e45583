"""The example script runs and shows batch reruns appending again and
incremental reruns appending nothing new."""

import os
import subprocess
import sys

from conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_run_job_example():
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "examples", "run_job.py"), SF_SMALL],
        capture_output=True,
        text=True,
        timeout=600,
    )
    assert out.returncode == 0, out.stderr[-3000:]
    printed = out.stdout
    assert "after one run: 1000" in printed and "after two runs: 2000" in printed
    assert "incremental, first start: 1500" in printed and "incremental, second start: 1500" in printed
