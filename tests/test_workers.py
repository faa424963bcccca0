"""The package also works where Python workers cannot import it."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
queries, oracles = entry.queries(), entry.oracle_sql()  # before any session exists
from sherdloom.session import local_session
spark = local_session(4, shuffle_partitions=2)
for name in ("d01_removal_plan", "m30_local_normals", "s03_mesh_file_scan", "a13_part_accuracy_variable_n"):
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("workers ok")
"""


def test_workers_need_no_installed_package(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=240
    )
    assert "workers ok" in done.stdout, done.stderr[-2000:]
