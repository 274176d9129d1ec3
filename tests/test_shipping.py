import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false") \\
    .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
for name in ("effects_rank", "scan_snapshots"):
    entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
print("ran")
"""


def test_queries_run_from_another_folder_and_leave_nothing_behind(tmp_path):
    """The workers get the package from the driver, not from their path."""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    shared = tmp_path / "shared"
    shared.mkdir()
    script = SCRIPT.format(root=ROOT, shared=str(shared))
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True,
        text=True, timeout=600,
    )
    assert "ran" in done.stdout, done.stderr[-3000:]
    # What is left is the folder that Spark itself makes for checkpoints.
    assert [p for folder in shared.iterdir() for p in folder.rglob("*")] == []
    assert not list(shared.glob("vacantia-*"))
