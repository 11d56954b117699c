"""Functions that run in Python tasks must not need the package on the workers."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from meterlab.operators.stationary import mstl_components
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.range(60).selectExpr("0 AS k", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id) AS ts", "id % 24 / 1.0D AS v")
assert mstl_components(df, ["k"], "ts", "v", (24,)).count() == 60
print("shipped")
"""


def test_workers_need_no_installed_copy(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", CODE, root], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "shipped" in done.stdout, done.stderr[-2000:]
