"""The driver contract works from any working directory (workers import the package)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4") \\
    .config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
assert E.entry(spark).count() == 60
# a query whose body runs in Python workers (applyInPandas)
assert E.queries()["g10_bt_expected_wins"](spark, "/root/testdata/sf0.001").count() > 0
print("OK")
"""


def test_entry_from_another_directory(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "OK" in out.stdout, out.stderr[-2000:]
