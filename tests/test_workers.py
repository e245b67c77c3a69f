"""Executors need no copy of the package: every engine query from another folder, the repository on the driver's path only."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
CODE = """
import os, sys
os.environ.pop("PYTHONPATH", None)
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as e
names = {names!r} or sorted(set(e.queries()) - set(e._CORPUS))
for name in names:
    try:
        e.queries()[name](s, {sf!r}).write.format("noop").mode("overwrite").save()
    except Exception as x:
        print("failed", name, str(x)[:500])
print("ran", len(names))
"""


def run_elsewhere(folder, names=()):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root, names=list(names), sf=SF)], capture_output=True, text=True, cwd=folder, env=env, timeout=1200)
    assert "ran" in out.stdout and "failed" not in out.stdout, out.stdout + out.stderr[-2000:]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_all_queries_elsewhere(tmp_path):
    run_elsewhere(tmp_path)
