"""Queries where executors have no copy of the package: another working folder, no PYTHONPATH."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import os, sys
os.environ.pop("PYTHONPATH", None)
from pyspark.sql import SparkSession
# The workers start with the driver's path before the package is on it.
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {root!r})
from heliograph.llm import queries
for name in {names!r}:
    print(name, queries.QUERIES[name](spark, {sf!r}).count())
"""


def test_language_models_and_new_operators(sf, tmp_path):
    names = ["op2_perplexity_rules", "op9_trusted_quality", "op11_tokenizer_alignment", "op12_periodic_runs", "op13_minmax_near_dedup"]
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=ROOT, names=names, sf=sf))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH",)}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
