"""Driver-style use: load the entry module by path from another directory."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, "__spark_entry__.py")!r})
mod = importlib.util.module_from_spec(spec)
spec.loader.exec_module(mod)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
print("entry", mod.entry(spark).count())
print("ema", mod.queries()["ema_smooth"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_entry_loads_by_path_from_another_directory(tmp):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp, env=env, capture_output=True,
                         text=True, timeout=600)
    assert res.returncode == 0, res.stderr[-2000:]
    lines = dict(line.split() for line in res.stdout.splitlines() if line.startswith(("entry", "ema")))
    assert int(lines["entry"]) > 0 and int(lines["ema"]) == 1000


def test_entry_works_without_the_training_data_operators(tmp):
    import shutil
    shutil.copytree(ROOT, f"{tmp}/repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = ("import __spark_entry__ as e; q = e.queries(); "
            "print(len(q), any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))")
    res = subprocess.run([sys.executable, "-c", code], cwd=f"{tmp}/repo", capture_output=True, text=True, timeout=300,
                         env={**os.environ, "PYTHONPATH": ""})
    assert res.returncode == 0, res.stderr[-2000:]
    n, has_llm, known = res.stdout.split()
    assert int(n) > 70 and has_llm == "False" and known == "True"
