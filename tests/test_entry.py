import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).parents[1]


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_works_without_the_training_data_subpackage(tmp_path):
    """A copy without the subpackage, the pipeline and their tests imports, and its other queries run."""
    for name in ("lodestrata", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    if (tmp_path / "lodestrata" / "llm").exists():
        (tmp_path / "lodestrata" / "llm").rename(tmp_path / "gone")
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
names = e.queries()
rows = [names[k](spark, "/root/testdata/sf0.001").count() for k in ("session_duration", "type_counts_pct", "histogram20")]
print(e.entry(spark).count(), all(rows), len(names), any(k.startswith("op") for k in names if k != "optimal_threshold") or "pipeline" in names)
"""
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    found = out.stdout.split()[-4:]
    assert found[1] == "True" and found[3] == "False" and int(found[0]) > 0 and int(found[2]) > 30, out.stderr[-3000:]


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("gone", ["llm", "library"])
def test_entry_without_what_training_data_need(tmp_path, pipeline, gone):
    """The base queries are there whether the subpackage is, the pipeline's file is, and a library that only they need is."""
    for name in ("lodestrata", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (REPO / "corpus_pipeline.py").exists() else [])):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    if gone == "llm" and (tmp_path / "lodestrata" / "llm").exists():
        (tmp_path / "lodestrata" / "llm").rename(tmp_path / "gone")
    block = "import sys; sys.modules['public_tokenizers'] = None; " if gone == "library" else ""
    code = f"{block}import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalogue.QUERIES), sorted(e.oracle_sql()) == sorted(e.catalogue.ORACLES))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "True"], out.stderr[-2000:]
