"""The driver's entry: with and without the training-data subpackage, and on a plain Spark without presets."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _python(code, cwd, **env):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | env
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=clean, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_entry_without_the_llm_folders(tmp_path):
    """Only the folders gone, or the pipeline as well: all other queries stay."""
    code = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q; print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q))"
    kept = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.md", "*.json")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=kept)
    first = _python(code, tmp_path / "copy").split()
    assert int(first[0]) > 100 and first[1:] == ["False", "False"]
    os.remove(tmp_path / "copy" / "corpus_pipeline.py")
    assert _python(code, tmp_path / "copy").split() == first


def test_staging_on_a_plain_spark(tmp_path):
    """No spark.checkpoint.dir is set anywhere: a local session gets one folder, and discarded tables leave it."""
    code = """
import os
from gaugemill.session import discard, local_session, shared_dir, stage
spark = local_session(cores=1, partitions=1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = stage(spark.range(3), "a")
second = stage(first.selectExpr("id + 1 AS id"), "b")
discard(first, first.select("id"))
assert sorted(r.id for r in second.collect()) == [1, 2, 3]
assert [n.split("-")[0] for n in os.listdir(shared_dir(spark) + "/gaugemill")] == ["b"]
"""
    _python(code, ROOT, SPARK_CONF_DIR=str(tmp_path))
