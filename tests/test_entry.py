"""The driver's entry points, with and without the optional folder."""

from __future__ import annotations

import pathlib
import shutil
import subprocess
import sys

REPO = pathlib.Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() and df.columns[0] == "doc_id"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_llm(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(n.startswith('op') or n == 'pipeline' for n in q if n != 'output_names' and n != 'output_rows'), list(q); assert set(e.oracle_sql()) <= set(q)"
    for leftover in (False, True):
        if leftover:  # a folder of compiled files only
            (at / "gridquarry/llm/__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-c", code], cwd=at, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(at)})


def test_without_libraries(tmp_path):
    """Where a library of the optional folder is missing, the other queries still work."""
    at = tmp_path / "repo"
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=at, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(at)})


def test_scratch_folder():
    """The folder of spark.checkpoint.dir, or one of the warehouse where it is unset; never a temporary one."""
    from types import SimpleNamespace

    from gridquarry.sources import scratch

    def session(**conf):
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf), conf=SimpleNamespace(get=lambda k, *d: conf.get(k, *d)))

    both = {"spark.checkpoint.dir": "hdfs://a/b/", "spark.sql.warehouse.dir": "hdfs://w"}
    assert scratch.shared_dir(session(**both)) == "hdfs://a/b"
    assert scratch.shared_dir(session(**{"spark.sql.warehouse.dir": "hdfs://w/"})) == "hdfs://w/_scratch"
