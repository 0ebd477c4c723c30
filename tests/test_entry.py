import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))
NAMES = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100; print(sorted(n for n in q if n.startswith('op') or n == 'pipeline'))"


def names(folder, **env):
    return subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | env).stdout


def copied(tmp_path, *without):
    skip = shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *without)
    return shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)


def test_registry_needs_no_session_and_no_corpus_subpackage(tmp_path):
    assert "op1_" in names(ROOT) if os.path.isdir(f"{ROOT}/tidemark/llm") else True
    assert names(copied(tmp_path, "llm", "corpus_pipeline.py")).strip() == "[]"


def test_pipeline_alone_can_go(tmp_path):
    if os.path.isdir(f"{ROOT}/tidemark/llm"):
        copy = copied(tmp_path, "corpus_pipeline.py")
        assert "'pipeline'" not in names(copy) and "'pipeline'" not in names(copy, PYTHONPATH=ROOT)


def test_only_what_lies_beside_the_entry_counts(tmp_path):
    """A copy without the corpus parts registers none, even where the path of another copy holds them."""
    assert names(copied(tmp_path, "llm", "corpus_pipeline.py"), PYTHONPATH=ROOT).strip() == "[]"


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["endpoint", "avg_ms"] and out.count() == 5


def test_nothing_else_imports_the_corpus_subpackage():
    for folder, _, files in os.walk(f"{ROOT}/tidemark"):
        if os.path.basename(folder) == "llm" or "__pycache__" in folder:
            continue
        for name in files:
            if name.endswith(".py"):
                with open(f"{folder}/{name}", encoding="utf-8") as f:
                    assert "tidemark.llm" not in f.read()
