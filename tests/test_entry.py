"""The entry module with and without the corpus part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') for n in q), 'pipeline' in q, set(o) <= set(q))"


def entry_of(folder):
    return subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(folder)}).stdout.split()


def test_entry_without_the_corpus_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    os.remove(copy / "corpus_pipeline.py") if (copy / "corpus_pipeline.py").exists() else None
    bare = entry_of(copy)
    assert int(bare[0]) >= 50 and bare[2:] == ["False", "False", "True"]
    # a folder with leftovers alone is no subpackage
    (copy / "strandloom" / "llm" / "__pycache__").mkdir(parents=True)
    assert entry_of(copy) == bare
    subprocess.run([sys.executable, "-c", "import strandloom.cli, bench"], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


def test_entry_registers_sql_for_its_own_queries_only():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
