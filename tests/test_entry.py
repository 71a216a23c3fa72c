"""The driver's contract, with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q)"


def test_entry_runs(spark):
    sys.path.insert(0, str(REPO))
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["node_id", "score", "label", "roc_auc", "average_precision"] and df.count() == 500


def test_the_rest_works_without_the_subpackage(tmp_path):
    bare = tmp_path / "repo"
    shutil.copytree(REPO, bare, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", LIST], cwd=bare, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"}).stdout.split()
    assert int(said[-2]) > 90 and said[-1] == "False"


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "metricgraph").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "metricgraph.llm" not in path.read_text(), path
