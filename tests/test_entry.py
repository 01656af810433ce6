"""The driver's contract, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "clausemill"):
        subprocess.run(["cp", "-r", ROOT / name, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "clausemill/llm"], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not [q for q in e.queries() if q.startswith('op1_')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
