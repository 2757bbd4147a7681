import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["u", "v", "weight"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_subpackage(tmp_path):
    """A copy without the subpackage and the pipeline still imports and lists the other queries."""
    import shutil

    skip = shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'linkage_edges' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "copy")})
