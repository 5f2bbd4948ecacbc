import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_training_data_folders(tmp_path):
    """Also where the pipeline's file is left behind."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for pipeline in (True, False):
        if not pipeline and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        code = "import __spark_entry__ as e; names = [*e.queries()]; print(len(names), any(n.startswith('op') or n == 'pipeline' for n in names), set(e.oracle_sql()) <= set(names))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        assert out.returncode == 0, out.stderr
        count, optional, known = out.stdout.split()
        assert int(count) > 40 and (optional, known) == ("False", "True")
