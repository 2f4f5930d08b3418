import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
_SKIPPED = shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache")


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_rest_works_without_the_corpus_operators(tmp_path, also):
    """The tree without the two folders, and without the pipeline's file as well: imports, queries, and the other tests."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=_SKIPPED)
    for folder in ("provenant/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    for file in also:
        (copy / file).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'join_left' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    rest = ["tests/test_lattices.py", "tests/test_sources.py", "tests/test_walker.py"] if also else ["--collect-only", "tests"]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", *rest], cwd=copy, check=True, timeout=600)


def test_library_does_not_import_the_corpus_operators():
    for path in (REPO / "provenant").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path
