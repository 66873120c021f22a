"""Every query with SQL equals it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from headway.oracles import oracle_sql
from headway.queries import QUERIES


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], oracle_sql()[name])


def test_all_but_models_have_sql():
    assert set(QUERIES) - set(oracle_sql()) == {"model_metrics", "feature_importance", "score_batch", "eta_from_model", "segment_summary"}


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_module_without_the_subpackage(tmp_path):
    root = Path(__file__).parents[1]
    away = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "copy", ignore=away)
    code = "import __spark_entry__ as e; assert e.llm is None; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(oracle_sql()))]
    # A subpackage that is there but broken is not taken for one that was taken away.
    (tmp_path / "copy/headway/llm").mkdir()
    (tmp_path / "copy/headway/llm/__init__.py").write_text("")
    (tmp_path / "copy/headway/llm/queries.py").write_text("import no_such_module")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "copy", capture_output=True, text=True)
    assert "no_such_module" in out.stderr
