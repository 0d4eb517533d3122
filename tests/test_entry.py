import importlib.util
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_catalogue():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "search_topk" in names
    if importlib.util.find_spec("tesserine.llm"):
        assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 10 and "pipeline" in names


def test_entry_runs(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["query_id", "rank", "image_id", "score"] and out.count() > 0


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_stands_without_the_llm_folders(tmp_path, with_pipeline):
    """With corpus_pipeline.py left where it is, and without it."""
    shutil.copytree(os.path.join(ROOT, "tesserine"), tmp_path / "tesserine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * with_pipeline]:
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') or n == 'pipeline' for n in q) and e.oracle_sql(); print('ok')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True).stdout.strip() == "ok"
