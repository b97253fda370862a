import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_form_has_a_query(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    assert "hybrid_search" in sql


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_works_without_the_training_data_operators(tmp_path, gone):
    for p in ROOT.iterdir():
        if p.name not in (*gone, "evidara", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "evidara").mkdir()
    for p in (ROOT / "evidara").iterdir():
        if p.name not in gone:
            (tmp_path / "evidara" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'hybrid_search' in q and set(s) <= set(q); assert not any(x[:2] == 'op' and x[2].isdigit() or x == 'pipeline' for x in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120)
