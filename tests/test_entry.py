"""The driver's contract, and that the library does without its training-data part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["_id", "revenue", "lines", "dearest"] and len(df.collect()) == 25


def test_every_sql_has_a_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 100


def test_nothing_else_imports_the_training_data_part(tmp_path):
    """A copy without those files still imports and has the other queries."""
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if rel.parts[0] in (".git", "tests") or "llm" in rel.parts or rel.name == "corpus_pipeline.py":
            continue
        (tmp_path / rel.parent).mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
    for p in (ROOT / "larkspur").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert ".llm" not in p.read_text(), p
