import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["l_orderkey", "o_orderdate", "o_orderpriority", "revenue"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_optional_modules(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tpch_q3' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)


def test_nothing_else_imports_the_optional_modules():
    for p in (ROOT / "wharfline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "wharfline.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
