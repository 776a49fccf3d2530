import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark)
    assert rows.count() > 0 and "median" in rows.columns


def test_without_the_subpackage(tmp_path):
    """The registry works where the training-data subpackage has been left out."""
    (tmp_path / "planeworks").mkdir()
    for p in (ROOT / "planeworks").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "planeworks" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; n = e.queries(); assert 'raw_stats' in n and not any(k.startswith('op') and k[2].isdigit() for k in n) and 'pipeline' not in n"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "planeworks").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "planeworks").parts:
            assert "planeworks.llm" not in p.read_text(), p
