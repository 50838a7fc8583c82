import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from workfeed.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql_belong_together(spark):
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_llm_folder(tmp_path):
    """The entry imports, with the library's own queries, where the subpackage and the pipeline are gone."""
    (tmp_path / "workfeed").mkdir()
    for p in (ROOT / "workfeed").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "workfeed" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-2:] == [str(len(catalog.queries())), "False"], out.stderr
