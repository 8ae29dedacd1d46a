"""The driver's entry points, with and without the text subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row.n > 0 and row.n_missing < row.n


def test_imports_without_text_operators():
    code = (
        "import sys; sys.modules['rangeloom.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'summary' in q and not any(x.startswith('op') for x in q) and 'pipeline' not in q; e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_library_never_imports_the_text_operators():
    for path in (ROOT / "rangeloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "rangeloom.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
