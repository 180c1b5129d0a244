from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_counts_words(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["word", "cnt"] and df.limit(1).count() == 1


def test_the_rest_works_without_the_optional_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("weftline.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "q01_wordcount" in e.queries() and not any(n.startswith("op") for n in e.queries()) and e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_nothing_else_imports_the_optional_operators():
    for f in (ROOT / "weftline").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "weftline.llm" not in f.read_text()
