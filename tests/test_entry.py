import importlib
import re
import subprocess
import sys

from .conftest import ROOT


def test_entry_is_the_flagship_query(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:2] == ["model", "n"] and df.count() == 3


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    entry = importlib.reload(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['touchline.llm'] = None; import __spark_entry__ as e; assert e.corpus is None and len(e.queries()) > 60 and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_nothing_else_imports_the_corpus_operators():
    from pathlib import Path

    for p in Path(ROOT, "touchline").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import llm|\bllm\.|\.llm", p.read_text()), p
