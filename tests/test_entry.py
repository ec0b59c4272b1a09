"""The driver's contract: it imports without a session, and without the corpus subpackage."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout


def test_queries_without_a_session():
    out = _run("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q) >= 60, set(s) <= set(q))")
    assert out.split() == ["True", "True"]


def test_without_the_corpus_subpackage():
    hide = "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None; "
    out = _run(hide + "import __spark_entry__ as e; q = e.queries(); print('ohlc_bars' in q, any(n.startswith('op') for n in q))")
    assert out.split() == ["True", "False"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
