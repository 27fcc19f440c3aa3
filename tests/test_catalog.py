"""Every query over the smallest tables, against its SQL where it has one; and the package without its text part."""

import subprocess
import sys
from pathlib import Path

import pytest

from skein.catalog.registry import ORACLE, QUERIES

from .oracle import compare

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    ok, n, _, _ = compare(spark, name, D)
    assert ok is not False and (n > 0 or name in ("move_pairs", "code_transitive"))


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_without_text_part():
    code = "import sys; sys.modules['skein.llm.queries'] = None; import __spark_entry__ as e; assert not any(k.startswith(('p2', 'p3', 'p5', 'p6', 'p7', 'p8')) for k in e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=60)
    assert out.returncode == 0, out.stderr
