"""The queries of this package that SQL can express, against their SQL; and what the package's rules say of all of them."""

import re
from pathlib import Path

import pytest
from oracle import database, difference

from loam.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", oracle_sql())
def test_oracle(spark, name):
    assert difference(queries()[name](spark, SF), database(SF), oracle_sql()[name]) is None


def test_one_query_for_each_operator():
    numbers = [int(m[1]) for n in queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in queries()


def test_nothing_outside_imports_the_package():
    root = Path(__file__).resolve().parents[2]
    for p in root.glob("loam/**/*.py"):
        if "llm" not in p.parts:
            assert "loam.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
