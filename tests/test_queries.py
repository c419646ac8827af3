"""Every registered query of the store: against its SQL, or that it gives rows."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import database, difference

from loam.plans.queries import ORACLE_SQL, QUERIES

EMPTY = {"restore_missing"}


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE_SQL:
        assert difference(df, db, ORACLE_SQL[name]) is None
    else:
        assert df.count() > 0


def test_container_names_after_676_containers(spark, tmp_path):
    """A lane of 704 containers, each filled by the 32 chunks of a document, so that the recursion of the SQL, slow over so many rows, has a closed form."""
    rng = random.Random(5)
    docs = [rng.randbytes(1 << 14).hex() for _ in range(704)]
    pq.write_table(pa.table({"doc_id": [8 * i for i in range(704)], "text": docs, "source": ["src1"] * 704}), tmp_path / "documents.parquet")
    names = ORACLE_SQL["container_pack"].rsplit(")\n", 1)[1]
    assert names.startswith("SELECT") and names.endswith("FROM p")
    filled = "WITH p AS (SELECT i // 32 * 8 AS doc_id, (i % 32)::INTEGER AS secret_id, (i // 32)::INTEGER AS bin, i % 32 * 1024 AS used FROM range(32 * 704) AS r(i)) "
    assert difference(QUERIES["container_pack"](spark, str(tmp_path)), database(str(tmp_path)), filled + names) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
