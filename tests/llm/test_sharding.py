import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loam.llm import sharding as S


def published(key, n):
    b, j, key = -1, 0, key % (1 << 64)
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 16, 17, 64, 1000])
def test_jump_hash_is_the_published_one(spark, n):
    keys = [*range(-50, 50), 2**63 - 1, -(2**63), 123456789012345678]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", S.jump_hash(F.col("k"), n).alias("s")).collect()
    assert all(r.s == published(r.k, n) for r in got)


def check(rows, got, n):
    assert Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows) == Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    by = {}
    for r in got:
        assert r.shard == published(r.doc_id or 0, n) and r.grown_shard == published(r.doc_id or 0, n + 1) and r.grown_shard in (r.shard, n)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_slots(spark):
    rows = [(i, f"t{i % 3} é") for i in range(300)] + [(7, "again")] * 500 + [(None, None), (None, None), (None, ""), (9, None), (3, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id bigint, text string, n int, bucket string")
    check(rows, S.slots(docs, 5).collect(), 5)
    assert S.slots(docs.limit(0), 5).count() == 0
    added = S.add_shard(docs.withColumn("shard", F.lit("old")), 5)
    assert sorted(added.columns) == sorted([*docs.columns, "shard"]) and added.schema["shard"].dataType.typeName() == "integer"


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, S.op6_sharding(spark, sf).collect(), 16)
    plan = S.op6_sharding(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_string_ids(spark):
    docs = spark.createDataFrame([(f"id{i}", "t") for i in range(200)] + [(None, "t")], "doc_id string, text string")
    a = {r.doc_id: r.shard for r in S.add_shard(docs, 8).collect()}
    b = {r.doc_id: r.shard for r in S.add_shard(docs, 9).collect()}
    assert len(set(a.values())) == 8 and all(b[k] in (a[k], 8) for k in a)
