import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from loam.llm import mixing as M


def docs_of(spark, sizes, extra=()):
    rows = [(i * 1000 + j, "w " * (1 + j % 7), s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    return spark.createDataFrame([(*r, "clash") for r in [*rows, *extra]], "doc_id bigint, text string, source string, mix string")


def test_repeats_limit_and_budget(spark):
    docs = docs_of(spark, {"big": 400, "mid": 80, "small": 20, None: 10}, [(5, None, "no words"), (None, "", "no words"), (7, "a b", "big"), (7, "a b", "big"), (8, "x " * 20_000, "mid")])
    plan = M.plan_mix(docs, budget_passes=1.0, max_repeats=3.0, blocks=16)
    p = {r.source: r for r in plan.collect()}
    assert set(p) == {"big", "mid", "small", None} and math.isclose(sum(r.weight for r in p.values()), 1)
    assert math.isclose(max(r.target / r.tokens for r in p.values()), 3.0, rel_tol=1e-6)
    got = M.repeats(docs, plan, blocks=16).withColumn("n", M.n_tokens(F.col("text")))
    rows = got.collect()
    assert len(rows) == docs.count()
    for s, r in p.items():
        used = sum(x.n * x.mix.repeats for x in rows if x.source == s)
        assert used <= r.target + 1e-6 and (used > r.target - 20_001 if s == "mid" else used > r.target - 8)
        assert {x.mix.repeats - r.passes for x in rows if x.source == s} <= {0, 1}
    assert all(x.mix.repeats == 0 for x in rows if x.source == "no words")
    out = M.mixed(docs, plan, blocks=16).collect()
    assert Counter((x.doc_id, x.epoch) for x in out).most_common(1)[0][1] <= 3 and len(out) == sum(x.mix.repeats for x in rows)
    orders = [[x.doc_id for x in sorted(out, key=lambda x: (x.block_turn, x.document_turn)) if x.source == "small" and x.epoch == e] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]


def test_entropy(spark):
    docs = docs_of(spark, {"a": 300, "b": 60, "c": 12})
    for target in (0.3, 0.8, 1.05):
        w = [r.weight for r in M.plan_mix(docs, budget_tokens=100, entropy=target).collect()]
        assert math.isclose(-sum(x * math.log(x) for x in w), target, rel_tol=1e-6)
    assert {round(r.weight, 9) for r in M.plan_mix(docs, budget_tokens=100, entropy=5.0).collect()} == {round(1 / 3, 9)}


def test_cover_keeps_every_document(spark):
    docs = docs_of(spark, {"a": 300, "b": 60, "c": 12})
    plan = M.plan_mix(docs, max_repeats=2.0)
    got = M.repeats(docs, plan).collect()
    assert min(r.mix.repeats for r in got) == 1 and max(r.mix.repeats for r in got) == 2
    assert all(r.mix.repeats == 1 for r in got if r.source == "a")


def test_edge_cases(spark):
    docs = docs_of(spark, {"a": 3, "b": 2})
    assert M.repeats(docs.limit(0), M.plan_mix(docs.limit(0), budget_tokens=10, max_repeats=2.0)).count() == 0
    assert [r.exponent for r in M.plan_mix(docs, budget_passes=5.0, max_repeats=2.0).collect()] == [1.0, 1.0]
    with pytest.raises(Exception, match="over 1 sources"):
        M.plan_mix(docs, budget_tokens=10, max_repeats=2.0, max_sources=1).collect()
    with pytest.raises(ValueError):
        M.plan_mix(docs)


def test_query_equals_sql(spark, sf):
    got = M.op1_mixing(spark, sf)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({M.ORACLE_SQL['op1_mixing']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
