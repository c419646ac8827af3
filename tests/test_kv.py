"""The key-value log against a dictionary, over random operations."""

import random

import pytest
from pyspark.sql import functions as F

from loam.operators.kv import KV, bloom_build, bloom_probe

SCHEMA = "key string, seq bigint, op string, value string"


class Model:
    def __init__(self):
        self.steps = []

    def state(self, as_of=None):
        out = {}
        for seq, op, k, v in self.steps:
            if as_of is None or seq <= as_of:
                out.pop(k, None)
                if op == "PUT":
                    out[k] = v
        return out


def test_random_operations(spark):
    rng = random.Random(301)
    model, seq = Model(), 0
    for _ in range(3000):
        for _ in range(rng.randint(0, 7) if rng.random() < 0.1 else 1):
            k = "".join(rng.choices("abc", k=rng.randint(1, 4)))
            v = "v" * (rng.randint(100, 199) if rng.random() < 0.05 else rng.randint(0, 7))
            model.steps.append((seq, "PUT" if rng.random() < 0.55 else "DEL", k, v))
            seq += 1
    kv = KV(spark.createDataFrame([(k, s, o, v if o == "PUT" else None) for s, o, k, v in model.steps], SCHEMA).repartition(3))
    for as_of in (None, -1, 0, 500, 1777):
        want = model.state(as_of)
        assert {r.key: r.value for r in kv.merged(as_of).collect()} == want
        assert [r.key for r in kv.scan(as_of=as_of).collect()] == sorted(want)
        assert [r.key for r in kv.scan(as_of=as_of, reverse=True).collect()] == sorted(want, reverse=True)
    want = model.state()
    assert [r.key for r in kv.seek("b", 4).collect()] == [k for k in sorted(want) if k >= "b"][:4]
    for k in ("a", "abc", "zzz"):
        assert [r.value for r in kv.get(k).collect()] == ([want[k]] if k in want else [])
    for bounds in ((None, None), ("b", None), ("ab", "bc")):
        packed = kv.compact(*bounds)
        assert {r.key: r.value for r in packed.merged().collect()} == want
    assert kv.compact().log.count() == len(want)
    p = kv.properties().first()
    assert (p.n_versions, p.last_seq) == (len(model.steps), seq - 1)


def test_writes_and_files(spark, tmp_path):
    kv = KV(spark.createDataFrame([], SCHEMA)).put(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "key string, seq bigint, value string"))
    kv = kv.delete(spark.createDataFrame([("a", 3)], "key string, seq bigint"))
    assert [(r.key, r.value) for r in kv.scan().collect()] == [("b", "y")]
    kv.write_compacted(str(tmp_path / "log"))
    assert KV(spark.read.parquet(str(tmp_path / "log"))).log.count() == 1
    got = kv.get_all(spark.createDataFrame([("a",), ("b",), ("c",)], "key string")).collect()
    assert {r.key: r.value for r in got} == {"a": None, "b": "y", "c": None}


@pytest.mark.parametrize("n", [0, 1, 100, 10_000])
def test_bloom(spark, n):
    bloom = bloom_build(spark.range(n).select(F.col("id").alias("key")), bits_per_key=20)
    assert bloom_probe(spark.range(n).select(F.col("id").alias("key")), bloom).where("not may_contain").count() == 0
    wrong = bloom_probe(spark.range(1_000_000, 1_010_000).select(F.col("id").alias("key")), bloom).where("may_contain").count()
    assert wrong <= (200 if n > 1 else 10_000)
    with pytest.raises(ValueError):
        bloom_build(spark.range(10).select(F.col("id").alias("key")), expected=10**10)
