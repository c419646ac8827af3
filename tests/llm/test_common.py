"""What the operators share."""

import threading

import pytest
from pyspark.sql import functions as F

from loam.llm import common as C


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_hot_values(spark, monkeypatch, how):
    monkeypatch.setattr(C, "HOT", 3)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 6}") for i in range(20)] + [(90, "lost"), (91, None)], "i int, k string")
    classes = spark.createDataFrame([("hot", 10, "a"), ("k0", 4, "b"), ("k2", 3, "c"), ("k4", 3, "d"), ("none", 0, "e")], "k string, n int, x string")
    got = sorted(map(str, C.join_hot(rows, classes, "k", how).select("i", "k", "x").collect()))
    assert got == sorted(map(str, rows.join(classes.drop("n"), "k", how).select("i", "k", "x").collect()))
    assert C.join_hot(rows.limit(0), classes, "k", how).count() == 0


def test_tables_of_another_thread_stay(spark):
    mine, start = C.kept(spark.range(3), "mine"), C.mark()
    gone = []

    def other():
        at = C.mark()
        table = C.kept(spark.range(4), "other")
        C.dropped(spark, at)
        with pytest.raises(Exception):
            table.agg(F.sum("id")).collect()
        gone.append(True)

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert gone and mine.count() == 3 and C.mark() == start
    C.dropped(spark, start - 1)
    assert C.mark() == start - 1


def test_a_checkpoint_that_joins_without_a_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("k"), F.lit("x").alias("v"))
    kept = C.checkpointed_by(df, "k")
    other = spark.range(10).select(F.col("id").alias("k")).groupBy("k").count().hint("merge")
    plan = kept.join(other, "k")._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 100 and plan.count("Exchange") <= 2 and "Exchange" not in plan.split("Scan ExistingRDD")[0]
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and kept.join(other, "k").count() == 100
