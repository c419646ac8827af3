import math
from collections import Counter

import numpy as np
import pytest

from loam.llm import neighbours as N


def brute(rows, queries, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)))
    good = list(good)
    length = sorted(Counter(len(v) for _, v in good).items(), key=lambda x: (-x[1], x[0]))[0][0]
    good = [(i, np.array(v)) for i, v in good if len(v) == length]
    out = {}
    for q, v in good:
        if q in queries:
            found = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good if i != q)[:k]
            out[q] = found
    return out


def test_pseudo_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(20, 48))
    near = N.axes(x, 5)
    assert near.shape == (20, 128) and np.allclose((near[:, :64] ** 2).sum(axis=1), 1)
    cells = N.probes(x, 0, 2, 30, 1)
    assert cells.shape == (20, 30) and all(len(set(c)) == 30 for c in cells.tolist())
    assert (cells[:, 0] == N.probes(x, 0, 2, 1, 1)[:, 0]).all()


@pytest.mark.parametrize("sf_dir,limits", [("/root/testdata/sf0.01", (20_000, 2000)), ("/root/testdata/sf0.1", (7, 2))])
def test_recall(spark, monkeypatch, sf_dir, limits):
    monkeypatch.setattr(N, "CELL_VECTORS", limits[0])
    monkeypatch.setattr(N, "CELL_QUERIES", limits[1])
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, {i for i, _ in rows if i % 100 == 0})
    got = {}
    for r in N.op5_neighbours(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11)) and [x[2] for x in found] == sorted(x[2] for x in found)
        exact = {i: s for s, i in brute(rows, {q}, len(rows))[q]}
        assert all(math.isclose(exact[i], s, rel_tol=1e-12) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 2.0, 0.5]) for i in range(60)]  # many equal vectors
    rows += [(200, None), (300, [0.0] * 5), (400, [1.0, None, 0.0, 0.0, 1.0]), (500, [float("nan")] + [1.0] * 4), (600, [float("inf")] * 5), (700, []), (800, [1.0] * 3), (None, [1.0] * 5)]
    rows += [(7, rows[7][1]), (0, rows[0][1])]  # repeated rows
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id bigint, embedding array<double>, cls string, rank int")
    got = {}
    for r in N.nearest(df, df.where("vec_id % 100 = 0"), tables=4, probed=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, {0, 100})
    assert set(got) == {0, 100}
    for q in got:
        assert [(i, round(s, 12)) for _, i, s in sorted(got[q])] == [(i, round(s, 12)) for s, i in want[q]]
    assert N.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (1, 2, 3)")
    assert N.nearest(few, few, probed=16, tables=8).count() == 6


def listed(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, round(s, 12)) for _, i, s in sorted(x)] for q, x in got.items()}


@pytest.mark.parametrize("limits", [(20_000, 2000), (4, 2)])
def test_few_vectors_are_all_met(spark, monkeypatch, limits):
    monkeypatch.setattr(N, "CELL_VECTORS", limits[0])
    monkeypatch.setattr(N, "CELL_QUERIES", limits[1])
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(9)] + [(100, (rng.normal(size=64) * 50).tolist())]
    rows += [(3, rng.normal(size=64).tolist()), (4, rows[4][1])]  # an id with two vectors, a repeated row
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = listed(N.nearest(df, df))
    assert set(got) == {*range(9), 100} and all(len(x) == 9 for x in got.values())
    for q in (0, 5, 100):
        want = {}
        for s, i in brute(rows, {q}, len(rows))[q]:
            want.setdefault(i, round(s, 12))
        assert got[q] == list(want.items())


def test_ties_at_the_edge_of_a_cell(spark):
    rows = [(0, [1.0] * 64)] + [(1000 - i, [1.0] * i + [0.0] + [1.0] * (63 - i)) for i in range(64)]  # all equally far
    rows += [(2000 + i, [-1.0] * 63 + [float(i)]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = listed(N.nearest(df, df.where("vec_id = 0"), probed=128))
    assert got == {0: [(i, 1.0) for i in range(937, 947)]}


def test_128_ties(spark):
    """The 128 neighbours along the axes are all as far: those with the smallest ids are found."""
    middle = [3.0] * 64
    rng = np.random.default_rng(9)
    ids = rng.permutation(np.arange(1, 129)).tolist()
    rows = [(1000, middle)] + [(ids[2 * i + s], [x + (2 * s - 1) * (j == i) for j, x in enumerate(middle)]) for i in range(64) for s in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert listed(N.nearest(df, df.where("vec_id = 1000"), probed=128)) == {1000: [(i, 1.0) for i in range(1, 11)]}
    assert listed(N.nearest(df, df.where("vec_id = 1000"), recall=1.0)) == {1000: [(i, 1.0) for i in range(1, 11)]}


def test_close_vectors_far_away(spark):
    """Doubles around one far point, of which squares lose the differences."""
    rng = np.random.default_rng(10)
    point = rng.normal(size=16) * 1e6
    rows = [(i, (point * (1 + 1e-9 * rng.normal(size=16))).tolist()) for i in range(1, 2001)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for how in (dict(probed=32), dict(recall=1.0)):
        got = {}
        for r in N.nearest(df, df.where("vec_id % 500 = 0"), **how).collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert {q: sorted(x) for q, x in got.items()} == brute(rows, {500, 1000, 1500, 2000})


def test_share_that_is_measured(spark):
    """On the largest table under 0.2 of the vectors are measured for a recall of 0.9 of the queries' neighbours."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float32)
    names = [str(r.vec_id).encode() for r in rows]
    classes = spark.createDataFrame(list(zip(map(bytearray, names), (bytearray(v.tobytes()) for v in x))), "cls binary, packed binary")
    queries = classes.where("cast(cast(cls AS string) AS int) % 100 = 0")
    plan, met = N.calibrated(classes, queries, 10, N.Plan(1, 16, 1, 4, 0, "float32"), 0.95)
    assert met >= 0.95
    q = [i for i, r in enumerate(rows) if r.vec_id % 100 == 0]
    loss, code = N.losses(x[q].astype(np.float64), 0, 16, 0), N.codes(x.astype(np.float64), 0, 16, 0)
    each = np.stack([loss[:, h][:, code[:, h]] for h in range(16)])
    within = (each[0] <= plan.cell_cut) & (each.sum(axis=0) <= plan.cut)
    assert within.mean() < 0.2
    far = ((x[q][:, None].astype(np.float64) - x[None]) ** 2).sum(axis=2)
    far[np.arange(len(q)), q] = np.inf
    best = np.argsort(far, axis=1)[:, :10]
    assert np.take_along_axis(within, best, 1).mean() >= 0.9


def test_queries_from_elsewhere_and_more_hashes_a_cell(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_VECTORS", 2)  # two hashes a cell, of 16 axes each, for 300 vectors
    rng = np.random.default_rng(12)
    middles = rng.normal(size=(10, 8)) * 4
    rows = [(i, (middles[i % 10] + rng.normal(size=8)).tolist()) for i in range(300)]
    asked = [(1000 + i, (middles[i] + rng.normal(size=8)).tolist()) for i in range(10)]
    df, queries = (spark.createDataFrame(x, "vec_id bigint, embedding array<double>") for x in (rows, asked))
    got = listed(N.nearest(df, queries, recall=1.0, tables=2, hashes=6))
    for q, v in asked:
        want = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows)[:10]
        assert got[q] == [(i, round(s, 12)) for s, i in want]
