"""Approximate nearest neighbours by cross-polytope hashing: pseudo-rotated vectors go to the nearest signed axis, queries probe several."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import checkpointed, kept, partitions, table

#: Vectors, and queries, that meet in a task at most, on average: larger groups of cells are cut.
CELL_VECTORS, CELL_QUERIES = 20_000, 2_000
#: Queries by which the probing is set, at most.
SAMPLE = 200


def hadamard(columns: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each column, in place, scaled to be orthogonal; their length is a power of two."""
    d, h = len(columns), 1
    while h < d:
        pairs = columns.reshape(-1, 2, h, columns.shape[1])
        first, second = pairs[:, 0], pairs[:, 1]
        difference = first - second
        first += second
        second[...] = difference
        h *= 2
    columns /= np.sqrt(d)
    return columns


def units(vectors: np.ndarray) -> np.ndarray:
    """The vectors as columns of length 1, filled up with zeros to a power of two components."""
    x = np.zeros((1 << (vectors.shape[1] - 1).bit_length(), len(vectors)))
    x[: vectors.shape[1]] = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
    return x


def rotated(unit: np.ndarray, seed: int) -> np.ndarray:
    """The columns after a pseudo-rotation: three times random signs and a Hadamard transform."""
    for s in np.random.default_rng(seed).choice([-1.0, 1.0], (3, len(unit))):
        unit = hadamard(unit * s[:, None])
    return unit


def axes(vectors: np.ndarray, seed: int) -> np.ndarray:
    """(n, 2d): how near each vector, as a unit vector, is to each signed axis after a pseudo-rotation."""
    x = rotated(units(vectors), seed).T
    return np.concatenate([x, -x], axis=1)


def probes(vectors: np.ndarray, table_: int, hashes: int, n: int, seed: int) -> np.ndarray:
    """(rows, at most n): the cells of a table in which near vectors are likeliest, its own first.

    A cell is `hashes` axes together. The chance falls with the square of how much less near an axis is than the nearest, added up over the hashes.
    """
    cells = np.zeros((len(vectors), 1), np.int64)
    loss = np.zeros((len(vectors), 1))
    for k in range(hashes):
        near = axes(vectors, _seed(table_, k, seed))
        width = near.shape[1]
        own = (near.max(axis=1, keepdims=True) - near) ** 2
        loss = (loss[:, :, None] + own[:, None, :]).reshape(len(vectors), -1)
        cells = (cells[:, :, None] * width + np.arange(width)).reshape(len(vectors), -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :n]
        loss, cells = np.take_along_axis(loss, best, 1), np.take_along_axis(cells, best, 1)
    return cells


def _seed(table_: int, k: int, seed: int) -> int:
    return (seed * 1009 + table_) * 101 + k


def codes(vectors: np.ndarray, table_: int, hashes: int, seed: int) -> np.ndarray:
    """(rows, hashes): the nearest signed axis of each hash of a table."""
    unit, found = units(vectors), np.empty((len(vectors), hashes), np.uint16)
    for k in range(hashes):
        x = rotated(unit, _seed(table_, k, seed))
        axis = np.abs(x).argmax(axis=0)
        found[:, k] = axis + len(x) * (x[axis, np.arange(x.shape[1])] < 0)
    return found


def losses(vectors: np.ndarray, table_: int, hashes: int, seed: int) -> np.ndarray:
    """(rows, hashes, 2d): by how much, squared, each axis is less near than the nearest."""
    unit, found = units(vectors), []
    for k in range(hashes):
        x = rotated(unit, _seed(table_, k, seed)).T
        top = np.abs(x).max(axis=1, keepdims=True)
        found.append(np.concatenate([(top - x) ** 2, (top + x) ** 2], axis=1).astype(np.float32))
    return np.stack(found, axis=1)


def _cells(code: np.ndarray, width: int) -> np.ndarray:
    """The number of the cell that the axes of its hashes make."""
    found = np.zeros(len(code), np.int64)
    for k in range(code.shape[1]):
        found = found * width + code[:, k]
    return found


def _group(cells: np.ndarray, groups: int) -> np.ndarray:
    """The group that a cell belongs to."""
    return ((cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)


def _near_cells(loss: np.ndarray, most: float) -> np.ndarray:
    """The cells whose losses, of one query and the hashes that make a cell, add up to `most` at most."""
    cells, sums = np.zeros(1, np.int64), np.zeros(1, np.float32)
    for own in loss:
        all_ = sums[:, None] + own[None, :]
        some = np.nonzero(all_ <= most)
        cells, sums = cells[some[0]] * len(own) + some[1], all_[some]
    return cells


def _unpacked(packed: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """(rows, components), in double precision."""
    return np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(len(packed), -1).astype(np.float64)


class Plan(NamedTuple):
    """How to hash and probe. A cell is the axes of the first `level` hashes of a table; `probed` cells are looked into, or, if it is None, those whose
    loss is within `cell_cut`, and of their vectors those whose loss in all hashes is within `cut`.
    """

    tables: int
    hashes: int
    level: int
    groups: int
    seed: int
    kind: str
    probed: int | None = None
    cell_cut: float = np.inf
    cut: float = np.inf

    def of(self, packed: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return _unpacked(packed, self.kind)


def _coded(plan: Plan):
    """(cls, vector) -> (table, cls, packed, code): a row for each table; packed: the components as bytes; code: the axes of all hashes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                vectors = np.array(batch.column(1).to_pylist(), np.float64)
                packed = pa.array([v.tobytes() for v in vectors.astype(plan.kind)], pa.binary())
                for t in range(plan.tables):
                    code = codes(vectors, t, plan.hashes, plan.seed)
                    yield pa.record_batch([pa.array(np.full(len(vectors), t, np.int32)), batch.column(0), packed, pa.array([c.tobytes() for c in code], pa.binary())], ["table", "cls", "packed", "code"])

    return spread


def _packed(kind: str):
    """(cls, vector) -> (cls, packed)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, kind).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(vectors, pa.binary())], ["cls", "packed"])

    return pack


def _grouped(plan: Plan, width: int):
    """Coded rows with the group of their cell."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                yield pa.record_batch([batch.column(0), pa.array(_group(_cells(code[:, : plan.level], width), plan.groups)), *(batch.column(i) for i in (1, 2, 3))], ["table", "group", "cls", "packed", "code"])

    return place


def _asked(plan: Plan):
    """(cls, packed) of queries -> (table, group, cls, packed): a row for each group with a cell to look into."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                vectors = plan.of(batch.column(1))
                for t in range(plan.tables):
                    if plan.probed is None:
                        cells = (_near_cells(x, plan.cell_cut) for x in losses(vectors, t, plan.level, plan.seed))
                    else:
                        cells = iter(probes(vectors, t, plan.level, plan.probed, plan.seed))
                    groups = [np.unique(_group(c, plan.groups)) for c in cells]
                    n = np.array([len(g) for g in groups])
                    of = pa.array(np.repeat(np.arange(len(n)), n))
                    yield pa.record_batch([pa.array(np.full(len(of), t, np.int32)), pa.array(np.concatenate(groups)), batch.column(0).take(of), batch.column(1).take(of)], ["table", "group", "cls", "packed"])

    return spread


def _top(far: np.ndarray, k: int) -> np.ndarray:
    """The places of the k smallest, all that tie with the last of them included, in order."""
    edge = np.partition(far, k - 1)[k - 1] if k < len(far) else np.inf
    best = np.flatnonzero(far <= edge)
    return best[np.argsort(far[best], kind="stable")]


def _nearest(k: int, plan: Plan):
    """Of a group's vectors those within the cuts of a query are measured exactly: the k nearest, ties included."""

    def match(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        if rows.num_rows and queries.num_rows:
            x, q, table_ = plan.of(rows["packed"]), plan.of(queries["packed"]), rows["table"][0].as_py()
            code = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint16).reshape(len(x), -1).T.astype(np.intp)
            names, asked = rows["cls"].combine_chunks(), queries["cls"].combine_chunks()
            for at in range(0, len(q), 64):
                part = q[at : at + 64]
                if plan.probed is None:
                    loss, sums = losses(part, table_, plan.hashes, plan.seed), np.zeros((len(part), len(x)), np.float32)
                    for h in range(plan.hashes):
                        sums += loss[:, h][:, code[h]]
                        if h + 1 == plan.level:
                            sums[sums > plan.cell_cut] = np.inf
                    chosen = [np.flatnonzero(s <= plan.cut) for s in sums]
                else:
                    chosen = [np.arange(len(x))] * len(part)
                for i, some in enumerate(chosen):
                    if len(some):
                        far = np.sqrt(((x[some] - part[i]) ** 2).sum(axis=1))
                        best = _top(far, k)
                        found.append((asked.take(pa.array(np.full(len(best), at + i))), names.take(pa.array(some[best])), far[best]))
        kinds = (pa.binary(), pa.binary(), pa.float64())
        cols = [pa.concat_arrays(list(c)) for c in list(zip(*found))[:2]] + [pa.array(np.concatenate([f[2] for f in found]))] if found else [pa.array([], t) for t in kinds]
        return pa.table(cols, ["query", "cls", "score"])

    return match


def _sampled(k: int, plan: Plan, queries: list[tuple[bytes, bytes]]):
    """Of each of a few queries the k nearest vectors that a task has, but for the query itself, with their codes in all tables."""

    def nearest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.stack([np.frombuffer(v, plan.kind).astype(np.float64) for _, v in queries])
        best: list[list[tuple[float, bytes, bytes]]] = [[] for _ in queries]
        for batch in batches:
            if not batch.num_rows:
                continue
            names, x = batch.column(0).to_pylist(), plan.of(batch.column(1))
            middle = x[0]
            y, p = x - middle, q - middle
            rough = (p * p).sum(axis=1)[:, None] - 2 * p @ y.T + (y * y).sum(axis=1)[None, :]
            for i, (own, _) in enumerate(queries):
                some = np.argpartition(rough[i], k)[: k + 1] if k < len(x) else np.arange(len(x))
                new = [(float(np.sqrt(((x[j] - q[i]) ** 2).sum())), names[j], x[j].astype(plan.kind).tobytes()) for j in some if names[j] != own]
                best[i] = sorted(best[i] + new)[:k]
        rows = [(own, cls, far, v) for (own, _), b in zip(queries, best) for far, cls, v in b]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.float64(), pa.binary()))], ["query", "cls", "score", "packed"])

    return nearest_of


def calibrated(classes: DataFrame, queries: DataFrame, k: int, plan: Plan, recall: float) -> tuple[Plan, float]:
    """`plan` with the cuts that `recall` of the true neighbours of a sample of the queries are within; and what share that is.

    The sample is SAMPLE queries at most, chosen by hash; their k nearest are looked for among all vectors, in one pass, whose tasks give k for each.
    A neighbour is within the cuts if it is in one of the tables. Vectors nearer to a query than others have smaller losses, so that a table of more
    vectors, whose neighbours are nearer, has smaller cuts, and a smaller share of it is measured.
    """
    some = [(bytes(r["cls"]), bytes(r["packed"])) for r in queries.orderBy(F.xxhash64("cls")).limit(SAMPLE).collect()]
    if not some:
        return plan, 1.0
    pairs = classes.mapInArrow(_sampled(k, plan, some), "query binary, cls binary, score double, packed binary")
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "cls"))).where(F.col("r") <= k).collect()
    if not pairs:
        return plan, 1.0
    known = {cls: i for i, (cls, _) in enumerate(some)}
    of = np.array([known[bytes(r["query"])] for r in pairs])
    q, x = (np.stack([np.frombuffer(v, plan.kind).astype(np.float64) for v in vs]) for vs in ([v for _, v in some], [bytes(r["packed"]) for r in pairs]))
    first, total = [], []
    for t in range(plan.tables):
        loss, code = losses(q, t, plan.hashes, plan.seed), codes(x, t, plan.hashes, plan.seed)
        each = np.stack([loss[of, h, code[:, h]] for h in range(plan.hashes)], axis=1)
        first.append(each[:, : plan.level].sum(axis=1))
        total.append(each.sum(axis=1))
    first, total = np.stack(first), np.stack(total)
    slack = 1 + 1e-4  # sums of single precision in another order
    cell_cut = float(np.quantile(first.min(axis=0), 1 - (1 - recall) * 0.2, method="higher")) * slack
    best = np.where(first <= cell_cut, total, np.inf).min(axis=0)
    cut = float(np.quantile(best, recall, method="higher")) * slack
    return plan._replace(cell_cut=cell_cut, cut=cut), float((best <= cut).mean())


def _scanned(k: int, kind: str):
    def match(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """For each query the k nearest different ids of the rows, by exact distances; ties go to the smaller id."""
        found: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("id")
            ids, x = rows["id"].to_pylist(), _unpacked(rows["packed"], kind)
            for cls, q in zip(queries["cls"].to_pylist(), _unpacked(queries["packed"], kind)):
                far, seen = np.sqrt(((x - q) ** 2).sum(axis=1)), set()
                for j in np.argsort(far, kind="stable"):
                    if ids[j] not in seen:
                        seen.add(ids[j])
                        found.append((cls, ids[j], float(far[j])))
                        if len(seen) == k:
                            break
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found) if found else [(), (), ()], (pa.binary(), rows.schema.field("id").type, pa.float64()))], ["query", "id", "score"])

    return match


def scanned(points: DataFrame, queries: DataFrame, k: int, kind: str) -> DataFrame:
    """(query, id, score): at least the k nearest different ids among `points` (id, packed) of each of `queries` (cls, packed), in blocks that all meet."""
    n, m = max(1, -(-points.count() // CELL_VECTORS)), max(1, -(-queries.count() // CELL_QUERIES))
    points = points.withColumn("a", F.pmod(F.xxhash64("id", "packed"), F.lit(n)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    queries = queries.withColumn("b", F.pmod(F.xxhash64("cls"), F.lit(m)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    points, queries = points.select("a", "b", "id", "packed"), queries.select("a", "b", "cls", "packed")
    id_type = points.schema["id"].dataType.simpleString()
    return points.groupBy("a", "b").cogroup(queries.groupBy("a", "b")).applyInArrow(_scanned(k, kind), f"query binary, id {id_type}, score double")


def valid(column: str) -> Column:
    """True for vectors that have no null or non-finite component, and one that isn't zero."""
    finite = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    c = F.col(column)
    return c.isNotNull() & F.forall(c, finite) & F.exists(c, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 1, hashes: int = 16, probed: int | None = None, recall: float = 0.95, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k nearest found among `vectors`, without itself, by Euclidean distance.

    Vectors have, normalised, a nearest axis in each of `hashes` pseudo-rotations of each of `tables`. The first few of these axes, as many as the number
    of vectors demands, make a cell. A query looks into the cells whose loss is small (see losses), and measures there, exactly, in double precision, on
    the original vectors, those whose loss in all hashes is small. How small is set by the true neighbours of a sample of the queries, so that `recall`
    of these are met (see calibrated); `probed` cells, if it is given, are looked into instead, and measured whole. Ties go to the smaller id. A query
    that meets fewer than k others is held against all vectors, in blocks.

    Vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do vectors of another length than most (of the
    shorter, if several lengths are as frequent), nor rows with a null id. Rows with equal id and vector are one row. Equal vectors are one class,
    searched once, with its k + 1 smallest ids: no more of them can be among the k nearest. Other columns are not read. No rows: no rows.
    """
    spark = vectors.sparkSession
    narrow = all(df.schema[vector_col].dataType.elementType.typeName() == "float" for df in (vectors, queries))
    plan = Plan(tables, hashes, 1, 1, seed, "float32" if narrow else "float64", probed)
    unsigned = lambda x: x.cast("float" if narrow else "double") + F.lit(0.0).cast("float" if narrow else "double")  # noqa: E731  no -0.0

    def own(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).alias("id"), F.transform(vector_col, unsigned).alias("vector")).where(F.col("id").isNotNull() & valid("vector"))
        return rows.withColumn("cls", F.unhex(F.md5(F.concat_ws(",", "vector"))))

    all_, asked = own(vectors), own(queries)
    lengths = all_.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = lengths[0]["n"] if lengths else 0
    all_, asked = (x.where(F.size("vector") == length) for x in (all_, asked))
    ids = all_.select("cls", "id").withColumn("r", F.dense_rank().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("r") <= k + 1).select("cls", "id").distinct()
    ids = kept(ids, "ids")
    coded = all_.groupBy("cls").agg(F.any_value("vector").alias("vector")).mapInArrow(_coded(plan), "table int, cls binary, packed binary, code binary")
    coded = kept(coded, "codes")
    classes = coded.where("table = 0").select("cls", "packed")
    wanted = kept(asked.select("cls", "id").distinct(), "asked")
    query_classes = kept(asked.groupBy("cls").agg(F.any_value("vector").alias("vector")).mapInArrow(_packed(plan.kind), "cls binary, packed binary"), "queries")
    n, width = classes.count(), 2 << max(length - 1, 0).bit_length()
    while width**plan.level * CELL_VECTORS < n:
        plan = plan._replace(level=plan.level + 1)
    plan = plan._replace(groups=min(max(partitions(spark), -(-n // CELL_VECTORS)), width**plan.level))
    if probed is None:
        plan = calibrated(classes, query_classes, k, plan, recall)[0]
    index = coded.mapInArrow(_grouped(plan, width), "table int, group int, cls binary, packed binary, code binary")
    probe = kept(query_classes.mapInArrow(_asked(plan), "table int, group int, cls binary, packed binary"), "probes")
    # how many rows meet in each group: at most tables * groups numbers
    sizes = index.groupBy("table", "group").agg(F.count("*").alias("n")).join(probe.groupBy("table", "group").agg(F.count("*").alias("m")), ["table", "group"])
    sizes = checkpointed(sizes.select("table", "group", F.ceil(F.col("n") / CELL_VECTORS).cast("int").alias("n"), F.ceil(F.col("m") / CELL_QUERIES).cast("int").alias("m")))
    shared = F.broadcast(sizes) if plan.groups * tables <= 100_000 else sizes
    keys = ["table", "group", "a", "b"]
    index = index.join(shared, ["table", "group"]).withColumn("a", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    probe = probe.join(shared, ["table", "group"]).withColumn("b", F.pmod(F.xxhash64("cls"), F.col("m")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    index, probe = index.select(*keys, "cls", "packed", "code"), probe.select(*keys, "cls", "packed")
    met = index.groupBy(*keys).cogroup(probe.groupBy(*keys)).applyInArrow(_nearest(k + 1, plan), "query binary, cls binary, score double")
    found = met.distinct().join(ids.groupBy("cls").agg(F.min("id").alias("least")), "cls")
    best = F.row_number().over(Window.partitionBy("query").orderBy("score", "least"))
    found = kept(found.withColumn("r", best).where(F.col("r") <= k + 1).select("query", "cls", "score"), "found")
    named = wanted.select(F.col("id").alias("query_id"), F.col("cls").alias("query"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))

    def ranked(pairs: DataFrame) -> DataFrame:
        out = pairs.where("id != query_id").groupBy("query_id", "id").agg(F.min("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
        return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")

    out = kept(ranked(named.join(found, "query").join(ids, "cls")), "ranked")
    full = out.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = kept(named.join(full, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return out
    points = ids.join(classes, "cls").select("id", "packed")
    again = scanned(points, query_classes.join(short.select(F.col("query").alias("cls")).distinct(), "cls"), k + 1, plan.kind)
    return out.join(full, "query_id").select(*out.columns).union(ranked(short.join(again, "query")))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every 100th vector; see nearest."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0)).select("query_id", "rank", "vec_id", "score")


QUERIES = {"op5_neighbours": op5_neighbours}
ORACLE_SQL: dict[str, str] = {}
