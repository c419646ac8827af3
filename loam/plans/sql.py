"""The engine's tables and functions by name, for Spark SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loam.functions import delta as D
from loam.functions import vcdiff
from loam.functions.chunking import ChunkSpec, cut_points
from loam.functions.features import METHODS
from loam.functions.hashing import rabin_key_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """A view for each table of a folder."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def register_functions(spark: SparkSession) -> None:
    """Scalars rabin_key, delta_encode, delta_decode, vcdiff_encode, vcdiff_decode and super_features_<method>, and the table functions fixed_chunks and cdc_chunks (content, avg)."""

    def scalar(name: str, kind: str, arrow: pa.DataType, f) -> None:
        def apply(*columns: pa.Array) -> pa.Array:
            return pa.array([None if None in row else f(*row) for row in zip(*(c.to_pylist() for c in columns))], arrow)

        spark.udf.register(name, F.arrow_udf((_two if name.startswith(("delta", "vcdiff")) else _one)(apply), kind))

    scalar("rabin_key", "binary", pa.binary(), rabin_key_of)
    scalar("delta_encode", "binary", pa.binary(), D.encode)
    scalar("delta_decode", "binary", pa.binary(), D.decode)
    scalar("vcdiff_encode", "binary", pa.binary(), vcdiff.encode)
    scalar("vcdiff_decode", "binary", pa.binary(), vcdiff.decode)
    for method, f in METHODS.items():
        scalar(f"super_features_{method}", "array<bigint>", pa.list_(pa.int64()), f)

    for method in ("fixed", "cdc"):
        spark.udtf.register(f"{method}_chunks", _chunk_table(method))


def _one(apply):
    def column(a: pa.Array) -> pa.Array:
        return apply(a)

    return column


def _two(apply):
    def column(a: pa.Array, b: pa.Array) -> pa.Array:
        return apply(a, b)

    return column


def _chunk_table(method: str):
    @F.udtf(returnType="secret_id int, secret_size int, data binary")
    class Chunks:
        def eval(self, content: bytes, avg: int) -> Iterator[tuple]:
            spec = ChunkSpec(method, avg) if method == "fixed" else ChunkSpec(method, avg, max(48, avg // 4), avg * 2)
            ends = cut_points(bytes(content or b""), spec)
            for i, (a, b) in enumerate(zip([0, *ends], ends)):
                yield i, b - a, content[a:b]

    return Chunks
