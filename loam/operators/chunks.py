"""Files to secrets (chunks), and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.chunking import ChunkSpec, chunk_ranges


def _cut(files: DataFrame, spec: ChunkSpec, *more: str) -> DataFrame:
    """A row for each chunk of each row's content: `more` columns, n, secret_id and chunk (size, data)."""
    ranges = files.withColumn("ranges", chunk_ranges(F.col("content"), spec))
    # cut before the explosion, which would copy the whole content to every chunk's row
    cut = F.transform("ranges", lambda r: F.struct(r["size"].alias("size"), F.substring(F.col("content"), r["start"] + 1, r["size"]).alias("data")))
    return ranges.select("user_id", "file_name", "seq", "file_size", *more, F.size("ranges").alias("n"), F.posexplode(cut).alias("secret_id", "chunk"))


def secrets(files: DataFrame, spec: ChunkSpec = ChunkSpec()) -> DataFrame:
    """A row for each chunk of each file: user_id, file_name, seq, file_size, secret_id, secret_size, is_last, data. No shuffle."""
    last = F.col("secret_id") == F.col("n") - 1
    return _cut(files, spec).select("user_id", "file_name", "seq", "file_size", "secret_id", F.col("chunk.size").alias("secret_size"), last.alias("is_last"), F.col("chunk.data").alias("data"))


def part_secrets(parts: DataFrame, spec: ChunkSpec, part_bytes: int) -> DataFrame:
    """The chunks of files that come in parts of `part_bytes` (see sources.files.folder_parts), as secrets gives them. No shuffle.

    A chunk ends where its part ends: with fixed sizes, which have to divide part_bytes, just as in a whole file. Content-defined chunks are numbered in
    order, but with gaps between parts, as each part has the numbers of as many chunks as could be in it.
    """
    if spec.method == "fixed" and part_bytes % spec.avg:
        raise ValueError(f"chunks of {spec.avg} bytes don't divide parts of {part_bytes}")
    most = -(-part_bytes // (spec.avg if spec.method == "fixed" else spec.min))
    last = (F.col("secret_id") == F.col("n") - 1) & (F.col("part") == F.col("n_parts") - 1)
    number = (F.col("part") * most + F.col("secret_id")).cast("int")
    each = _cut(parts, spec, "part", "n_parts")
    return each.select("user_id", "file_name", "seq", "file_size", number.alias("secret_id"), F.col("chunk.size").alias("secret_size"), last.alias("is_last"), F.col("chunk.data").alias("data"))


def expected_chunks(file_size: Column, avg: int) -> Column:
    """How many chunks a file of that size has, if cut at fixed sizes."""
    return F.ceil(file_size / avg).cast("long")


def is_zero(data: Column) -> Column:
    """True for a chunk of zero bytes only."""
    return data == F.unhex(F.repeat(F.lit("00"), F.octet_length(data)))
