"""Sequences of sizes into bins that are filled one after the other: containers, upload fragments, frames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import container_name

CONTAINER, FRAGMENT = 256 << 10, 4 << 20


def pack(df: DataFrame, by: list[str], order: list[str], size: str, capacity: int, bin_: str = "bin", offset: str = "offset") -> DataFrame:
    """`df` with the bin and the offset of each row: a row that would pass `capacity` opens the next bin of its group.

    Where a bin opens depends on all rows before it, so a group is filled in order by one task. Only the columns named here should be in `df`: keep
    payloads out, and give large stores several lanes (`by` with a hash of the file), which fill containers of their own; as many, by the bytes there
    are, that a lane stays small (see DedupStore).
    """
    names = [*df.columns, bin_, offset]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{bin_}` int, `{offset}` bigint"

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in order])
        bins, offsets, at, used = [], [], 0, 0
        for n in group[size].to_pylist():
            if used and used + n > capacity:
                at, used = at + 1, 0
            bins.append(at)
            offsets.append(used)
            used += n
        return group.append_column(bin_, pa.array(bins, pa.int32())).append_column(offset, pa.array(offsets, pa.int64())).select(names)

    return df.groupBy(*by).applyInArrow(fill, schema)


def containers(stored: DataFrame, order: list[str], lanes: Column | None = None, capacity: int = CONTAINER) -> DataFrame:
    """Stored shares (cloud, share_fp, length and the order) with lane, container and offset; container names count within a lane."""
    rows = stored.select("cloud", "share_fp", "length", *order, (F.lit(0) if lanes is None else lanes).cast("int").alias("lane"))
    packed = pack(rows, ["cloud", "lane"], order, "length", capacity)
    return packed.select("cloud", "lane", "share_fp", "length", container_name(F.col("bin")).alias("container"), "offset")


def fixed_fragments(secret_id: Column, chunk: int, capacity: int = FRAGMENT) -> Column:
    """The fragment of a share of a file cut at fixed sizes: in closed form, so without a shuffle."""
    return F.floor(secret_id / max(1, capacity // chunk)).cast("int")


def read_slices(slices: DataFrame, payloads: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows (cloud, lane, container, offset, length) with their bytes out of (cloud, lane, container, payload); `key`: what names a container."""
    cut = F.substring(F.col("payload"), (F.col("offset") + 1).cast("int"), F.col("length"))
    return slices.join(payloads, key or ["cloud", "lane", "container"]).withColumn("data", cut).drop("payload")


def container_payloads(packed: DataFrame, data: DataFrame) -> DataFrame:
    """The bytes of each container, of rows of `containers` and (cloud, share_fp, data); a container is bounded by its capacity."""
    joined = packed.join(data, ["cloud", "share_fp"]).groupBy("cloud", "lane", "container")
    return joined.agg(F.expr("listagg(data, x'') WITHIN GROUP (ORDER BY offset)").alias("payload"))
