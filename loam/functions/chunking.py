"""Cutting byte strings into chunks: fixed sizes natively, content-defined cuts in an Arrow UDF."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base and modulus of the window's polynomial. Fixed values.
BASE, MODULUS = 257, 1 << 23


@dataclass(frozen=True)
class ChunkSpec:
    """How to chunk: `fixed` cuts every `avg` bytes, `cdc` where the hash of the last `window` bytes says, between `min` and `max`."""

    method: str = "fixed"
    avg: int = 8192
    min: int = 2048
    max: int = 16384
    window: int = 48

    def __post_init__(self) -> None:
        if self.method not in ("fixed", "cdc"):
            raise ValueError(f"no chunking method {self.method!r}")
        if self.avg < 1 or self.method == "cdc" and not self.window <= self.min < self.avg < self.max:
            raise ValueError("window <= min < avg < max must hold")
        if self.method == "cdc" and self.avg & (self.avg - 1):
            raise ValueError("avg must be a power of two")


def window_hashes(data: np.ndarray, window: int) -> np.ndarray:
    """At each byte from the window-th on, the hash of the `window` bytes that end there: sum of b[i-t] * 257^t, modulo 2^23."""
    if len(data) < window:
        return np.zeros(0, np.uint32)
    found = np.zeros(len(data) - window + 1, np.uint32)
    power = 1
    for t in range(window):
        found += data[window - 1 - t : len(data) - t].astype(np.uint32) * np.uint32(power)
        power = power * BASE % MODULUS
    return found & np.uint32(MODULUS - 1)  # 2^23 divides the 2^32 at which the sum wraps


def cut_points(data: bytes, spec: ChunkSpec) -> list[int]:
    """The ends of the chunks. Empty data has none."""
    n = len(data)
    if spec.method == "fixed":
        return [min(i + spec.avg, n) for i in range(0, n, spec.avg)]
    bits = spec.avg.bit_length() - 1
    hashes = window_hashes(np.frombuffer(data, np.uint8), spec.window)
    anchors = np.flatnonzero((hashes & np.uint32((1 << bits) - 1)) == 0) + spec.window  # lengths up to and with the anchor
    ends, start = [], 0
    while start + spec.min <= n:
        at = np.searchsorted(anchors, start + spec.min)
        end = min(start + spec.max, n, int(anchors[at]) if at < len(anchors) else n)
        ends.append(end)
        start = end
    return ends if not n or ends and ends[-1] == n else [*ends, n]


def chunk_ranges(content: Column, spec: ChunkSpec) -> Column:
    """array<struct<start, size>> of a BINARY column's chunks, in order. Null and empty content has none."""
    if spec.method == "fixed":
        size = F.octet_length(content)
        starts = F.sequence(F.lit(0), (size - 1).cast("int"), F.lit(spec.avg))
        ranges = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(spec.avg), size - s).cast("int").alias("size")))
        return F.when(size > 0, ranges).otherwise(F.array().cast("array<struct<start:int,size:int>>"))

    @F.arrow_udf("array<struct<start: int, size: int>>")
    def ranges(contents: pa.Array) -> pa.Array:
        rows = []
        for c in contents:
            ends = cut_points(c.as_py() or b"", spec)
            rows.append([{"start": a, "size": b - a} for a, b in zip([0, *ends], ends)])
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())])))

    return ranges(content)
