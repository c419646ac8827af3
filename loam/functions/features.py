"""Super-features, of which similar chunks are likely to share one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.hashing import WINDOW, rabin_fingerprints

#: Factors and summands of the six linear maps. Fixed values.
LINEAR_MAPS = [(5652377, 45673472), (24423617, 146512310), (16341615, 142364781), (3526234, 1225434201), (654410, 324130), (3124312, 359840125)]


def _hashed(a: int, b: int) -> int:
    return int.from_bytes(xxhash.xxh64_digest(int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little"), 12345678), "big", signed=True)


def finesse(data: bytes) -> tuple[int, int, int] | None:
    """Three features of the ranked maxima in six sub-regions; None below a window and six bytes.

    Each region's largest fingerprint is taken, the regions' first and second three are ranked, and equal ranks are hashed together. A region that
    would reach past the end stops there.
    """
    n = len(data)
    part = n // 6
    if n < WINDOW or part < 1:
        return None
    f = rabin_fingerprints(np.frombuffer(data, np.uint8))
    tops = [int(f[WINDOW - 1 + m * part : WINDOW + (m + 1) * part].max(initial=0)) for m in range(6)]
    first, second = sorted(tops[:3], reverse=True), sorted(tops[3:], reverse=True)
    return tuple(_hashed(a, b) for a, b in zip(first, second))


def n_transform(data: bytes) -> tuple[int, int, int] | None:
    """Three features of the maxima of six linear maps, modulo 2^32, of all fingerprints; None below a window."""
    if len(data) < WINDOW:
        return None
    f = rabin_fingerprints(np.frombuffer(data, np.uint8))[WINDOW - 1 :]
    tops = [int(((f * np.uint64(a) + np.uint64(b)) & np.uint64(0xFFFFFFFF)).max()) for a, b in LINEAR_MAPS]
    return tuple(_hashed(a, b) for a, b in zip(tops[::2], tops[1::2]))


METHODS = {"finesse": finesse, "ntransform": n_transform}


def super_features(data: Column, method: str = "finesse") -> Column:
    """struct<sf1, sf2, sf3: bigint> of a BINARY column; null where there are none."""
    if method not in METHODS:
        raise ValueError(f"no feature method {method!r}")
    compute = METHODS[method]

    @F.arrow_udf("struct<sf1: bigint, sf2: bigint, sf3: bigint>")
    def features(chunks: pa.Array) -> pa.Array:
        found = [compute(c) if c is not None else None for c in chunks.to_pylist()]
        return pa.array([None if f is None else dict(zip(("sf1", "sf2", "sf3"), f)) for f in found], pa.struct([(f"sf{i}", pa.int64()) for i in (1, 2, 3)]))

    return features(data)
