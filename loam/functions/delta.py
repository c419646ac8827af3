"""Deltas of byte strings: instructions that copy from a base, add new bytes or repeat one, packed with variable-length numbers."""

from __future__ import annotations

import lzma
import zlib
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of an indexed block of the base; shorter matches are not looked for.
BLOCK = 16
#: A base and a source below these sizes get no delta. Fixed values.
LEAST_BASE, LEAST_SOURCE = 1024, 512
#: Equal bytes from which on they are a run.
RUN = 24


class Op(NamedTuple):
    """COPY (offset in base, length), ADD (data), RUN (data of one byte, length)."""

    op: str
    offset: int
    length: int
    data: bytes


def _literal(data: bytes) -> list[Op]:
    """Added bytes, with runs told apart."""
    if len(data) < RUN:
        return [Op("ADD", 0, len(data), data)] if data else []
    held = np.frombuffer(data, np.uint8)
    edges = np.r_[0, np.flatnonzero(held[1:] != held[:-1]) + 1, len(data)]
    found, start = [], 0
    for k in np.flatnonzero(np.diff(edges) >= RUN).tolist():
        at, end = int(edges[k]), int(edges[k + 1])
        if start < at:
            found.append(Op("ADD", 0, at - start, data[start:at]))
        found.append(Op("RUN", 0, end - at, data[at : at + 1]))
        start = end
    return found + ([Op("ADD", 0, len(data) - start, data[start:])] if start < len(data) else [])


def _block_keys(data: np.ndarray, step: int) -> np.ndarray:
    """A 64-bit key of the block at each `step` bytes; equal blocks have equal keys."""
    words = np.zeros(max(0, len(data) - 7), np.uint64)
    for k in range(8):
        words |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    first, second = words[: len(data) - BLOCK + 1 : step], words[8 : len(data) - 7 : step]
    return first * np.uint64(0x9E3779B97F4A7C15) + (second ^ second >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many bytes two arrays begin with in common."""
    n, at, width = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(at + width, n)] != b[at : min(at + width, n)])
        if len(differ):
            return at + int(differ[0])
        at, width = at + width, width * 4
    return n


def instructions(base: bytes, source: bytes, within: bool = False) -> list[Op]:
    """Makes `source` out of `base`: blocks of the base that occur in the source are extended both ways.

    The blocks of the base and every window of the source have keys, looked up all at once; only where one is found bytes are compared. within: blocks
    of the source count too, for places behind their beginning; offsets beyond the base are of the source, and a copy may run into what it makes.
    """
    whole = base + source if within else base
    if len(whole) < BLOCK or len(source) < BLOCK:
        return _literal(source)
    old, new = np.frombuffer(whole, np.uint8), np.frombuffer(source, np.uint8)
    keys, offsets = np.unique(_block_keys(old, BLOCK), return_index=True)  # the first block of each key
    wanted = _block_keys(new, 1)
    slot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hits = np.flatnonzero(keys[slot] == wanted)
    places = offsets[slot[hits]] * BLOCK
    ops: list[Op] = []
    added = k = 0
    while k < len(hits):
        at, found = int(hits[k]), int(places[k])
        if found >= len(base) + at or whole[found : found + BLOCK] != source[at : at + BLOCK]:
            k += 1
            continue
        back = _common(new[added:at][::-1], old[:found][::-1])
        ahead = BLOCK + _common(new[at + BLOCK :], old[found + BLOCK :])
        ops += _literal(source[added : at - back])
        ops.append(Op("COPY", found - back, back + ahead, b""))
        added = at + ahead
        k = int(np.searchsorted(hits, added))
    return ops + _literal(source[added:])


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


_CODES = {"COPY": 0, "ADD": 1, "RUN": 2}


def pack(ops: list[Op]) -> bytes:
    return b"".join(_number(o.length << 2 | _CODES[o.op]) + (_number(o.offset) if o.op == "COPY" else o.data) for o in ops)


def unpack(delta: bytes) -> list[Op]:
    """Raises ValueError for bytes that are no delta."""
    ops, at = [], 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(delta):
                raise ValueError("the delta is cut off")
            n |= (delta[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if delta[at - 1] < 128:
                return n

    while at < len(delta):
        head = number()
        length, code = head >> 2, head & 3
        if code == 0:
            ops.append(Op("COPY", number(), length, b""))
            continue
        size = length if code == 1 else 1
        if code == 3 or at + size > len(delta):
            raise ValueError("the delta is damaged")
        ops.append(Op("ADD" if code == 1 else "RUN", 0, length, delta[at : at + size]))
        at += size
    return ops


def apply(base: bytes, ops: list[Op]) -> bytes:
    out = []
    for o in ops:
        if o.op == "COPY" and o.offset + o.length > len(base):
            raise ValueError("the delta copies from beyond the base")
        out.append(base[o.offset : o.offset + o.length] if o.op == "COPY" else o.data * (o.length if o.op == "RUN" else 1))
    return b"".join(out)


def encode(base: bytes, source: bytes) -> bytes:
    return pack(instructions(base, source))


def decode(base: bytes, delta: bytes) -> bytes:
    return apply(base, unpack(delta))


def merge(first: list[Op], second: list[Op]) -> list[Op]:
    """One delta for two: `first` makes an intermediate out of the base, `second` the result out of that."""
    starts = list(accumulate((o.length for o in first), initial=0))
    merged: list[Op] = []
    for o in second:
        if o.op != "COPY":
            merged.append(o)
            continue
        k = max(0, bisect_right(starts, o.offset) - 1)
        while k < len(first) and starts[k] < o.offset + o.length:
            f, start = first[k], starts[k]
            a, b = max(o.offset, start), min(o.offset + o.length, start + f.length)
            if a < b:
                merged.append(Op(f.op, f.offset + (a - start) * (f.op == "COPY"), b - a, f.data[a - start : b - start] if f.op == "ADD" else f.data))
            k += 1
    return merged


SECONDARY = {"none": (bytes, bytes), "zlib": (zlib.compress, zlib.decompress), "lzma": (lzma.compress, lzma.decompress)}


def delta_encode(base: Column, source: Column, secondary: str = "none") -> Column:
    """The delta that makes `source` out of `base`; null if one is null, the base is under 1024 or the source under 512 bytes, or the delta is larger than the source."""
    squeeze = SECONDARY[secondary][0]

    @F.arrow_udf("binary")
    def deltas(bases: pa.Array, sources: pa.Array) -> pa.Array:
        rows = []
        for b, s in zip(bases.to_pylist(), sources.to_pylist()):
            d = squeeze(encode(b, s)) if b is not None and s is not None and len(b) >= LEAST_BASE and len(s) >= LEAST_SOURCE else None
            rows.append(d if d is not None and len(d) <= len(s) else None)
        return pa.array(rows, pa.binary())

    return deltas(base, source)


def delta_decode(base: Column, delta: Column, secondary: str = "none") -> Column:
    """The source; null if one is null. A delta that doesn't fit raises."""
    expand = SECONDARY[secondary][1]

    @F.arrow_udf("binary")
    def sources(bases: pa.Array, deltas: pa.Array) -> pa.Array:
        return pa.array([None if b is None or d is None else decode(b, expand(d)) for b, d in zip(bases.to_pylist(), deltas.to_pylist())], pa.binary())

    return sources(base, delta)


def delta_merge(first: Column, second: Column) -> Column:
    """One delta for two: the second made of what the first makes; null if one is null."""

    @F.arrow_udf("binary")
    def merged(firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else pack(merge(unpack(a), unpack(b))) for a, b in zip(firsts.to_pylist(), seconds.to_pylist())], pa.binary())

    return merged(first, second)


def delta_instructions(delta: Column) -> Column:
    """array<struct<op, offset, length>>: what a delta does, to be exploded."""

    @F.arrow_udf("array<struct<op: string, offset: bigint, length: bigint>>")
    def listed(deltas: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("op", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        return pa.array([None if d is None else [{"op": o.op, "offset": o.offset, "length": o.length} for o in unpack(d)] for d in deltas.to_pylist()], kind)

    return listed(delta)
