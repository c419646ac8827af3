"""Deltas in the generic format of RFC 3284 (VCDIFF), window by window, for exchange with other programs."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.delta import instructions

#: Fixed values of the format: magic and version, header and window indicators (the application header and the checksum are a widespread extension),
#: sizes of the two caches of addresses.
MAGIC = b"\xd6\xc3\xc4\0"
DECOMPRESS, CODETABLE, APPHEADER = 1, 2, 4
SOURCE, TARGET, ADLER32 = 1, 2, 4
NEAR, SAME = 4, 3
#: Bytes of the target that a window makes.
WINDOW = 8 << 20
_EXHAUSTED = object()


class Step(NamedTuple):
    """ADD (data), RUN (data of one byte, size) or COPY (size, address in the source segment followed by the target window)."""

    kind: str
    size: int
    data: bytes = b""
    address: int = 0


@dataclass
class Window:
    """The steps of a window; `source`: (size, place) of its segment of the base, or of the target before it if `of_target`."""

    steps: list[Step]
    source: tuple[int, int] | None = None
    of_target: bool = False
    adler: int | None = None

    @property
    def size(self) -> int:
        return sum(s.size for s in self.steps)


@dataclass
class Delta:
    windows: list[Window] = field(default_factory=list)
    app: bytes | None = None


@cache
def code_table() -> list[tuple[tuple[str, int, int], ...]]:
    """The default table: of each code one or two of (kind, size, mode); size 0: the size follows."""
    one = [("RUN", 0, 0)] + [("ADD", n, 0) for n in range(18)] + [("COPY", n, mode) for mode in range(2 + NEAR + SAME) for n in (0, *range(4, 19))]
    two = [(("ADD", a, 0), ("COPY", c, mode)) for mode in range(2 + NEAR) for a in range(1, 5) for c in range(4, 7)]
    two += [(("ADD", a, 0), ("COPY", 4, mode)) for mode in range(2 + NEAR, 2 + NEAR + SAME) for a in range(1, 5)]
    two += [(("COPY", 4, mode), ("ADD", 1, 0)) for mode in range(2 + NEAR + SAME)]
    return [(x,) for x in one] + two


@cache
def _codes() -> dict[tuple, int]:
    return {entry: i for i, entry in enumerate(code_table())}


def number(n: int) -> bytes:
    """Base 128, the highest first; all but the last byte have the top bit."""
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


class _Reader:
    """Bytes of a section; IndexError beyond its end."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def number(self) -> int:
        n = 0
        while True:
            b = self.byte()
            n = n << 7 | b & 127
            if b < 128:
                return n

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise IndexError("the delta is cut off")
        self.at += n
        return self.data[self.at - n : self.at]


class _Addresses:
    """The two caches of addresses, by which near and repeated ones are short."""

    def __init__(self) -> None:
        self.near, self.same, self.slot = [0] * NEAR, [0] * (SAME * 256), 0

    def _note(self, address: int) -> None:
        self.near[self.slot] = address
        self.slot = (self.slot + 1) % NEAR
        self.same[address % len(self.same)] = address

    def shortest(self, address: int, here: int) -> tuple[int, bytes]:
        """(mode, bytes)."""
        place = address % len(self.same)
        ways = [(0, number(address)), (1, number(here - address))]
        ways += [(2 + i, number(address - x)) for i, x in enumerate(self.near) if address >= x]
        if self.same[place] == address:
            ways.append((2 + NEAR + place // 256, bytes([place % 256])))
        self._note(address)
        return min(ways, key=lambda w: (len(w[1]), w[0]))

    def read(self, mode: int, here: int, r: _Reader) -> int:
        if mode < 2:
            address = r.number() if mode == 0 else here - r.number()
        elif mode < 2 + NEAR:
            address = self.near[mode - 2] + r.number()
        else:
            address = self.same[(mode - 2 - NEAR) * 256 + r.byte()]
        if not 0 <= address < here:
            raise ValueError("the delta copies from what isn't there")
        self._note(address)
        return address


def _packed(w: Window) -> bytes:
    """A window as bytes: of two steps that have a code together, one."""
    data, ops, places, cache_, here = [], [], [], _Addresses(), (w.source or (0, 0))[0]
    held: tuple[str, int, int] | None = None  # a step whose code isn't written yet

    def write(*steps: tuple[str, int, int]) -> None:
        known = _codes().get(steps)
        if known is None and len(steps) == 1:  # the size follows
            known = _codes()[(steps[0][0], 0, steps[0][2]),]
            ops.append(bytes([known]) + number(steps[0][1]))
        else:
            ops.append(bytes([known]))

    for s in w.steps:
        mode = 0
        if s.kind == "COPY":
            mode, place = cache_.shortest(s.address, here)
            places.append(place)
        else:
            data.append(s.data)
        own = (s.kind, s.size if s.kind != "RUN" else 0, mode)
        here += s.size
        if held is not None and (held, own) in _codes():
            write(held, own)
            held = None
            continue
        if held is not None:
            write(held)
            held = None
        if s.kind == "RUN":
            ops.append(bytes([0]) + number(s.size))
        else:
            held = own
    if held is not None:
        write(held)
    body = [b"".join(x) for x in (data, ops, places)]
    check = b"" if w.adler is None else w.adler.to_bytes(4, "big")
    whole = number(w.size) + b"\0" + b"".join(number(len(x)) for x in body) + check + b"".join(body)
    kind = (0 if w.source is None else TARGET if w.of_target else SOURCE) | (ADLER32 if w.adler is not None else 0)
    return bytes([kind]) + (number(w.source[0]) + number(w.source[1]) if w.source else b"") + number(len(whole)) + whole


def _head(app: bytes | None) -> bytes:
    return MAGIC + (b"\0" if app is None else bytes([APPHEADER]) + number(len(app)) + app)


def pack(delta: Delta) -> bytes:
    return _head(delta.app) + b"".join(map(_packed, delta.windows))


def _read_head(r: _Reader) -> bytes | None:
    if r.take(4) != MAGIC:
        raise ValueError("not a delta of this format")
    kind = r.byte()
    if kind & ~APPHEADER:
        raise ValueError("secondary compression and other code tables aren't supported")
    return r.take(r.number()) if kind & APPHEADER else None


def _read_window(r: _Reader) -> Window:
    kind = r.byte()
    if kind & ~(SOURCE | TARGET | ADLER32) or kind & SOURCE and kind & TARGET:
        raise ValueError("an unknown kind of window")
    source = (r.number(), r.number()) if kind & (SOURCE | TARGET) else None
    body = _Reader(r.take(r.number()))
    try:
        size = body.number()
        if body.byte():
            raise ValueError("secondary compression isn't supported")
        lengths = [body.number() for _ in range(3)]
        adler = int.from_bytes(body.take(4), "big") if kind & ADLER32 else None
        data, ops, places = (_Reader(body.take(n)) for n in lengths)
        table, cache_, steps, made, begin = code_table(), _Addresses(), [], 0, (source or (0, 0))[0]
        while ops.at < len(ops.data):
            for what, n, mode in table[ops.byte()]:
                n = n or ops.number()
                if what == "COPY":
                    steps.append(Step(what, n, b"", cache_.read(mode, begin + made, places)))
                elif n:
                    steps.append(Step(what, n, data.take(n if what == "ADD" else 1)))
                made += n
    except IndexError:
        raise ValueError("a window is cut off") from None
    if made != size or any(x.at != len(x.data) for x in (data, places, body)):
        raise ValueError("a window doesn't have the sizes that it says")
    return Window(steps, source, bool(kind & TARGET), adler)


def unpack(delta: bytes) -> Delta:
    """Raises ValueError for bytes that are no delta, and for secondary compression and other code tables."""
    r = _Reader(delta)
    try:
        found = Delta([], _read_head(r))
        while r.at < len(delta):
            found.windows.append(_read_window(r))
    except IndexError:
        raise ValueError("the delta is cut off") from None
    return found


def _made(w: Window, base: bytes, before: bytes) -> bytes:
    """The bytes that a window makes; `before`: the target up to it, if it copies from there."""
    n, at = w.source or (0, 0)
    of = before if w.of_target else base
    if at + n > len(of):
        raise ValueError("a window's source isn't there")
    out = bytearray(of[at : at + n])
    for s in w.steps:
        if s.kind != "COPY":
            out += s.data * (s.size if s.kind == "RUN" else 1)
        elif s.address + s.size <= len(out):
            out += out[s.address : s.address + s.size]
        else:  # it copies what it makes itself: a period that goes on
            period = bytes(out[s.address :])
            out += (period * -(-s.size // len(period)))[: s.size]
    target = bytes(out[n:])
    if w.adler is not None and zlib.adler32(target) != w.adler:
        raise ValueError("a window doesn't have its checksum")
    return target


def encode_stream(base: bytes, parts: Iterable[bytes], app: bytes | None = None, checksum: bool = True) -> Iterator[bytes]:
    """The delta that makes the bytes of `parts` out of `base`: the header, then a window for each part, which should be of bounded size.

    A window's segment is the part of the base that it copies from; matches are looked for in the base and in the window before a place.
    """
    yield _head(app)
    for part in parts:
        ops = instructions(base, part, within=True)
        own = [o for o in ops if o.op == "COPY" and o.offset < len(base)]
        first = min((o.offset for o in own), default=0)
        last = max((min(o.offset + o.length, len(base)) for o in own), default=0)
        steps = []
        for o in ops:
            if o.op != "COPY":
                steps.append(Step(o.op, o.length, o.data))
            elif o.offset >= len(base):
                steps.append(Step("COPY", o.length, b"", o.offset - len(base) + last - first))
            else:
                steps.append(Step("COPY", o.length, b"", o.offset - first))
        yield _packed(Window(steps, (last - first, first) if own else None, False, zlib.adler32(part) if checksum else None))


def decode_stream(base: bytes, parts: Iterable[bytes]) -> Iterator[bytes]:
    """The target, a window at a time, of a delta that comes in parts of any size; holds what came of a window that isn't whole yet.

    Raises ValueError for what is no delta, or cut off, and for windows that copy from the target before them, as that isn't kept (decode does it).
    """
    held, started, parts = b"", False, iter(parts)
    while True:
        part = next(parts, _EXHAUSTED)
        held += b"" if part is _EXHAUSTED else part
        while held or not started:
            r = _Reader(held)
            try:
                if not started:
                    _read_head(r)
                    started, held = True, held[r.at :]
                    continue
                window = _read_window(r)
            except IndexError:
                break
            if window.of_target:
                raise ValueError("a window copies from the target before it")
            held = held[r.at :]
            yield _made(window, base, b"")
        if part is _EXHAUSTED:
            if held or not started:
                raise ValueError("the delta is cut off")
            return


def encode(base: bytes, source: bytes, app: bytes | None = None, checksum: bool = True, window: int = WINDOW) -> bytes:
    return b"".join(encode_stream(base, (source[i : i + window] for i in range(0, len(source), window)), app, checksum))


def decode(base: bytes, delta: bytes) -> bytes:
    out = b""
    for w in unpack(delta).windows:
        out += _made(w, base, out if w.of_target else b"")
    return out


def recode(delta: bytes, app: bytes | None = None, checksum: bool = True) -> bytes:
    """The same windows, coded anew, with another application header (None: the same), and without checksums if `checksum` is false. Needs no base."""
    found = unpack(delta)
    if not checksum:
        for w in found.windows:
            w.adler = None
    return pack(Delta(found.windows, found.app if app is None else app))


def vcdiff_encode(base: Column, source: Column, app: Column | None = None) -> Column:
    """The delta, with an application header if `app` (BINARY) isn't null; null if base or source is null."""

    @F.arrow_udf("binary")
    def deltas(bases: pa.Array, sources: pa.Array, apps: pa.Array) -> pa.Array:
        rows = zip(bases.to_pylist(), sources.to_pylist(), apps.to_pylist())
        return pa.array([None if b is None or s is None else encode(b, s, a) for b, s, a in rows], pa.binary())

    return deltas(base, source, F.lit(None).cast("binary") if app is None else app)


def vcdiff_decode(base: Column, delta: Column) -> Column:
    """The source; null if one is null. A delta that doesn't fit raises."""

    @F.arrow_udf("binary")
    def sources(bases: pa.Array, deltas: pa.Array) -> pa.Array:
        return pa.array([None if b is None or d is None else decode(b, d) for b, d in zip(bases.to_pylist(), deltas.to_pylist())], pa.binary())

    return sources(base, delta)


def vcdiff_header(delta: Column) -> Column:
    """struct<app, windows: array<struct<size, source_size, source_place, adler32, n_add, n_run, n_copy>>> of a delta, for listings."""

    @F.arrow_udf("struct<app: binary, windows: array<struct<size: bigint, source_size: bigint, source_place: bigint, adler32: bigint, n_add: int, n_run: int, n_copy: int>>>")
    def heads(deltas: pa.Array) -> pa.Array:
        rows = []
        for d in deltas.to_pylist():
            if d is None:
                rows.append(None)
                continue
            found = unpack(d)
            count = lambda w, kind: sum(s.kind == kind for s in w.steps)
            rows.append({"app": found.app, "windows": [{"size": w.size, "source_size": (w.source or (0, 0))[0], "source_place": (w.source or (0, 0))[1], "adler32": w.adler, "n_add": count(w, "ADD"), "n_run": count(w, "RUN"), "n_copy": count(w, "COPY")} for w in found.windows]})
        longs = [(c, pa.int64()) for c in ("size", "source_size", "source_place", "adler32")]
        return pa.array(rows, pa.struct([("app", pa.binary()), ("windows", pa.list_(pa.struct([*longs, *((c, pa.int32()) for c in ("n_add", "n_run", "n_copy"))])))]))

    return heads(delta)
