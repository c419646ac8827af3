"""Digests and keys as columns, and Rabin fingerprints."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fingerprint's irreducible polynomial, of degree 63, and its window. Fixed values.
POLYNOMIAL, WINDOW = 0xBFE6B8A5BF378D83, 48
DIGESTS = {"sha256": lambda c: F.sha2(c, 256), "sha1": F.sha1, "md5": F.md5}


def digest(data: Column, kind: str = "sha256") -> Column:
    """The hex digest of a BINARY column."""
    if kind not in DIGESTS:
        raise ValueError(f"no digest {kind!r}")
    return DIGESTS[kind](data)


def little_endian(number: Column) -> Column:
    """The 4 bytes of an INT, the lowest first."""
    h = F.lpad(F.hex(number.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def recipe_fingerprint(file_name: Column, user_id: Column) -> Column:
    """The hex key of a user's file: SHA-256 of the name and the user's number."""
    return F.sha2(F.concat(F.encode(file_name, "UTF-8"), little_endian(user_id)), 256)


def hex_dump(data: Column) -> Column:
    return F.lower(F.hex(data))


def index_key(fingerprint: Column, prefix: int = 1) -> Column:
    """The 33-byte key of an index entry (prefix 1) or recipe (0), of a hex fingerprint."""
    return F.concat(F.unhex(F.lit(f"{prefix:02X}")), F.unhex(fingerprint))


def poly_mod(a: int, p: int) -> int:
    """The remainder of polynomials over GF(2), as bit patterns."""
    while a.bit_length() >= p.bit_length():
        a ^= p << a.bit_length() - p.bit_length()
    return a


def poly_mul(a: int, b: int) -> int:
    found = 0
    while b:
        found ^= a * (b & 1)
        a, b = a << 1, b >> 1
    return found


def poly_mul_mod(a: int, b: int, p: int) -> int:
    return poly_mod(poly_mul(poly_mod(a, p), poly_mod(b, p)), p)


@cache
def _times(bytes_: int) -> np.ndarray:
    """[k][b]: byte b at place k of a number, as polynomial, times x to the power of 8 * `bytes_`."""
    tables = np.zeros((8, 256), np.uint64)
    for k in range(8):
        bit = [np.uint64(poly_mod(1 << 8 * (bytes_ + k) + j, POLYNOMIAL)) for j in range(8)]
        for j in range(8):  # sums of what the lower bits give
            tables[k, 1 << j : 2 << j] = tables[k, : 1 << j] ^ bit[j]
    return tables


def _later(f: np.ndarray, bytes_: int) -> np.ndarray:
    """The fingerprints with so many bytes of zero behind them."""
    digits = np.ascontiguousarray(f).view(np.uint8).reshape(-1, 8).T.astype(np.intp, order="C")
    found, part = np.zeros(len(f), np.uint64), np.empty(len(f), np.uint64)
    for table, at in zip(_times(bytes_), digits):
        found ^= np.take(table, at, out=part, mode="clip")
    return found


def rabin_fingerprints(data: np.ndarray) -> np.ndarray:
    """At each byte, the Rabin fingerprint, below 2^63, of the up to 48 bytes that end there.

    Windows of 16 bytes are put together out of halves, by shifts; 48 bytes are three of those.
    """
    f = np.concatenate([np.zeros(WINDOW - 1, np.uint64), data])
    for n in (1, 2, 4):
        f[n:] |= f[:-n] << np.uint64(8 * n)
    f ^= (f >> np.uint64(63)) * np.uint64(POLYNOMIAL)
    f[8:] ^= _later(f[:-8], 8)
    two, three = f.copy(), None
    two[16:] ^= _later(f[:-16], 16)
    three = two[32:] if len(two) > 32 else two[:0]
    return (three ^ _later(f[: len(three)], 32))[WINDOW - 1 - 32 :]


def rabin_key_of(data: bytes) -> bytes:
    """A 16-byte key that similar data is likely to share: the largest fingerprint, folded to 32 bits, four times."""
    top = int(rabin_fingerprints(np.frombuffer(data, np.uint8)).max(initial=0))
    return ((top ^ top >> 32) & 0xFFFFFFFF).to_bytes(4, "little") * 4


def _mapped(kind: str, arrow: pa.DataType, f):
    def column(data: Column) -> Column:
        @F.arrow_udf(kind)
        def apply(values: pa.Array) -> pa.Array:
            return pa.array([None if x is None else f(x) for x in values.to_pylist()], arrow)

        return apply(data)

    return column


#: Columns of BINARY columns: the key; the fingerprint of the last 48 bytes; a checksum. Null stays null.
rabin_key = _mapped("binary", pa.binary(), rabin_key_of)
rabin_fingerprint = _mapped("bigint", pa.int64(), lambda x: int(rabin_fingerprints(np.frombuffer(x[-WINDOW:], np.uint8))[-1:].sum()))
adler32 = _mapped("bigint", pa.int64(), zlib.adler32)


def cbc_zero_iv(data: Column, key: Column) -> Column:
    """AES-CBC with a zero IV of data whose length is a multiple of 16, without padding."""
    iv = F.unhex(F.lit("00" * 16))
    return F.substring(F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv), F.lit(17), F.octet_length(data))
