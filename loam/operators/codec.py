"""Convergent dispersal: a secret into n shares of which any k give it back, and all shares of equal secrets are equal.

AES runs in Spark's own function; the XOR, hashes and finite-field products of a row run in Arrow UDFs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import gf256
from loam.functions.hashing import cbc_zero_iv, rabin_key, rabin_key_of

#: Each codec: what its key is made of, what is encrypted with the key (a ramp of bytes, or the words' numbers), and what its tail hashes.
KINDS = {
    "caont": ("rabin", "ramp", "rabin"),
    "caont_name": ("hash", "ramp", "hash"),
    "caont_old": ("hash", "words", "hash"),
    "aont": ("seed", "words", "hash"),
    "crsss": None,
    "none": None,
}


@dataclass(frozen=True)
class CodecSpec:
    """kind; n shares, m of which may be lost; r hashes in a group (crsss); security `low` (128 bits, MD5) or `high` (256 bits, SHA-256); seed (aont)."""

    kind: str = "caont"
    n: int = 4
    m: int = 1
    r: int = 2
    security: str = "low"
    seed: int = 0

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"no codec {self.kind!r}")
        if not 0 < self.m < self.n <= 128 or self.security not in ("low", "high") or self.kind == "crsss" and not 0 < self.r < self.k:
            raise ValueError("0 < m < n, and for crsss 0 < r < k, must hold")

    @property
    def k(self) -> int:
        return self.n - self.m

    @property
    def word(self) -> int:
        return 16 if self.security == "low" else 32

    def digest(self, data: bytes) -> bytes:
        return (hashlib.md5 if self.security == "low" else hashlib.sha256)(data).digest()

    def matrix(self) -> np.ndarray:
        return gf256.cauchy_full(self.n, self.k) if self.kind == "crsss" else gf256.cauchy_rs(self.n, self.k)


def aligned_size(size: Column, spec: CodecSpec) -> Column:
    """To which length a secret is filled up with zeros."""
    w, wk = spec.word, spec.word * spec.k
    if spec.kind == "crsss":
        group = w * (spec.k - spec.r)
        return (F.ceil(size / group) * group).cast("int")
    return F.when((size + w) % wk == 0, size).otherwise((F.floor((size + w) / wk) + 1) * wk - w).cast("int")


def share_size(size: Column, spec: CodecSpec) -> Column:
    aligned = aligned_size(size, spec)
    if spec.kind == "crsss":
        return (aligned / (spec.k - spec.r)).cast("int")
    return ((aligned + spec.word) / spec.k).cast("int")


def _filled(data: Column, spec: CodecSpec) -> Column:
    more = aligned_size(F.octet_length(data), spec) - F.octet_length(data)
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), more)))


def _keystream(key: Column, size: Column, spec: CodecSpec) -> Column:
    if KINDS[spec.kind][1] == "ramp":
        ramp = F.substring(F.unhex(F.repeat(F.lit(bytes(range(256)).hex()), F.ceil(size / 256).cast("int"))), F.lit(1), size)
        return cbc_zero_iv(ramp, key)
    wide = spec.word == 32

    @F.arrow_udf("binary")
    def numbers(sizes: pa.Array) -> pa.Array:
        rows = []
        for n in sizes.to_pylist():
            words = np.zeros((n // spec.word, 4), np.uint32)
            words[:, 0] = np.arange(len(words))
            rows.append(words.tobytes())
        return pa.array(rows, pa.binary())

    blocks = numbers(size)  # the first 16 bytes of each number's word
    ecb = lambda data: F.substring(F.aes_encrypt(data, key, F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.octet_length(data))
    first = ecb(blocks)
    if not wide:
        return first

    @F.arrow_udf("binary")
    def interleaved(a: pa.Array, b: pa.Array) -> pa.Array:
        both = ((np.frombuffer(x, np.uint8).reshape(-1, 16), np.frombuffer(y, np.uint8).reshape(-1, 16)) for x, y in zip(a.to_pylist(), b.to_pylist()))
        return pa.array([np.concatenate(x, axis=1).tobytes() for x in both], pa.binary())

    return interleaved(first, ecb(first))


def _tail(main: bytes, spec: CodecSpec) -> bytes:
    return rabin_key_of(main) * (spec.word // 16) if KINDS[spec.kind][2] == "rabin" else spec.digest(main)


def _xor(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).tobytes()


def _key(filled: Column, name: Column | None, spec: CodecSpec) -> Column:
    kind = KINDS[spec.kind][0]
    hashed = lambda c: F.unhex(F.md5(c) if spec.security == "low" else F.sha2(c, 256))
    if kind == "rabin":
        return rabin_key(filled) if spec.security == "low" else F.concat(rabin_key(filled), rabin_key(filled))
    return hashed(filled) if kind == "hash" else hashed(F.encode(F.concat_ws("|", F.lit(str(spec.seed)), name), "UTF-8"))


def _groups(filled: bytes, spec: CodecSpec) -> np.ndarray:
    """crsss: the k data blocks; column i holds the words and hashes of group i."""
    w, own = spec.word, spec.k - spec.r
    n, hashed = w * own, hashlib.md5 if spec.security == "low" else hashlib.sha256
    words = np.frombuffer(filled, np.uint8).reshape(-1, own, w).transpose(1, 0, 2).reshape(own, -1)
    groups = [filled[i : i + n] for i in range(0, len(filled), n)]

    def row(j: int) -> bytes:
        end = bytes([j])
        return b"".join([hashed(g + end).digest() for g in groups])

    hashes = np.frombuffer(b"".join(row(j) for j in range(spec.r)), np.uint8).reshape(spec.r, -1)
    return np.concatenate([words, hashes])


def encode_shares(secrets: DataFrame, spec: CodecSpec = CodecSpec()) -> DataFrame:
    """A row for each share of each secret (a row with `data`): cloud, share_size, and data, the share's; other columns stay.

    aont makes its keys of the seed and the place of a secret (file_name, secret_id), so that equal secrets have different shares.
    """
    matrix, parity = spec.matrix(), spec.matrix()[spec.k :]
    rest = [c for c in secrets.columns if c != "data"]
    filled = secrets.withColumn("_a", _filled(F.col("data"), spec))
    if KINDS[spec.kind]:
        name = F.concat_ws("|", "file_name", F.col("secret_id").cast("string")) if KINDS[spec.kind][0] == "seed" else None
        filled = filled.withColumn("_key", _key(F.col("_a"), name, spec))
        filled = filled.withColumn("_ks", _keystream(F.col("_key"), F.octet_length("_a"), spec))
    else:
        filled = filled.withColumns({"_key": F.lit(b""), "_ks": F.lit(b"")})

    @F.arrow_udf("array<binary>")
    def shares(data: pa.Array, streams: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for a, ks, key in zip(data.to_pylist(), streams.to_pylist(), keys.to_pylist()):
            if spec.kind == "crsss":
                out.append([x.tobytes() for x in gf256.times(matrix, _groups(a, spec))] if a else [b""] * spec.n)
                continue
            if spec.kind == "none":
                package = a + b"\x01".ljust(spec.word, b"\0")
            else:
                main = _xor(a, ks)
                package = main + _xor(_tail(main, spec), key)
            blocks = np.frombuffer(package, np.uint8).reshape(spec.k, -1)
            out.append([x.tobytes() for x in [*blocks, *gf256.times(parity, blocks)]])
        return pa.array(out, pa.list_(pa.binary()))

    each = filled.select(*rest, F.posexplode(shares(F.col("_a"), F.col("_ks"), F.col("_key"))).alias("cloud", "data"))
    return each.select(*rest, "cloud", F.octet_length("data").alias("share_size"), "data")


def decode_shares(shares: DataFrame, by: list[str], spec: CodecSpec = CodecSpec(), clouds: list[int] | None = None) -> DataFrame:
    """(by, secret_size, data): the secrets out of their shares (by, secret_size, cloud, data) in k clouds, 0 to k - 1 by default.

    `by` has to tell secrets apart. Raises, when it is run, if a share is missing, or a secret isn't what its key says (codecs other than aont).
    """
    if spec.kind == "none":
        raise ValueError("shares of `none` aren't meant to be decoded")
    clouds = sorted(clouds if clouds is not None else range(spec.k))
    if len(set(clouds)) != spec.k or not all(0 <= c < spec.n for c in clouds):
        raise ValueError(f"{spec.k} different clouds of {spec.n} are needed")
    undo = gf256.invert(spec.matrix()[clouds])
    chosen = shares.where(F.col("cloud").isin(clouds)).groupBy(*by, "secret_size").agg(F.array_sort(F.collect_list(F.struct("cloud", "data"))).alias("s"))
    chosen = chosen.withColumn("s", F.when(F.size("s") == spec.k, F.col("s.data")).otherwise(F.raise_error(F.lit("a share is missing")).cast("array<binary>")))

    @F.arrow_udf("struct<main: binary, key: binary>")
    def package(groups: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = []
        for g, size in zip(groups.to_pylist(), sizes.to_pylist()):
            if not g[0]:
                rows.append({"main": b"", "key": b""})
                continue
            blocks = gf256.times(undo, np.stack([np.frombuffer(x, np.uint8) for x in g]))
            if spec.kind == "crsss":
                own, w = spec.k - spec.r, spec.word
                words = blocks[:own].reshape(own, -1, w).transpose(1, 0, 2)
                secret = np.ascontiguousarray(words).tobytes()
                if (_groups(secret, spec) != blocks).any():
                    raise ValueError("a group's hashes don't match it")
                rows.append({"main": secret, "key": b""})
            else:
                data = blocks.tobytes()
                main = data[: -spec.word]
                rows.append({"main": main, "key": _xor(data[-spec.word :], _tail(main, spec))})
        return pa.array(rows, pa.struct([("main", pa.binary()), ("key", pa.binary())]))

    opened = chosen.withColumn("_p", package(F.col("s"), F.col("secret_size"))).drop("s")
    if spec.kind == "crsss":
        return opened.select(*by, "secret_size", F.substring(F.col("_p.main"), F.lit(1), F.col("secret_size")).alias("data"))
    opened = opened.withColumn("_ks", _keystream(F.col("_p.key"), F.octet_length("_p.main"), spec))
    source = KINDS[spec.kind][0]

    @F.arrow_udf("binary")
    def secret(mains: pa.Array, streams: pa.Array, keys: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = []
        for main, ks, key, size in zip(mains.to_pylist(), streams.to_pylist(), keys.to_pylist(), sizes.to_pylist()):
            filled = _xor(main, ks)
            if source != "seed" and key != (rabin_key_of(filled) * (spec.word // 16) if source == "rabin" else spec.digest(filled)):
                raise ValueError("a secret doesn't match its key")
            rows.append(filled[:size])
        return pa.array(rows, pa.binary())

    return opened.select(*by, "secret_size", secret(F.col("_p.main"), F.col("_ks"), F.col("_p.key"), F.col("secret_size")).alias("data"))


def encode_names(files: DataFrame, spec: CodecSpec = CodecSpec("caont_name")) -> DataFrame:
    """(file_name, cloud, share): the name under which each cloud knows a file; equal names have equal shares."""
    names = files.select("file_name").distinct().withColumn("data", F.concat(F.encode("file_name", "UTF-8"), F.unhex(F.lit("00"))))
    return encode_shares(names, spec).select("file_name", "cloud", F.lower(F.hex("data")).alias("share"))
