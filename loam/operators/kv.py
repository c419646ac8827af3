"""A versioned key-value log as DataFrame operations: rows (key, seq, op, value), op PUT or DEL; the largest seq of a key holds."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class KV:
    """All methods are lazy and leave the log as it is; those that write return the longer log."""

    def __init__(self, log: DataFrame) -> None:
        self.log = log

    def _written(self, rows: DataFrame) -> KV:
        return KV(self.log.unionByName(rows))

    def put(self, rows: DataFrame) -> KV:
        """rows: key, seq, value."""
        return self._written(rows.select("key", "seq", F.lit("PUT").alias("op"), "value"))

    def delete(self, rows: DataFrame) -> KV:
        """rows: key, seq."""
        return self._written(rows.select("key", "seq", F.lit("DEL").alias("op"), F.lit(None).cast(self.log.schema["value"].dataType).alias("value")))

    def write(self, batch: DataFrame) -> KV:
        """A batch of PUT and DEL rows (key, seq, op, value), as one."""
        return self._written(batch.select("key", "seq", "op", "value"))

    def merged(self, as_of: int | None = None) -> DataFrame:
        """(key, seq, value) of every key that lives, of the whole log or its first part: overwritten and deleted values are gone.

        The newest version is an aggregate, so that a key with very many versions is reduced before the shuffle.
        """
        log = self.log if as_of is None else self.log.where(F.col("seq") <= as_of)
        newest = log.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("x"), F.max("seq").alias("seq"))
        return newest.where(F.col("x.op") == "PUT").select("key", "seq", F.col("x.value").alias("value"))

    def get(self, key: Any, as_of: int | None = None) -> DataFrame:
        """No or one row; the key's filter reaches the scan."""
        return KV(self.log.where(F.col("key") == F.lit(key))).merged(as_of)

    def get_all(self, keys: DataFrame, as_of: int | None = None) -> DataFrame:
        """(key, value) for each row of `keys` (key); value is null where there is none."""
        return keys.join(KV(self.log.join(keys, "key", "left_semi")).merged(as_of), "key", "left").select("key", "value")

    def scan(self, start: Any = None, end: Any = None, reverse: bool = False, as_of: int | None = None, limit: int | None = None, order: Column | None = None) -> DataFrame:
        """Living keys from start (incl.) to end (excl.), in order; a limit gives a top-k, not a sort."""
        part = KV(_ranged(self.log, start, end)).merged(as_of)
        by = F.col("key") if order is None else order
        part = part.orderBy(by.desc() if reverse else by.asc())
        return part if limit is None else part.limit(limit)

    def seek(self, target: Any, limit: int = 1, as_of: int | None = None) -> DataFrame:
        """The first living keys from `target` on."""
        return self.scan(start=target, limit=limit, as_of=as_of)

    def compact(self, start: Any = None, end: Any = None) -> KV:
        """The log without what no read sees, within a range of keys; outside it stays as it is. Snapshots before are lost there."""
        inside = KV(_ranged(self.log, start, end)).merged().select("key", "seq", F.lit("PUT").alias("op"), "value")
        outside = F.lit(False)
        if start is not None:
            outside |= F.col("key") < F.lit(start)
        if end is not None:
            outside |= F.col("key") >= F.lit(end)
        return KV(inside.unionByName(self.log.where(outside)))

    def write_compacted(self, path: str, start: Any = None, end: Any = None) -> None:
        """The compacted log as files sorted and ranged by key, of which point and range reads skip all but a few row groups."""
        self.compact(start, end).log.repartitionByRange("key").sortWithinPartitions("key", F.desc("seq")).write.mode("overwrite").parquet(path)

    def approximate_size(self, start: Any = None, end: Any = None) -> DataFrame:
        """Bytes of keys and values in a range, all versions."""
        size = F.octet_length(F.col("key").cast("string")) + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
        return _ranged(self.log, start, end).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("n_versions"))

    def properties(self) -> DataFrame:
        """Versions, keys, and deletions of the log."""
        return self.log.agg(F.count("*").alias("n_versions"), F.count_distinct("key").alias("n_keys"), F.count_if(F.col("op") == "DEL").alias("n_deletes"), F.max("seq").alias("last_seq"))


def _ranged(log: DataFrame, start: Any, end: Any) -> DataFrame:
    log = log if start is None else log.where(F.col("key") >= F.lit(start))
    return log if end is None else log.where(F.col("key") < F.lit(end))


def _probes(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    step = (hashes >> np.uint64(17)) | (hashes << np.uint64(47))
    return (hashes[:, None] + np.arange(k, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)


def bloom_build(keys: DataFrame, bits_per_key: int = 20, expected: int | None = None, max_bytes: int = 64 << 20) -> bytes:
    """A Bloom filter of the keys' 64-bit hashes.

    Each task sets bits in a filter of the final size, bounded by `max_bytes` (ValueError beyond), and holds no more; the parts are ORed in aggregates.
    """
    n = expected if expected is not None else keys.count()
    size = max(8, -(-n * bits_per_key // 8))
    if size > max_bytes:
        raise ValueError(f"a filter of {size} bytes is over {max_bytes}")
    k = max(1, min(30, int(bits_per_key * 0.69)))

    def local(batches):
        found = np.zeros(size, np.uint8)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                places = _probes(b.column(0).slice(at, 4096).to_numpy().view(np.uint64), size * 8, k).ravel()
                np.bitwise_or.at(found, (places >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (places & np.uint64(7)).astype(np.uint8))
        yield pa.record_batch([pa.array([0], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["g", "part"])

    def union(batches):
        found = np.zeros(size, np.uint8)
        for b in batches:
            for x in b.column(1).to_pylist():
                found |= np.frombuffer(x, np.uint8)
        yield pa.record_batch([pa.array([0], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["g", "part"])

    parts = keys.select(F.xxhash64("key").alias("h")).mapInArrow(local, "g int, part binary")
    whole = parts.coalesce(8).mapInArrow(union, "g int, part binary").coalesce(1).mapInArrow(union, "g int, part binary").first()["part"]
    return bytes([k]) + whole


def bloom_probe(keys: DataFrame, bloom: bytes) -> DataFrame:
    """`keys` with may_contain: false only for keys that were not put in."""
    k, bits = bloom[0], (len(bloom) - 1) * 8
    shared = keys.sparkSession.sparkContext.broadcast(bloom[1:])

    @F.arrow_udf("boolean")
    def probe(hashes: pa.Array) -> pa.Array:
        at = _probes(hashes.to_numpy(zero_copy_only=False).view(np.uint64), bits, k).astype(np.int64)
        bitmap = np.frombuffer(shared.value, np.uint8)
        return pa.array((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1))

    return keys.withColumn("may_contain", probe(F.xxhash64("key")))
