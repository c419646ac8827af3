"""Sharding by jump consistent hashing, and gapless slots within shards, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import table

#: The multiplier of the published algorithm (Lamping and Veach, "A fast, minimal memory, consistent hash algorithm"): a fixed value.
MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def _next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2^64, of parts that can't overflow: ANSI arithmetic would raise."""
    low, high = key.bitwiseAND(_LOW), F.shiftrightunsigned(key, 32)
    c0, c1, c_high = MULTIPLIER & 0xFFFF, MULTIPLIER >> 16 & 0xFFFF, MULTIPLIER >> 32
    p0, p1 = low * c0, low * c1
    first = p0.bitwiseAND(_LOW) + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + 1
    cross = lambda x, c: x * (c & 0xFFFF) + F.shiftleft((x * (c >> 16)).bitwiseAND(0xFFFF), 16)  # noqa: E731  x * c modulo 2^32, before masking
    second = F.shiftright(p0, 32) + F.shiftright(p1, 16) + F.shiftright(first, 32) + cross(low, c_high).bitwiseAND(_LOW) + cross(high, MULTIPLIER & _LOW).bitwiseAND(_LOW)
    return F.shiftleft(second.bitwiseAND(_LOW), 32).bitwiseOR(first.bitwiseAND(_LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a BIGINT key: with one shard more, a key stays or goes to the new one. Null keys go where 0 goes."""
    if shards < 1:
        raise ValueError("there must be a shard")

    def jumps(most: int) -> Column:
        def step(s: Column, _: Column) -> Column:
            key = _next_key(s["key"])
            ahead = F.floor((s["next"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(key, 33) + 1).cast("double")))
            moved = F.struct(key.alias("key"), s["next"].alias("shard"), ahead.cast("long").alias("next"))
            return F.when(s["next"] < shards, moved).otherwise(s)

        start = F.struct(F.coalesce(key, F.lit(0)).cast("long").alias("key"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)

    # each jump goes at least one shard ahead, and about ln(shards) jumps are made: more than 64 hardly ever
    short = jumps(min(shards, 64))
    return (short if shards <= 64 else F.when(short["next"] >= shards, short).otherwise(jumps(shards)))["shard"].cast("int")


def stable_key(docs: DataFrame, id_col: str) -> Column:
    """An integer id itself; of other ids a 64-bit hash."""
    kind = docs.schema[id_col].dataType.typeName()
    return F.col(id_col).cast("long") if kind in ("byte", "short", "integer", "long") else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))


def add_shard(docs: DataFrame, shards: int, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """`docs` with its shard, 0 to `shards` - 1, as an INT column, without a shuffle; a column of that name is replaced."""
    return docs.withColumn(name, jump_hash(stable_key(docs, id_col), shards))


def _bucket(buckets: int) -> Column:
    """A number below `buckets` of a row's id, size and CRC, null ids as such."""
    text = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("size"), F.col("crc"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets


def slots(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) of every row of `docs`.

    size: UTF-8 bytes of the text plus 1; a null text has none, and the CRC of no bytes, 0. slot: from 0 without gaps within a shard. grown_shard: the
    shard with one shard more. Equal rows have one shard and different slots; rows with equal texts but different ids aren't kept together, as the id
    alone decides. Null ids: as jump_hash. Other columns are not read. No rows: no rows.

    A shard is cut into `buckets` by hash. Rows are counted by distinct (id, size, CRC), combined before the shuffle, and slots run over those counts,
    so that neither a shard nor a row that comes often is one task's work; the offsets of the buckets are `shards` * `buckets` numbers at most.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = stable_key(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), key.alias("key"))
    entries = rows.groupBy("id", "size", "crc", "key").agg(F.count("*").alias("n"))
    entries = entries.select("*", jump_hash(F.col("key"), shards).alias("shard"), _bucket(buckets).alias("bucket"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = entries.groupBy("shard", "bucket").agg(F.sum("n").alias("n")).select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.sum("n").over(Window.partitionBy("shard", "bucket").orderBy("id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1))
    placed = entries.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(offsets), ["shard", "bucket"])
    million = 1_000_000  # a row that comes often is spread out in steps
    steps = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(million).cast("long"))))
    each = steps.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (million - 1), F.col("n") - 1))))
    return each.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("within") + F.col("k")).alias("slot"), jump_hash(F.col("key"), shards + 1).alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards; see slots."""
    return slots(table(spark, sf_dir, "documents"), 16).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op6_sharding": op6_sharding}
_JUMPS = """SELECT doc_id, size, crc, doc_id::HUGEINT AS key, -1::BIGINT AS shard, 0::BIGINT AS ahead FROM c
      UNION ALL
      SELECT doc_id, size, crc, key, ahead, floor((ahead + 1)::DOUBLE * (2147483648.0::DOUBLE / ((key // 8589934592) + 1)::DOUBLE))::BIGINT
      FROM (SELECT * REPLACE ((key * {0} + 1) % 18446744073709551616 AS key) FROM {1}) WHERE ahead < {2}"""
#: CRC-32 by the remainders of the 256 bytes; jumps of equal rows are made once.
ORACLE_SQL: dict[str, str] = {
    "op6_sharding": f"""WITH RECURSIVE r AS (SELECT x, x::BIGINT AS v, 0 AS k FROM unnest(range(0, 256)) AS u(x) UNION ALL SELECT x, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM r WHERE k < 8),
t AS (SELECT list(v ORDER BY x) AS t FROM r WHERE k = 8),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
e AS (SELECT doc_id, octet_length(b)::BIGINT + 1 AS size, xor(list_reduce(list_transform(range(0, octet_length(b)), lambda i: ('0x' || hex(b[i + 1 : i + 1]))::BIGINT), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS crc FROM d, t),
c AS (SELECT DISTINCT doc_id, size, crc FROM e),
g AS ({_JUMPS.format(MULTIPLIER, "g", 16)}),
h AS ({_JUMPS.format(MULTIPLIER, "h", 17)}),
s AS (SELECT e.doc_id, e.size, e.crc, g.shard, h.shard AS grown, ('0x' || substr(md5(e.doc_id || '|' || e.size || '|' || e.crc), 1, 8))::BIGINT % 1024 AS bucket
      FROM e JOIN g ON e.doc_id = g.doc_id AND e.size = g.size AND e.crc = g.crc AND g.ahead >= 16 JOIN h ON e.doc_id = h.doc_id AND e.size = h.size AND e.crc = h.crc AND h.ahead >= 17)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, crc) - 1 AS slot, grown::INTEGER AS grown_shard FROM s"""
}
