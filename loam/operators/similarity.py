"""Bases for delta compression: which earlier share is similar to a share, and storing the difference.

Rows are unique shares: cloud, share_fp, seq, secret_id, share_size and features (struct of sf1, sf2, sf3).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import delta as D
from loam.functions.delta import delta_decode, delta_encode

SLOTS = ("sf1", "sf2", "sf3")


def last_bases(shares: DataFrame) -> DataFrame:
    """`shares` with candidate and slot: of the features in turn, the first that an earlier share had, and the last such share.

    As an index would answer whose entries the last writer holds. A feature's shares are ordered by one task; shares without a feature are spread out.
    """
    found = shares
    for s in SLOTS:
        alone = F.when(F.col(f"features.{s}").isNull(), F.col("share_fp"))
        earlier = Window.partitionBy("cloud", f"features.{s}", alone).orderBy("seq", "secret_id").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn(f"_{s}", F.when(F.col(f"features.{s}").isNotNull(), F.last_value("share_fp").over(earlier)))
    return _chosen(found)


def _spread(column: str) -> Column:
    """A column to join on of which many rows are null: each null is a value of its own that joins nothing, so that they don't meet in one task."""
    return F.coalesce(F.col(column), F.concat(F.lit("-"), F.col("share_fp")))


def _chosen(found: DataFrame) -> DataFrame:
    slot = F.coalesce(*[F.when(F.col(f"_{s}").isNotNull(), F.lit(i)) for i, s in enumerate(SLOTS, 1)])
    return found.withColumns({"candidate": F.coalesce(*[F.col(f"_{s}") for s in SLOTS]), "slot": slot}).drop(*[f"_{s}" for s in SLOTS])


def first_bases(shares: DataFrame) -> DataFrame:
    """`shares` with candidate and slot: of the features in turn, the first that an earlier share had, and the first share with it.

    Set-oriented: an aggregate for each feature, joined back; a feature that very many shares have is reduced before the shuffle.
    """
    found = shares
    for s in SLOTS:
        feature = F.col(f"features.{s}")
        first = shares.where(feature.isNotNull()).groupBy("cloud", feature.alias("_f")).agg(F.min(F.struct("seq", "secret_id", "share_fp")).alias("_first"))
        joined = found.withColumn("_f", feature).join(first, ["cloud", "_f"], "left")
        own = F.when(F.struct("_first.seq", "_first.secret_id") < F.struct("seq", "secret_id"), F.col("_first.share_fp"))
        found = joined.withColumn(f"_{s}", own).drop("_f", "_first")
    return _chosen(found).select(*shares.columns, "candidate", "slot")


def select_bases(shares: DataFrame, policy: str = "first_seen") -> DataFrame:
    """`shares` with base_fp and slot, null where there is no base. first_seen: the candidate of first_bases, if it has no candidate itself and so is stored whole."""
    if policy != "first_seen":
        raise ValueError(f"no policy {policy!r} here; see strict_deltas")
    found = first_bases(shares)
    roots = found.where(F.col("candidate").isNull()).select(F.col("cloud").alias("_cloud"), F.col("share_fp").alias("base_fp"))
    joined = found.join(roots, (F.col("cloud") == F.col("_cloud")) & (_spread("candidate") == F.col("base_fp")), "left")
    return joined.select(*shares.columns, "base_fp", F.when(F.col("base_fp").isNotNull(), F.col("slot")).alias("slot"))


def feature_index(shares: DataFrame) -> DataFrame:
    """(cloud, slot, sf, share_fp, seq): the last share of each feature."""
    each = shares.select("cloud", "share_fp", "seq", "secret_id", F.posexplode(F.array(*[F.col(f"features.{s}") for s in SLOTS])).alias("slot", "sf")).where("sf is not null")
    last = each.groupBy("cloud", (F.col("slot") + 1).alias("slot"), "sf").agg(F.max(F.struct("seq", "secret_id", "share_fp")).alias("x"))
    return last.select("cloud", "slot", "sf", "x.share_fp", "x.seq")


def with_deltas(shares: DataFrame, data: DataFrame, secondary: str = "none") -> DataFrame:
    """Rows of select_bases as they are stored: delta_depth, delta_size (null if whole), base_fp, stored (the bytes); data: (cloud, share_fp, data).

    Sizes are judged before bytes are fetched, and only bytes of shares that are a base are fetched as such.
    """
    sizes = shares.select(F.col("cloud").alias("_c"), F.col("share_fp").alias("_b"), F.col("share_size").alias("base_size"))
    judged = shares.join(sizes, (F.col("cloud") == F.col("_c")) & (_spread("base_fp") == F.col("_b")), "left").drop("_c", "_b")
    fit = (F.col("base_size") >= D.LEAST_BASE) & (F.col("share_size") >= D.LEAST_SOURCE)
    judged = judged.withColumn("base_fp", F.when(fit, F.col("base_fp"))).drop("base_size").join(data, ["cloud", "share_fp"])
    wanted = judged.where("base_fp is not null").select("cloud", F.col("base_fp").alias("share_fp")).distinct()
    base = data.join(wanted, ["cloud", "share_fp"], "left_semi").select(F.col("cloud").alias("_c"), F.col("share_fp").alias("_b"), F.col("data").alias("base_data"))
    joined = judged.join(base, (F.col("cloud") == F.col("_c")) & (_spread("base_fp") == F.col("_b")), "left")
    every = joined.withColumn("delta", delta_encode(F.col("base_data"), F.col("data"), secondary))
    is_delta = F.col("delta").isNotNull()
    return every.select(
        *[c for c in shares.columns if c not in ("base_fp", "slot")],
        F.when(is_delta, 1).otherwise(0).alias("delta_depth"),
        F.octet_length("delta").cast("long").alias("delta_size"),
        F.when(is_delta, F.col("base_fp")).alias("base_fp"),
        F.coalesce("delta", "data").alias("stored"),
    )


def resolve_deltas(stored: DataFrame, max_depth: int = 1, secondary: str = "none") -> DataFrame:
    """(cloud, share_fp, data) of stored rows (cloud, share_fp, base_fp, delta_depth, stored): each level of deltas is decoded on the level below."""
    whole = stored.where("delta_depth = 0").select("cloud", "share_fp", F.col("stored").alias("data"))
    done = level = whole
    for depth in range(1, max_depth + 1):
        below = level.select(F.col("cloud").alias("_c"), F.col("share_fp").alias("_b"), F.col("data").alias("base_data"))
        own = stored.where(F.col("delta_depth") == depth).join(below, (F.col("cloud") == F.col("_c")) & (F.col("base_fp") == F.col("_b")))
        level = own.select("cloud", "share_fp", delta_decode(F.col("base_data"), F.col("stored"), secondary).alias("data"))
        done = done.unionByName(level)
    return done


def strict_deltas(shares: DataFrame, by: list[str] | None = None, max_depth: int = 1) -> DataFrame:
    """(cloud, share_fp, base_fp, delta_depth, delta_size, stored) as a server gives that takes shares one by one: rows need data too.

    A share's base is the last earlier one with its sf1, else sf2, else sf3, whether usable or not; features are noted even of shares stored as deltas.
    Each answer depends on all before, so a group (`by`, a cloud) is one task's work, which holds the group's bytes: a mode to compare with such a server
    on tables of its size. select_bases is the parallel way.
    """

    def fold(group: pa.Table) -> pa.Table:
        last: dict[tuple, str] = {}
        kept: dict[str, tuple[bytes, int]] = {}
        out = []
        for r in group.sort_by([("seq", "ascending"), ("secret_id", "ascending")]).to_pylist():
            f, data = r["features"], r["data"]
            base = next((last[s, f[s]] for s in SLOTS if f and (s, f[s]) in last), None)
            body, depth = None, 0
            if base is not None and kept[base][1] < max_depth and len(kept[base][0]) >= D.LEAST_BASE and len(data) >= D.LEAST_SOURCE:
                body = D.encode(kept[base][0], data)
                body = body if len(body) <= len(data) else None
            if body is not None:
                depth = kept[base][1] + 1
            kept[r["share_fp"]] = data, depth
            last |= {(s, f[s]): r["share_fp"] for s in SLOTS} if f else {}
            out.append((r["cloud"], r["share_fp"], base if depth else None, depth, len(body) if depth else None, body if depth else data))
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["cloud", "share_fp", "base_fp", "delta_depth", "delta_size", "stored"])

    rows = shares.select("cloud", "share_fp", "seq", "secret_id", "features", "data", *[c for c in by or [] if c != "cloud"])
    return rows.groupBy(*(by or ["cloud"])).applyInArrow(fold, "cloud int, share_fp string, base_fp string, delta_depth int, delta_size bigint, stored binary")


def chains(stored: DataFrame, max_depth: int = 8) -> DataFrame:
    """(cloud, share_fp, root_fp, steps): the whole share at the end of each share's bases."""
    links = stored.select(F.col("cloud").alias("_c"), F.col("share_fp").alias("_s"), F.col("base_fp").alias("_n"))
    at = stored.select("cloud", "share_fp", F.coalesce("base_fp", "share_fp").alias("root_fp"), F.when(F.col("base_fp").isNull(), 0).otherwise(1).alias("steps"))
    for _ in range(max_depth - 1):
        at = at.join(links, (F.col("cloud") == F.col("_c")) & (F.col("root_fp") == F.col("_s")), "left")
        at = at.select("cloud", "share_fp", F.coalesce("_n", "root_fp").alias("root_fp"), (F.col("steps") + F.when(F.col("_n").isNull(), 0).otherwise(1)).alias("steps"))
    return at
