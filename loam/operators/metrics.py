"""Counters and reports."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.layout import ENTRY_BYTES, RECIPE_HEAD
from loam.functions.text import percent


def _sum(value: Column, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long")


def dedup_report(shares: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, whole percentages and bytes of classified shares (dup_class, and optionally delta_size), as one row or a row for each group."""
    kind = F.col("dup_class")
    delta = F.col("delta_size") if "delta_size" in shares.columns else F.lit(None).cast("long")
    as_delta = (kind == "new") & delta.isNotNull()
    size = F.col("share_size")
    counts = shares.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if((kind == "new") & delta.isNull()).alias("n_unique"),
        F.count_if(kind != "new").alias("duplicate"),
        F.count_if(kind == "intra").alias("intra_dup"),
        F.count_if(kind == "inter").alias("inter_dup"),
        F.count_if(as_delta).alias("delta"),
        _sum(F.col("secret_size"), F.lit(True)).alias("secret_bytes"),
        (_sum(size, (kind == "new") & delta.isNull()) + _sum(delta, as_delta)).alias("share_bytes"),
        _sum(size, kind != "new").alias("dedup_bytes"),
        _sum(size - delta, as_delta).alias("delta_saved"),
    )
    ratios = {f"{c}_pct": percent(F.col(c), F.col("total")) for c in ("n_unique", "duplicate", "delta")}
    return counts.withColumns(ratios)


def recipe_bytes(files: Column, shares: Column) -> Column:
    """Bytes of the recipes of so many files with so many shares in all."""
    return (files * RECIPE_HEAD.size + shares * ENTRY_BYTES).cast("long")


def client_report(shares: DataFrame, seconds: float | None = None) -> DataFrame:
    """Total, sent and zero bytes of first-stage shares (share_size, owned, is_zero), and bytes a second if a time is given."""
    out = shares.agg(F.sum("share_size").alias("total_bytes"), _sum(F.col("share_size"), ~F.col("owned")).alias("unique_bytes"), _sum(F.col("share_size"), F.col("is_zero")).alias("zero_bytes"))
    return out if seconds is None else out.withColumn("bytes_per_s", F.col("total_bytes") / seconds)


class Laps:
    """Seconds by name, added up over `with laps("name")` blocks; one name at a time."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str):
        began = time.perf_counter()
        try:
            yield self
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
