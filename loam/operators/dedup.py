"""Two-stage deduplication: who owns a share, who else has it, and the share index.

A share is a row with cloud, share_fp, user_id, file_name, seq (order of files), secret_id and share_size. Payloads stay out: aggregates and joins carry
fingerprints only. A fingerprint that comes very often, as of zeros, meets its other rows in aggregates, which are combined before the shuffle, and in
joins, which adaptive execution may split; no window runs over all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["cloud", "share_fp"]


def place() -> Column:
    """The order in which shares arrive, as one number: its minimum needs no sort, as that of a struct would."""
    return _numbered("seq", "secret_id")


def _numbered(high: str, low: str) -> Column:
    return F.col(high).cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(low).cast("decimal(10,0)")


def fingerprint(data: Column) -> Column:
    """SHA-256 as text. Never null, which spares joins on it a filter that would hash all data once more."""
    return F.coalesce(F.sha2(data, 256), F.lit(""))


def plain_shares(secrets: DataFrame) -> DataFrame:
    """Chunks as shares of a single cloud, without coding."""
    return secrets.select(F.lit(0).alias("cloud"), fingerprint(F.col("data")).alias("share_fp"), "user_id", "file_name", "seq", "file_size", "secret_id", "secret_size", F.col("secret_size").alias("share_size"), "is_last")


def classify(shares: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """`shares` with dup_class: `new` for the first of a fingerprint, `intra` if its user had it before, else `inter`.

    owners: (cloud, share_fp, user_id) of what was there before all of `shares`; rows may repeat.
    """
    places = shares.select(*KEY, "user_id", place().alias("_p"))
    if owners is not None:
        places = places.unionByName(owners.select(*KEY, "user_id", F.lit(-1).cast(places.schema["_p"].dataType).alias("_p")))
    by_user = places.groupBy(*KEY, "user_id").agg(F.min("_p").alias("first_user"))
    first = by_user.groupBy(*KEY).agg(F.min("first_user").alias("first"))
    firsts = by_user.join(first, KEY).select(F.col("cloud").alias("_c"), F.col("share_fp").alias("_s"), F.col("user_id").alias("_u"), "first_user", "first")
    joined = shares.join(firsts, (F.col("cloud") == F.col("_c")) & (F.col("share_fp") == F.col("_s")) & F.col("user_id").eqNullSafe(F.col("_u")))
    kind = F.when(place() > F.col("first_user"), "intra").when(place() > F.col("first"), "inter").otherwise("new")
    return joined.select(*shares.columns, kind.alias("dup_class"))


def unique_shares(shares: DataFrame) -> DataFrame:
    """The first row of every fingerprint."""
    others = [c for c in shares.columns if c not in KEY]
    first = shares.groupBy(*KEY).agg(F.min_by(F.struct(*others), place()).alias("f"))
    return first.select(*KEY, "f.*").select(*shares.columns)


def first_stage(shares: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """`shares`, with a column `fragment`, with owned: does this user have the share from an earlier fragment, or by the index? Repeats in a fragment aren't seen."""
    upload = _numbered("seq", "fragment")
    first = shares.groupBy(*KEY, "user_id").agg(F.min(upload).alias("first_upload"))
    found = shares.join(first, [*KEY, "user_id"]).withColumn("owned", upload > F.col("first_upload")).drop("first_upload")
    if index is not None:
        refs = user_refs(index).withColumn("known", F.lit(True))
        found = found.join(refs, [*KEY, "user_id"], "left").withColumn("owned", F.col("owned") | F.coalesce("known", F.lit(False))).drop("known")
    return found.select(*shares.columns, "owned")


def second_stage(shares: DataFrame, index: DataFrame | None = None, visibility: str = "immediate", puts: int = 513) -> DataFrame:
    """Rows of `first_stage` with what happens to each: `skip` (owned), `duplicate` (the share is there already) or `store`.

    visibility: `immediate`, or `batched`, as of a server whose writes are seen only after every `puts` of them and at the end of a fragment: what repeats
    among writes that are seen together is stored each time.
    """
    if visibility not in ("immediate", "batched"):
        raise ValueError(f"no visibility {visibility!r}")
    sent = shares.where(~F.col("owned"))
    if visibility == "batched":
        turn = F.row_number().over(Window.partitionBy("cloud", "user_id", "file_name", "seq", "fragment").orderBy("secret_id"))  # a fragment's
        sent = sent.withColumn("_at", _numbered("seq", "fragment") * F.lit(1 << 20).cast("decimal(8,0)") + F.floor((turn - 1) / puts).cast("decimal(7,0)"))
    else:
        sent = sent.withColumn("_at", place())
    first = sent.groupBy(*KEY).agg(F.min("_at").alias("first"))
    if index is not None:
        first = first.join(index.select(*KEY, F.lit(True).alias("known")), KEY, "left")
    else:
        first = first.withColumn("known", F.lit(False))
    joined = sent.join(first, KEY, "left")
    what = F.when(F.coalesce("known", F.lit(False)) | (F.col("_at") > F.col("first")), "duplicate").otherwise("store")
    skipped = shares.where("owned").withColumn("action", F.lit("skip"))
    return joined.select(*shares.columns, what.alias("action")).unionByName(skipped)


def user_refs(index: DataFrame) -> DataFrame:
    """(cloud, share_fp, user_id): a row for each owner."""
    return index.select(*KEY, F.explode("users").alias("user_id"))


def owned_by(shares: DataFrame, refs: DataFrame) -> DataFrame:
    """The shares that their user owns."""
    return shares.join(refs, [*KEY, "user_id"], "left_semi")


def new_to(shares: DataFrame, refs: DataFrame) -> DataFrame:
    """The shares that their user doesn't own."""
    return shares.join(refs, [*KEY, "user_id"], "left_anti")


def share_index(shares: DataFrame) -> DataFrame:
    """(cloud, share_fp, share_size, users, num_users) of all shares."""
    users = F.sort_array(F.collect_set("user_id"))
    return shares.groupBy(*KEY).agg(F.max("share_size").alias("share_size"), users.alias("users")).withColumn("num_users", F.size("users"))


def merge_index(parts: DataFrame) -> DataFrame:
    """The index of which `parts` holds several parts, as rows: an entry for each share, with the owners of all its rows."""
    users = F.sort_array(F.array_distinct(F.flatten(F.collect_list("users"))))
    return parts.groupBy(*KEY).agg(F.max("share_size").alias("share_size"), users.alias("users")).withColumn("num_users", F.size("users"))


def upsert_index(index: DataFrame, shares: DataFrame) -> DataFrame:
    """The index with further shares: new entries, and further owners of those that are there."""
    return merge_index(index.select(*KEY, "share_size", "users").unionByName(share_index(shares).select(*KEY, "share_size", "users")))


def status_lists(shares: DataFrame, flag: str) -> DataFrame:
    """The answer to each fragment: its shares' flags, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("secret_id", flag)))
    return shares.groupBy("cloud", "user_id", "file_name", "seq", "fragment").agg(ordered.alias("x")).withColumn("statuses", F.col(f"x.{flag}")).drop("x")


def upload_totals(shares: DataFrame) -> DataFrame:
    """Bytes of all shares, and of those sent since not owned, for each cloud."""
    return shares.groupBy("cloud").agg(F.sum("share_size").alias("total_bytes"), F.sum(F.when(F.col("owned"), 0).otherwise(F.col("share_size"))).alias("sent_bytes"), F.count("*").alias("n_shares"))
