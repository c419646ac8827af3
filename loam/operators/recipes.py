"""Recipes, which list a file's shares, and restoring files from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.hashing import recipe_fingerprint
from loam.operators.chunks import expected_chunks


def recipe_entries(shares: DataFrame) -> DataFrame:
    """(recipe_fp, cloud, pos, share_fp, secret_id, secret_size, share_size) and the upload's seq. Chunks are numbered without gaps, so pos is the number."""
    key = recipe_fingerprint(F.col("file_name"), F.col("user_id"))
    return shares.select(key.alias("recipe_fp"), "cloud", F.col("secret_id").alias("pos"), "share_fp", "secret_id", "secret_size", "share_size", "seq")


def recipes(shares: DataFrame) -> DataFrame:
    """(recipe_fp, cloud, user_id, file_name, seq, file_size, num_shares): a row for each upload."""
    key = recipe_fingerprint(F.col("file_name"), F.col("user_id"))
    return shares.groupBy(key.alias("recipe_fp"), "cloud", "user_id", "file_name", "seq").agg(F.max("file_size").alias("file_size"), F.count("*").alias("num_shares"))


def heads(files: DataFrame, shares: DataFrame) -> DataFrame:
    """(recipe_fp, cloud, user_id, file_name, seq, file_size, num_shares): a row for each of `files` (user_id, file_name, seq, file_size, cloud), those
    without a share, as empty ones, included.
    """
    counts = shares.groupBy("cloud", "seq").agg(F.count("*").alias("num_shares"))
    key = recipe_fingerprint(F.col("file_name"), F.col("user_id"))
    found = files.join(counts, ["cloud", "seq"], "left")
    return found.select(key.alias("recipe_fp"), "cloud", "user_id", "file_name", "seq", "file_size", F.coalesce("num_shares", F.lit(0).cast("long")).alias("num_shares"))


def resumed(entries: DataFrame) -> DataFrame:
    """Recipe entries of fragments that came one by one, with their places: (recipe_fp, cloud, past, secret_id, ...) with pos, past or more.

    A fragment says how many shares of its file came before it (`past`), and its own are in the order of secret_id. Raises, when it is run, if a
    fragment's past is not what came: if it begins behind the end of what is there, before it, or if nothing is there.
    """
    others = [c for c in entries.columns if c not in ("recipe_fp", "cloud")]
    whole = entries.groupBy("recipe_fp", "cloud").agg(F.array_sort(F.collect_list(F.struct("past", "secret_id", F.struct(*others).alias("e")))).alias("_x"))  # a file's
    each = whole.select("recipe_fp", "cloud", F.posexplode("_x").alias("pos", "_e"), F.col("_x"))
    opens = (F.col("pos") == 0) | (F.col("_x")[F.greatest(F.col("pos") - 1, F.lit(0))]["past"] != F.col("_e.past"))
    wrong = opens & (F.col("_e.past") != F.col("pos"))
    name = F.concat(F.lit("no recipe to resume: "), F.col("recipe_fp"), F.lit(" at "), F.col("_e.past").cast("string"))
    checked = F.when(wrong, F.raise_error(name).cast("int")).otherwise(F.col("pos"))
    return each.select("recipe_fp", "cloud", checked.alias("pos"), "_e.e.*")


def latest(recipes_: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The last upload of each name of a user, by seq or the columns of `order`, which takes the place of earlier ones."""
    others = [c for c in recipes_.columns if c not in ("recipe_fp", "cloud")]
    return recipes_.groupBy("recipe_fp", "cloud").agg(F.max_by(F.struct(*others), F.struct(*(order or ["seq"]))).alias("r")).select("recipe_fp", "cloud", "r.*").select(*recipes_.columns)


def complete(recipes_: DataFrame, avg: int) -> DataFrame:
    """The recipes that have as many shares as chunks of a fixed size were expected."""
    return recipes_.where(F.col("num_shares") == expected_chunks(F.col("file_size"), avg))


def read_recipe(recipes_: DataFrame, file_name: str, user_id: int) -> DataFrame:
    """The recipe of one file; raises, when it is run, if there is none."""
    key = recipe_fingerprint(F.lit(file_name), F.lit(user_id))
    wanted = recipes_.sparkSession.range(1).select(key.alias("wanted"))
    found = wanted.join(recipes_, F.col("wanted") == F.col("recipe_fp"), "left")
    checked = F.when(F.col("recipe_fp").isNull(), F.raise_error(F.lit(f"no recipe of {file_name}"))).otherwise(F.col("recipe_fp"))
    return found.withColumn("recipe_fp", checked.cast("string")).drop("wanted")


def fetch(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Recipe entries with their bytes, of stored (cloud, share_fp, data); a missing share raises when it is run."""
    joined = entries.join(stored.select("cloud", "share_fp", "data"), ["cloud", "share_fp"], "left")
    checked = F.when(F.col("data").isNull(), F.raise_error(F.concat(F.lit("no share "), F.col("share_fp"))).cast("binary")).otherwise(F.col("data"))
    return joined.withColumn("data", checked)


def reassemble(parts: DataFrame, by: list[str], order: str = "pos", data: str = "data") -> DataFrame:
    """The bytes of each group, joined in order; a group is a file's, and has to fit into a row."""
    name = lambda c: "`" + c.replace("`", "``") + "`"
    return parts.groupBy(*by).agg(F.expr(f"listagg({name(data)}, x'') WITHIN GROUP (ORDER BY {name(order)})").alias("content"))


def restore(entries: DataFrame, stored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whole files from their recipes' entries and the stored shares of one cloud."""
    return reassemble(fetch(entries, stored), by or ["recipe_fp"])
