"""A training corpus out of `documents`: language, near-duplicates, benchmark leaks, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import dropped, kept, mark, table
from loam.llm.decontaminate import decontaminate
from loam.llm.langid import held_out, identify, learn
from loam.llm.mixing import mixed, plan_mix
from loam.llm.sharding import add_shard
from loam.llm.simhash import keep_one

SHARDS = 16
#: No source is repeated more often than this in the mix; the largest comes once.
MAX_REPEATS = 2.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is rejected: no letter at all, or two languages fit alike. Learned from the documents not held out.

    Null and empty texts are rejected; of all other columns only lang, null for rows that teach nothing, and doc_id are read, null ids teaching nothing.
    Repeated rows share their fate; long texts are encoded whole. No rows: no rows.
    """
    dictionaries = learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return docs.where(~identify(F.col("text"), dictionaries)["rejected"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id: shingles of five words, similarity from 0.8.

    Null and empty texts are copies of one another; rows with a null id stay; rows that repeat an id are one document, and go or stay together. See keep_one.
    """
    return keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which an item of `benchmark` occurs within its edit budget. Null and empty texts and items match nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources up to twice, so that sources come nearer to one another. Repeats are equal rows.

    Documents without a word have no tokens, and so no place in the mix.
    """
    return mixed(docs, plan_mix(docs, max_repeats=MAX_REPEATS)).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the shard, 0 to 15, of each document; of null ids that of 0. A column `shard` is replaced; repeats of a row are in one shard."""
    return add_shard(docs, SHARDS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mixture", mixture), ("shards", shards)]

#: SQL has neither zstandard nor XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next; what went before is then removed there."""
    docs, start = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
        dropped(spark, start, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
