"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import table

#: What is not a letter; one space stands for a run of it, so that marks and digits don't count.
_NO_LETTERS = re.compile(r"[\W\d_]+")
#: Bytes encoded at a time, each time from the dictionary alone: late parts of a long text count like early ones.
BLOCK = 4096
UNKNOWN = "und"


def letters(text: str | None) -> bytes:
    return (" " + _NO_LETTERS.sub(" ", (text or "").lower()).strip() + " ").encode("utf-8", "replace")


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows kept back from learning: crc32 of the id as text, modulo 4, is 2. Null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, rows: int = 500, row_chars: int = 128, dictionary_bytes: int = 65536, full_languages: int = 200, max_languages: int = 10_000) -> dict[str, bytes]:
    """A raw-content dictionary for each language of `labelled` (text, lang), most frequent language first.

    The bounded sample behind it: of each language `rows` distinct texts, chosen by hash, and of each `row_chars` consecutive characters; the
    dictionary keeps `dictionary_bytes`. With more than `full_languages` languages, rows and bytes of each shrink in proportion, so that what reaches
    the driver and the tasks is bounded whatever their number; over `max_languages` raise ValueError, as a column of so many values holds no languages.
    Null texts and langs and texts without a letter teach nothing; copies of a text count once.
    """
    known = labelled.select("lang", "text", F.xxhash64("text").alias("h")).where("lang is not null and text is not null")
    texts = known.groupBy("lang", "h").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.sum("n").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    if not sizes:
        return {}
    if len(sizes) > full_languages:
        rows, dictionary_bytes = (max(1, x * full_languages // len(sizes)) for x in (rows, dictionary_bytes))
    # a share of the hashes that holds about four times the texts needed, so that no task ranks a whole language
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 20, -(-(rows << 22) // n)))])
    some = texts.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")])
    chosen = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= rows).select("lang", "h")
    # a short piece of many texts, from anywhere in each: no single odd text fills a dictionary
    piece = F.substring(F.col("text"), (F.pmod("h", F.greatest(F.length("text") - row_chars, F.lit(0)) + 1) + 1).cast("int"), F.lit(row_chars))
    sample = known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(piece).alias("text")).orderBy("lang", "h").collect()
    found: dict[str, bytes] = {}
    for lang in sorted(sizes, key=lambda x: (-sizes[x], x)):
        content = b"".join(x for r in sample if r["lang"] == lang and (x := letters(r["text"])).strip())[:dictionary_bytes]
        if content:
            found[lang] = content
    return found


class Encoders:
    """A compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs, self.encode = list(dictionaries), []
        for content in dictionaries.values():
            how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, min_match=4, window_log=18, hash_log=16, chain_log=16, search_log=3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            self.encode.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress)

    def predict(self, text: str | None, narrow: float) -> tuple[str, float, bool]:
        """(language, margin, rejected)."""
        data = letters(text)
        if not self.encode or not data.strip():
            return UNKNOWN, 0.0, True
        sizes = [sum(len(f(data[a : a + BLOCK])) for a in range(0, len(data), BLOCK)) for f in self.encode]
        best = int(np.argmin(sizes))  # ties: the language with the most texts
        second = min((s for i, s in enumerate(sizes) if i != best), default=None)
        margin = 1.0 if second is None else 1 - sizes[best] / second
        return self.langs[best], margin, margin < narrow


def identify(text: Column, dictionaries: dict[str, bytes], narrow: float = 0.01) -> Column:
    """struct<lang_pred string, score double, rejected boolean> of a whole text.

    score: by which share the best language's encoding is smaller than the second's, 0 to 1; with one language only, 1. Null texts and texts without a
    letter are `und`, 0.0, rejected, as is everything if no language was learned. A text of any length is rejected if its score is below `narrow`,
    as that of a tie, 0, is; lang_pred still names the best, and of tied languages the one with the most learned texts.
    """
    made: list[Encoders] = []

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Encoders(dictionaries))
        lang, score, rejected = zip(*(made[0].predict(t, narrow) for t in texts.to_pylist())) if len(texts) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    return predict(text)


def add_language(docs: DataFrame, labelled: DataFrame, narrow: float = 0.01) -> DataFrame:
    """`docs` with a column `language` (see identify), learned from `labelled` (doc_id, text, lang) without its held-out rows. No rows: no rows.

    A column of that name in `docs` is replaced; no other column but text is read.
    """
    return docs.withColumn("language", identify(F.col("text"), learn(labelled.where(~held_out() & F.col("doc_id").isNotNull())), narrow))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document; see identify."""
    docs = table(spark, sf_dir, "documents")
    return add_language(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang")).select("doc_id", held_out().alias("held_out"), "language.*")


QUERIES = {"op3_langid": op3_langid}
ORACLE_SQL: dict[str, str] = {}
