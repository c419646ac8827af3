"""Ingest as a stream: micro-batches of files into the share index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loam.operators.dedup import merge_index, share_index
from loam.sources.shared import Folder


def stream_files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Rows of parquet files as they arrive; `path` may be a glob."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


#: Runs of a level that are merged into one of the next.
FAN = 16


def _merged(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The index out of several parts of it."""
    return merge_index(spark.read.parquet(*paths))


def ingest_index(shares: DataFrame, folder: str) -> StreamingQuery:
    """Keeps the share index of a stream of shares below `folder`; runs until what is there is read.

    A micro-batch writes the index of its own shares, as a run. Every 16 runs of a level are merged into one of the next, so that an entry is written
    once for each level, of which there are log16 of the batches, and read_index has at most 15 runs of each level to merge. A batch that is run again
    after a failure writes its run, and those it completes, anew, out of the same shares; runs that are merged are removed with the next but one merge of
    their level, so that readers of the index as it was can end.
    """
    spark = shares.sparkSession
    disk = Folder(spark, folder)

    def put(entries: DataFrame, run: str) -> None:
        entries.write.mode("overwrite").parquet(f"{folder}/runs/{run}")
        disk.create(f"done/{run}", "")

    def keep(batch: DataFrame, number: int) -> None:
        put(share_index(batch), f"0-{number}")
        level, n = 0, number
        while n % FAN == FAN - 1:
            there = set(disk.names("done"))
            put(_merged(spark, [f"{folder}/runs/{x}" for i in range(n - FAN + 1, n + 1) if (x := f"{level}-{i}") in there]), f"{level + 1}-{n // FAN}")
            for i in range(max(0, n - 2 * FAN + 1), n - FAN + 1):
                disk.remove(f"done/{level}-{i}")
                disk.remove(f"runs/{level}-{i}")
            level, n = level + 1, n // FAN

    return shares.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def read_index(spark: SparkSession, folder: str) -> DataFrame | None:
    """The index as it is: of what the runs cover, each batch by the largest; None before the first batch."""
    runs = sorted(((int(level), int(n)) for level, _, n in (x.partition("-") for x in Folder(spark, folder).names("done"))), reverse=True)
    chosen: list[tuple[int, int]] = []
    for level, n in runs:
        if not any(n * FAN**level // FAN**above == m for above, m in chosen):
            chosen.append((level, n))
    return _merged(spark, [f"{folder}/runs/{level}-{n}" for level, n in chosen]) if chosen else None


def run_index(shares: DataFrame, folder: str) -> DataFrame:
    """The index after all that is there has been read."""
    query = ingest_index(shares, folder)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    spark = shares.sparkSession
    found = read_index(spark, folder)
    return share_index(spark.createDataFrame([], shares.schema)) if found is None else found


def first_seen(shares: DataFrame) -> DataFrame:
    """A stream with only the first share of each fingerprint; the state holds the fingerprints."""
    return shares.dropDuplicates(["cloud", "share_fp"])


def append_to(shares: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = first_seen) -> StreamingQuery:
    """Appends what `transform` leaves of a stream to a parquet folder."""
    return transform(shares).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
