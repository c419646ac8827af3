"""What the operators of this package share: reading tables, and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`, in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a temporary folder is made, but only for a local master, whose driver and executors are one process.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder and sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loam-")
        atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(f"file://{folder}")
        folder = sc._jsc.sc().getCheckpointDir().get()
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


class _Written(threading.local):
    """The folders that kept() has written in a thread and dropped() hasn't removed, in order: jobs of two threads leave each other's tables alone."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = _Written()


def kept(df: DataFrame, tag: str) -> DataFrame:
    """`df` written once as a table of the shared folder and read again: later uses neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place among the tables that kept() has written, for dropped()."""
    return len(_written.paths)


def dropped(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Removes the tables that kept() has written since a mark, but for the last `but`. Results that read them can't be run any more."""
    to = len(_written.paths) - but
    paths = _written.paths[since:to]
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del _written.paths[since:to]


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, reliably checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpointed_by(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt out and sorted by a column, and reliably checkpointed so: joins on the column shuffle and sort the other side only.

    How a checkpoint is dealt out is known to later plans only if it wasn't planned adaptively, which is so for this one plan; other plans of the
    session that are made just then aren't either, which changes no result.
    """
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    shared_folder(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.repartition(partitions(spark), key).sortWithinPartitions(key).checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one value above which it is hot.
HOT = 1_000_000


def join_hot(rows: DataFrame, classes: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """`rows` joined to `classes` (on, n and others; n: how many of `rows` have the value), without n.

    Values that over HOT rows have are few, one for each so many rows, and sent to all tasks, so that none gets all rows of one. The others are shuffled.
    Both are read twice.
    """
    hot, other = classes.where(F.col("n") > HOT).drop("n"), classes.where(F.col("n") <= HOT).drop("n")
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(other, on, how))
