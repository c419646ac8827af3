"""Files to be stored: from folders, or from tables whose rows are taken for files; and what is written back."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A file: its place in the order of arrival is `seq`.
FILES = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(df: DataFrame, user, name, content, seq) -> DataFrame:
    made = df.select(user.cast("int").alias("user_id"), name.alias("file_name"), content.alias("content"), seq.cast("long").alias("seq"))
    return made.select("user_id", "file_name", "content", F.octet_length("content").cast("long").alias("file_size"), "seq")


def document_files(documents: DataFrame) -> DataFrame:
    """A file for each document; the user is the source's number."""
    return _files(documents, F.substring("source", 4, 9), F.concat(F.lit("/documents/"), F.col("doc_id")), F.encode("text", "UTF-8"), F.col("doc_id"))


def page_files(pages: DataFrame, users: int = 7) -> DataFrame:
    return _files(pages, F.col("page_id") % users, F.concat(F.lit("/pages/"), F.col("page_id")), F.encode("html", "UTF-8"), F.col("page_id"))


def conversation_files(conversations: DataFrame) -> DataFrame:
    """A file for each conversation, in as many versions as it has turns, each longer than the last."""
    turns = F.collect_list("text").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    grown = conversations.withColumn("so_far", F.array_join(turns, "\n"))
    return _files(grown, F.lit(0), F.concat(F.lit("/conversations/"), F.col("conv_id")), F.encode("so_far", "UTF-8"), F.col("conv_id") * 1000 + F.col("turn"))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """The files of no bytes at or below a path or glob, which Spark's readers leave out, under the names that these would give them."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    system = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(of(path)) or []:
        base = status.getPath().toString()
        if status.isFile():
            found += [base] * (status.getLen() == 0)
            continue
        try:
            arrow, inner = arrow_path(base)
            below = [x.path[len(inner.rstrip("/")) :] for x in arrow.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File and x.size == 0]
        except (OSError, ValueError, NotImplementedError):  # a store that only Hadoop's classes reach: slower
            below, files = [], system.listFiles(status.getPath(), True)
            while files.hasNext():
                x = files.next()
                below += [x.getPath().toString()[len(base) :]] * (x.getLen() == 0)
        found += [base + x for x in below if not any(part.startswith((".", "_")) for part in x.split("/"))]
    return sorted(found)


def _listed(spark: SparkSession, path: str, content: bool) -> DataFrame:
    """(path, length, and, if asked for, content) of each file below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", *["content"] * content)
    empty = spark.createDataFrame([(x, 0, b"")[: 2 + content] for x in _empty_files(spark, path)], found.schema)
    return found.unionByName(empty)


def _path_number() -> Column:
    return F.xxhash64("path").bitwiseAND((1 << 62) - 1)


def folder_files(spark: SparkSession, path: str, user_id: int = 0) -> DataFrame:
    """The files below a folder, a row each; for files of over a gigabyte see folder_parts.

    seq is a hash of a file's path, an order that needs no sort: it tells the files of one ingest apart, and doesn't say which of two ingests is later,
    which the store numbers itself.
    """
    return _files(_listed(spark, path, True), F.lit(user_id), F.regexp_replace("path", "^[a-z]+:/*", "/"), F.col("content"), _path_number())


#: Bytes of a file that are read, and chunked, at a time, and of what is written at a time.
PART_BYTES, WRITE_BYTES = 128 << 20, 4 << 20


def folder_parts(spark: SparkSession, path: str, user_id: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """The files below a folder in parts of `part_bytes`, which tasks read one at a time: user_id, file_name, part, n_parts, content, file_size, seq.

    No row holds more than a part, and the parts of a file are read side by side. An empty file is one part. The folder has to be in a store that Arrow
    reaches from the tasks (local or shared folders, HDFS, object stores). operators.chunks.part_secrets cuts parts into chunks.
    """
    listed = _listed(spark, path, False)
    n = F.greatest(F.ceil(F.col("length") / part_bytes), F.lit(1)).cast("int")
    parts = listed.withColumn("n_parts", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    name = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rows = parts.select(F.lit(user_id).cast("int").alias("user_id"), name.alias("file_name"), "part", "n_parts", F.col("length").alias("file_size"), _path_number().alias("seq"), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                system, inner = arrow_path(row.column(6)[0].as_py())
                with system.open_input_file(inner) as f:
                    data = f.read_at(part_bytes, row.column(2)[0].as_py() * part_bytes)
                yield pa.record_batch([*[row.column(k) for k in range(4)], pa.array([data], pa.binary()), row.column(4), row.column(5)], ["user_id", "file_name", "part", "n_parts", "content", "file_size", "seq"])

    dealt = rows.repartition(F.col("path"), F.col("part"))
    return dealt.mapInArrow(read, "user_id int, file_name string, part int, n_parts int, content binary, file_size bigint, seq bigint")


def arrow_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, for a task."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+|^/+", "file:///", path))


def write_files(files: DataFrame, path: str) -> None:
    """Restored files, as a table of names and contents."""
    files.select("user_id", F.concat("file_name", F.lit(".decode")).alias("file_name"), "content").write.mode("overwrite").parquet(path)


def export_files(parts: DataFrame, path: str) -> DataFrame:
    """Writes restored files below `path/<user>`, each under its own name and `.decode`, and gives (user_id, file_name, path, bytes, md5) of each.

    parts: (user_id, file_name, pos, data), as of DedupStore.restored_parts, in which a file without bytes has a row with null `data` and any pos. A
    file's rows come in order to one task, which writes WRITE_BYTES at a time and holds no more. A file that is written again takes the place of what
    was there. Names that lead out of the folder raise. `path` has to be in a store that Arrow reaches from the tasks.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, held, done, digest = None, None, bytearray(), 0, None

        def end() -> pa.RecordBatch:
            out.write(held)
            out.close()
            return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([target]), pa.array([done], pa.int64()), pa.array([digest.hexdigest()])], ["user_id", "file_name", "path", "bytes", "md5"])

        for batch in batches:
            for user, name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if (user, name) != key:
                    if out is not None:
                        yield end()
                    if ".." in name.split("/"):
                        raise ValueError(f"{name} leads out of the folder")
                    key, held, done, digest = (user, name), bytearray(), 0, hashlib.md5()
                    target = f"{path.rstrip('/')}/{user}/{name.strip('/')}.decode"
                    system, inner = arrow_path(target)
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(inner)
                data = data.as_py() or b""
                held += data
                done += len(data)
                digest.update(data)
                if len(held) >= WRITE_BYTES:
                    out.write(held)
                    held = bytearray()
        if out is not None:
            yield end()

    rows = parts.select("user_id", "file_name", "pos", "data")
    dealt = rows.repartition("user_id", "file_name").sortWithinPartitions("user_id", "file_name", "pos")
    return dealt.mapInArrow(write, "user_id int, file_name string, path string, bytes bigint, md5 string")


@dataclass(frozen=True)
class ServerConfig:
    """Settings of the store; whatever a JSON text lacks, or all if it can't be read, is as here."""

    clouds: int = 4
    database_dir: str = "database"
    container_dir: str = "container"
    clean: bool = False
    cluster: tuple = field(default=())

    @staticmethod
    def parse(text: str) -> ServerConfig:
        try:
            given = json.loads(text)
            peers = tuple((p["ip"], int(p["port"])) for p in given.get("cluster", []))
            d = ServerConfig()
            return ServerConfig(len(peers) or d.clouds, given.get("database dir", d.database_dir), given.get("container dir", d.container_dir), bool(given.get("clean", d.clean)), peers)
        except (ValueError, KeyError, TypeError, AttributeError):
            return ServerConfig()


def parse_client_config(text: str) -> list[tuple[str, int]]:
    """A `host:port` in each line."""
    return [(host, int(port)) for host, _, port in (x.strip().partition(":") for x in text.splitlines()) if host]
