"""WARC archives with a two-level capture index: sorted reversed-host keys in compressed blocks, under a sparse directory of the blocks."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import checkpointed, join_hot, kept, partitions, shared_folder, table

#: Payloads below this many bytes are always stored.
REVISIT_FROM = 1000
#: Payload bytes, and records, of a file at most, and the payload bytes up to which so many records fit.
FILE_BYTES, FILE_RECORDS = 256 << 20, 2048
PAGE_BYTES = FILE_BYTES // FILE_RECORDS
#: Groups of equal payloads that are sent to all tasks; more are joined, which shuffles the payloads.
BROADCAST_GROUPS = 100_000
#: Lines of an index block.
BLOCK_LINES = 1000
#: Directory entries that a lookup takes to the driver for its binary search; a larger directory is searched where it is.
DIRECTORY_ROWS = 1_000_000
_END = "\r\n\r\n"
_RECORD = "file string, offset bigint, length bigint, type string, record_id string, refers_to string, uri string, payload_bytes bigint, payload_digest string"


_UNSAFE = r"[\x00-\x20\x7F]"


def safe_url(url: Column) -> Column:
    """White space and control characters percent-encoded, each as its own code; a URL that has none stays as it is."""
    one = lambda c: F.when(c.rlike(_UNSAFE), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(url.rlike(_UNSAFE), F.array_join(F.transform(F.split(url, ""), one), "")).otherwise(url)


def url_key(url: Column) -> Column:
    """The reversed-host key of a URL: `com,example)/path?query`, without scheme, user, port, `www.` and fragment; null for null, `)` and the text for what has no host."""
    url = safe_url(url)
    rest = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://|#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@", ""), r":[0-9]*$|^(?i:www\.)", ""))
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    named = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]"), named).when(url.isNotNull(), F.concat(F.lit(")"), url))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a WARC/1.1 record for every row of `pages` to text files in `folder`, which must not exist.

    The payload is the html in UTF-8, empty for null, in an HTTP response. Of rows with equal payloads of at least 1000 bytes, those with the largest id
    are response records (all of them, if several rows share that id), the others revisit records without payload, which name the response; smaller
    payloads are always responses. Ids may be null or repeated: a record's id is made of row id and payload digest. White space and control characters
    in URLs are percent-encoded; a null URL is `about:blank`. Other columns are not read. No rows: no record.

    Spark's text writer makes the files, with the two line ends that close a record as its line separator, so that any store it writes to will do. A
    file has FILE_BYTES of payload at most, or one record: pages over PAGE_BYTES have files of their own, of as few records as the largest page demands.
    A page of any length is a row and a record, which tasks hold one at a time.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    own = own.withColumns({"digest": F.sha1("payload"), "sha256": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    groups = own.where(F.col("bytes") >= REVISIT_FROM).groupBy("sha256").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    groups = checkpointed(groups)
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    own = own.join(F.broadcast(groups) if few else groups, "sha256", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.col("bytes") >= REVISIT_FROM)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(">"))
    safe = F.coalesce(safe_url(F.col("url")), F.lit("about:blank"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    header = lambda kind, more, n: F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), urn(F.col("id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), safe, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), *more, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), n.cast("string"), F.lit(_END))
    profile = [F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("first"))]
    http_bytes = F.octet_length(http)
    record = F.when(revisit, F.concat(header("revisit", profile, http_bytes), http)).otherwise(F.concat(header("response", [], http_bytes + F.col("bytes")), http, F.col("payload")))
    largest = pages.agg(F.max(F.octet_length(html_col))).first()[0] or 0
    small = F.col("bytes") <= PAGE_BYTES
    for rows, most in [(own, FILE_RECORDS)] if largest <= PAGE_BYTES else [(own.where(small), FILE_RECORDS), (own.where(~small), max(1, FILE_BYTES // largest))]:
        rows.select(record.alias("value")).write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", most).text(folder)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at a place of a WARC file; ValueError if there is none."""
    stop = data.find(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if stop < 0 or not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    end = stop + 4 + int(headers["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut off")
    return headers, data[stop + 4 : end], end + 4


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header."""
    return block[block.index(b"\r\n\r\n") + 4 :]


_KINDS = [(x.split()[0], pa.string() if "string" in x else pa.int64()) for x in _RECORD.split(", ")]
#: Bytes read at a time: of headers, and of ranges that lie one behind the other.
HEAD_BYTES, RANGE_BYTES = 64 << 10, 8 << 20


def _opened(path: str):
    """A file to read ranges of, in a task."""
    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(inner)


def in_reach(folder: str) -> bool:
    """True if tasks can read ranges of a folder's files themselves; else Spark's reader gives them whole files."""
    try:
        system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
        return system.get_file_info(inner).type == fs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):
        return False


def _heads(size: int, read: Callable[[int, int], bytes], path: str) -> Iterator[tuple[str, int, int]]:
    """(uri, offset, length) of each record of a file of `size` bytes, of which `read` (offset, bytes) gives parts: payloads are passed over."""
    at, window, start = 0, b"", 0
    while at < size:
        stop = window.find(b"\r\n\r\n", at - start) if at >= start else -1
        want = HEAD_BYTES
        while stop < 0:
            start, window = at, read(at, want)
            stop = window.find(b"\r\n\r\n")
            if stop < 0 and len(window) < want:
                raise ValueError(f"no WARC record at {at} of {path}")
            want *= 4
        lines = window[at - start : stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at} of {path}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        end = start + stop + 4 + int(headers["Content-Length"]) + 4
        if end > size:
            raise ValueError(f"the record at {at} of {path} is cut off")
        yield headers["WARC-Target-URI"], at, end - at
        at = end


def index_records(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, file, offset, length) of each record in a folder's files, from their headers alone. A record that is cut off raises. No records: no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    direct = in_reach(folder)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (path, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if direct:
                    with _opened(path) as f:
                        rows = list(_heads(size, lambda at, n: f.read_at(n, at), path))
                else:
                    data = batch.column(2)[i].as_buffer()
                    rows = list(_heads(size, lambda at, n: data[at : at + n].to_pybytes(), path))
                for k in range(0, len(rows), 10_000):
                    uri, offset, length = zip(*rows[k : k + 10_000])
                    yield pa.record_batch([pa.array(uri, pa.string()), pa.array([path] * len(uri), pa.string()), pa.array(offset), pa.array(length)], ["uri", "file", "offset", "length"])

    return files.select("path", "length", *([] if direct else ["content"])).mapInArrow(listed, "uri string, file string, offset bigint, length bigint")


def _record_of(path: str, at: int, data: bytes) -> tuple:
    h, block, _ = parse(data)
    body = payload_of(block) if h["WARC-Type"] == "response" else None
    size, digest = (None, None) if body is None else (len(body), hashlib.sha1(body).hexdigest())
    if digest and h["WARC-Payload-Digest"] != f"sha1:{digest}":
        raise ValueError(f"{path} at {at}: the payload doesn't have the digest in its header")
    return path, at, len(data), h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), h["WARC-Target-URI"], size, digest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows), _KINDS)], [n for n, _ in _KINDS])


def _joined(ranges: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Ranges, in order, that follow each other in a file, together up to RANGE_BYTES."""
    path, held, end = None, [], 0
    for file, offset, length in ranges:
        if held and (file != path or offset != end or end + length - held[0][0] > RANGE_BYTES):
            yield path, held
            held = []
        path, end = file, offset + length
        held.append((offset, length))
    if held:
        yield path, held


def read_captures(spark: SparkSession, lines: DataFrame, folder: str) -> DataFrame:
    """The records at `lines` (file, offset, length), of archives in `folder`: headers, and of responses the payload's size and SHA-1.

    The lines are dealt out by file, and tasks read just their ranges, several at once where they follow each other. A store that only Spark's readers
    reach gives whole files instead, of which the ranges are cut. Raises if a record is cut off or a payload doesn't have the digest of its header.
    Repeated lines give repeated rows.
    """
    if in_reach(folder):

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranges = (x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(3))))
            open_, path = None, None
            for file, held in _joined(ranges):
                if file != path:
                    if open_:
                        open_.close()
                    open_, path = _opened(file), file
                first = held[0][0]
                data = open_.read_at(held[-1][0] + held[-1][1] - first, first)
                yield _batch([_record_of(file, at, data[at - first : at - first + n]) for at, n in held])
            if open_:
                open_.close()

        dealt = lines.select("file", "offset", "length").repartition(partitions(spark), "file").sortWithinPartitions("file", "offset")
        return dealt.mapInArrow(fetch, _RECORD)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = content.as_buffer()
                yield _batch([_record_of(path, x["offset"], data[x["offset"] : x["offset"] + x["length"]].to_pybytes()) for x in ranges])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    wanted = lines.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("ranges"))  # a file's
    return files.join(wanted, "path").select("path", "content", "ranges").mapInArrow(cut, _RECORD)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n, lines = TaskContext.get().partitionId(), 0, []

    def block() -> pa.RecordBatch:
        data = zlib.compress("\n".join(" ".join(x) for x in lines).encode())
        return pa.record_batch([pa.array([part << 32 | n]), pa.array([lines[0][0]]), pa.array([lines[-1][0]]), pa.array([data])], ["block", "first_key", "last_key", "data"])

    for batch in batches:
        for key, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
            lines.append((key, str(offset), str(length), file))
            if len(lines) == BLOCK_LINES:
                yield block()
                n, lines = n + 1, []
    if lines:
        yield block()


def lines_of(data: bytes) -> list[tuple[str, int, int, str]]:
    """(key, offset, length, file) of an index block."""
    parts = (x.split(" ", 3) for x in zlib.decompress(data).decode().split("\n"))
    return [(key, int(offset), int(length), file) for key, offset, length, file in parts]


def write_index(records: DataFrame, folder: str) -> None:
    """The capture index of `records` (uri, file, offset, length), below `folder`: blocks of lines sorted by key, and the directory of the blocks.

    Ranges are cut by key, file and offset, so that a host or URL with many captures is spread over ranges.
    """
    lines = records.select(url_key(F.col("uri")).alias("key"), "file", "offset", "length")
    ordered = lines.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    ordered.mapInArrow(_pack, "block bigint, first_key string, last_key string, data binary").write.parquet(f"{folder}/blocks")
    blocks = records.sparkSession.read.parquet(f"{folder}/blocks")
    blocks.select("first_key", "last_key", "block").write.parquet(f"{folder}/directory")


def located(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(key, offset, length, file): the lines of an index whose key is one of `keys` (key); each once, however often a key is given.

    The directory goes to the tasks, DIRECTORY_ROWS of its entries at a time, and is binary-searched for the blocks that can hold a key, and a block for
    its lines; blocks without a wanted key are not opened. A larger directory makes more passes over the keys. Null keys find nothing.
    """
    keys = keys.select("key").where("key is not null").distinct()
    directory = spark.read.parquet(f"{folder}/directory")
    several = directory.limit(DIRECTORY_ROWS + 1).count() > DIRECTORY_ROWS
    blocks = spark.read.parquet(f"{folder}/blocks").select("block", "data")

    def search(entries: list[tuple[str, str, int]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(tuple(map(list, zip(*entries))) if entries else ([], [], []))

        @F.arrow_udf("array<bigint>")
        def holding(wanted: pa.Array) -> pa.Array:
            first, last, numbers = shared.value
            return pa.array([numbers[bisect_left(last, k) : bisect_right(first, k)] for k in wanted.to_pylist()], pa.list_(pa.int64()))

        return keys.select("key", F.explode(holding("key")).alias("block"))

    def lines(wanted: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        for data in found["data"].to_pylist() if wanted.num_rows else ():
            own = lines_of(data)
            names = [x[0] for x in own]
            for key in wanted["key"].to_pylist():
                rows += own[bisect_left(names, key) : bisect_right(names, key)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["key", "offset", "length", "file"])

    parts, held = [], []
    for row in directory.orderBy("first_key", "last_key", "block").toLocalIterator() if several else sorted(map(tuple, directory.collect())):
        held.append(tuple(row))
        if len(held) == DIRECTORY_ROWS:
            parts.append(search(held))
            held = []
    wanted = reduce(DataFrame.union, [*parts, search(held)])
    return wanted.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(lines, "key string, offset bigint, length bigint, file string")


def _plain_key(url: str) -> str:
    """url_key of one URL."""
    url = re.sub(_UNSAFE, lambda m: f"%{ord(m[0]):02X}", url)
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]", url):
        return ")" + url
    host, path = re.match(r"([^/?]*)(.*)", re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://|#.*$", "", url)).groups()
    host = re.sub(r":[0-9]*$|^(?i:www\.)", "", re.sub(r"^.*@", "", host)).lower()
    return f"{','.join(reversed(host.split('.')))}){'' if path.startswith('/') else '/'}{path}"


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """Bytes of a file in any store that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        return bytes(stream.readNBytes(length))
    finally:
        stream.close()


def lookup(spark: SparkSession, folder: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of every capture of a URL.

    The directory is binary-searched for the blocks that can hold the key, these for its lines, and just the records' ranges are read. A directory over
    DIRECTORY_ROWS is filtered by Spark, whose readers skip row groups by the least and largest key.
    """
    key = _plain_key(url)
    directory = spark.read.parquet(f"{folder}/directory")
    found = directory.limit(DIRECTORY_ROWS + 1).count()
    if found > DIRECTORY_ROWS:
        chosen = [r["block"] for r in directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).collect()]
    else:
        entries = sorted((r["first_key"], r["last_key"], r["block"]) for r in directory.collect())
        to = bisect_right([e[0] for e in entries], key)
        chosen = []
        while to and entries[to - 1][1] >= key:
            chosen.append(entries[to - 1][2])
            to -= 1
    out = []
    for row in spark.read.parquet(f"{folder}/blocks").where(F.col("block").isin(chosen)).orderBy("block").select("data").collect():
        lines = lines_of(row["data"])
        at = bisect_right([x[0] for x in lines], key)
        while at and lines[at - 1][0] == key:
            _, offset, length, file = lines[at - 1]
            out.append(parse(read_range(spark, file, offset, length))[:2])
            at -= 1
    return out


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes `pages` and their capture index below `folder`, and reads back, through the index, a row for each page.

    (id, payload_bytes, payload_digest, record_type, refers_to): size and SHA-1 are those of the full payload, of a revisit its response's. The keys of
    the pages' URLs are looked up in the directory and the blocks, and the records read at the places that the lines name. See write_archives for the
    edge cases; pages that share a URL, and rows that repeat, are captures of one key.
    """
    spark = pages.sparkSession
    write_archives(pages, f"{folder}/warc", id_col, url_col, html_col)
    write_index(kept(index_records(spark, f"{folder}/warc"), "heads"), f"{folder}/index")
    lines = located(spark, f"{folder}/index", pages.select(url_key(F.coalesce(safe_url(F.col(url_col)), F.lit("about:blank"))).alias("key")))
    records = kept(read_captures(spark, lines, f"{folder}/warc"), "captures")
    responses = records.where("type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    revisits = records.where("type = 'revisit'").select("type", "record_id", "refers_to")
    full = records.where("type = 'response'").select("type", "record_id", "refers_to", "payload_bytes", "payload_digest")
    classes = responses.join(revisits.groupBy("refers_to").agg(F.count("*").alias("n")), "refers_to", "right")
    full = full.unionByName(join_hot(revisits, classes, "refers_to", "left").select(full.columns))
    kind = pages.schema[id_col].dataType
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*):[0-9a-f]{40}>$", 1), F.lit("null")).cast(kind)
    return full.select(page("record_id").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back; see archive."""
    return archive(table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}")


QUERIES = {"op8_warc": op8_warc}
ORACLE_SQL = {
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to
FROM g"""
}
