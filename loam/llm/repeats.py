"""Exact substring deduplication: passages of at least `window` words that occur more than once, by fixed-block anchors.

The corpus is cut into chunks of whole documents. A first exchange probes the index of non-overlapping blocks of half a window's words with every
rolling block of the corpus; a second extends the hits to windows by comparing whole-window digests. An exchange carries, for each chunk and bucket of
hashes, one sorted array of distinct hashes there and one array of bits back, so that a passage that everyone has costs a chunk one entry.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import checkpointed, checkpointed_by, partitions, table

#: Bytes of words after which a chunk is closed; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Hashes that a task matches at once, on average.
BUCKET_WORDS = 2_000_000


#: Bytes above which a word is long.
LONG_WORD = 128
#: The lowest i bytes of a number.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _sequences(words: np.ndarray, size: int, odd: int) -> np.ndarray:
    """The hash of each `size` words in a row, from those of the words.

    By doubling: that of 2n words is made of those of its halves, by a product with `odd`, a sum and a mix of bits, which no sum over powers of a base
    is; what is left of `size` is put together out of the powers of two in it.
    """
    odd, whole, covered, power, n = np.uint64(odd), None, 0, words, 1
    while True:
        count = len(words) - covered - n + 1  # places at which what is covered and this power fit one after the other
        if count < 1:
            return words[:0]
        if size & n:
            whole = power[:count].copy() if whole is None else _mixed(whole[:count] * odd + power[covered : covered + count])
            covered += n
        if covered == size:
            return whole
        power = _mixed(power[: max(0, len(power) - n)] * odd + power[n:])
        n *= 2


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _heads(*ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    new = np.zeros(len(ordered[0]), bool)
    new[:1] = True
    for x in ordered:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class Chunk:
    """The words of some whole documents, joined by single spaces, and documents joined by line feeds."""

    def __init__(self, packed: bytes, sizes: list[int], seeds: tuple[int, int, int]) -> None:
        """seeds: of the words' hashes, and two odd numbers for those of sequences."""
        self.data, self.seeds = zstandard.decompress(packed), seeds
        self.bytes = np.frombuffer(self.data, np.uint8)
        word = np.r_[False, (self.bytes != 32) & (self.bytes != 10), False]
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[::2], edge[1::2]  # of words, in bytes
        first, n = np.cumsum(np.r_[0, sizes]).astype(np.int64), len(self.start)
        self.first = first[:-1]  # words of documents
        self.place = np.arange(n) - np.repeat(self.first, sizes)  # within its document
        self.left = np.repeat(first[1:], sizes) - np.arange(n)  # words to the document's end

    @cached_property
    def words(self) -> np.ndarray:
        """The hash of each word: of its length, then of eight bytes after eight; of long words their XXH3."""
        size, odd, data = self.end - self.start, np.uint64(self.seeds[1]), self.data + bytes(8)
        eights = np.ndarray((len(self.data) + 1,), "<u8", data, strides=(1,))  # the eight bytes from each place on
        found = _mixed(size.astype(np.uint64) * odd + np.uint64(self.seeds[0]))
        at, left, live = self.start, size, np.arange(len(size))
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            found[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]], self.seeds[0])
        if (size > LONG_WORD).any():
            live = live[size <= LONG_WORD]
            at, left = at[live], left[live]
        while len(live):
            part = eights[at] & _LOW[np.minimum(left, 8)]
            found[live] = _mixed(found[live] * odd + part)
            more = left > 8
            at, left, live = at[more] + 8, left[more] - 8, live[more]
        return found

    def anchors(self, block: int) -> tuple[np.ndarray, ...]:
        """Every rolling block: positions in the order of their hashes, these, where a new one begins, flags of each distinct one.

        Flags: 1 if it is an indexed block here, 2 if it occurs twice here.
        """
        at = np.flatnonzero(self.left >= block)
        h = _sequences(self.words, block, self.seeds[1])[at]
        order = np.argsort(h)
        at, h = at[order], h[order]
        head = _heads(h)
        indexed = np.bitwise_or.reduceat(self.place[at] % block == 0, head) if len(at) else head
        return at, h, head, indexed * 1 + (np.diff(np.r_[head, len(at)]) > 1) * 2

    def windows(self, live: np.ndarray, window: int, block: int) -> tuple[np.ndarray, ...]:
        """The windows of whose one indexed block `live` is true: positions in the order of their digests, both halves of these, where a new one begins, flags."""
        at = np.flatnonzero(self.left >= window)
        at = at[live[at + -self.place[at] % block]]
        h = _sequences(self.words, window, self.seeds[1])[at]
        order = np.argsort(h)
        at, h = at[order], h[order]
        g = (_sequences(self.words, window, self.seeds[2])[at] >> np.uint64(32)).astype(np.uint32)
        head = _heads(h, g)
        return at, h, g, head, (np.diff(np.r_[head, len(at)]) > 1) * 2


def _chunks(id_type: pa.DataType):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack, part, n = zstandard.ZstdCompressor(level=5).compress, TaskContext.get().partitionId(), 0
        ids, sizes, texts, held = [], [], [], 0

        def batch() -> pa.RecordBatch:
            cols = [pa.array([part << 32 | n], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack(b"\n".join(texts))], pa.binary())]
            return pa.record_batch(cols, ["chunk", "ids", "sizes", "packed"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                ids.append(key)
                sizes.append(len(words))
                texts.append(b" ".join(words))
                held += len(texts[-1])
                if held >= CHUNK_BYTES:
                    yield batch()
                    ids, sizes, texts, held, n = [], [], [], 0, n + 1
        if ids:
            yield batch()

    return write


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _ascending(x: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(x, prepend=x.dtype.type(0)).tobytes())


def _requests(chunk: int, n: int, h: np.ndarray, flags: np.ndarray, more: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket; `h`: ascending by bucket, `more`: further arrays in the same order."""
    of = _buckets(h, n)
    head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
    cut = list(zip(head, [*head[1:], len(of)]))
    cols = [pa.array(of[head].astype(np.int32)), pa.array(np.full(len(head), chunk, np.int64)), pa.array([zstandard.compress(flags[a:b].astype(np.uint8).tobytes()) for a, b in cut], pa.binary())]
    cols += [pa.array([_ascending(x[a:b]) if x.dtype == np.uint16 else x[a:b].tobytes() for a, b in cut], pa.binary()) for x in more]
    return pa.record_batch(cols, ["bucket", "chunk", "flags", *[f"h{i}" for i in range(len(more))]])


def _block_requests(n: int, block: int, seeds: tuple):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                _, h, head, flags = Chunk(row["packed"], row["sizes"], seeds).anchors(block)
                h = h[head]
                # its 48 high bits stand for a hash: 4 bytes, and 2 that ascend slowly and so are sent as compressed differences
                yield _requests(row["chunk"], n, h, flags, [(h >> np.uint64(16)).astype(np.uint32), (h >> np.uint64(48)).astype(np.uint16)])

    return probe


def _joined(group: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in group[column]])


def _block_keys(group: pa.Table) -> list[np.ndarray]:
    high = [np.cumsum(np.frombuffer(zstandard.decompress(x.as_py()), np.uint16), dtype=np.uint64) for x in group["h1"]]
    return [np.concatenate(high) << np.uint64(32) | _joined(group, "h0", np.uint32)]


def _window_keys(group: pa.Table) -> list[np.ndarray]:
    return [_joined(group, "h0", np.uint64), _joined(group, "h1", np.uint32)]


def _answers(make_keys, needs_index: bool):
    """For a bucket: which entries stand for a sequence that occurs twice (and, if needed, is an indexed block somewhere)."""

    def match(group: pa.Table) -> pa.Table:
        flags = [np.frombuffer(zstandard.decompress(x.as_py()), np.uint8) for x in group["flags"]]
        keys = make_keys(group)
        order = np.argsort(keys[0])
        if len(keys) > 1 and len(_heads(keys[0][order])) < len(_heads(*(k[order] for k in keys))):  # equal in the first, not in the second
            order = np.lexsort(keys[::-1])
        head = _heads(*(k[order] for k in keys))
        f = np.concatenate(flags)[order]
        hit = np.add.reduceat(1 + (f >> 1 & 1).astype(np.int64), head) > 1
        if needs_index:
            hit &= np.bitwise_or.reduceat(f & 1, head) > 0
        live = np.empty(len(order), bool)
        live[order] = np.repeat(hit, np.diff(np.r_[head, len(order)]))
        cuts = np.split(live, np.cumsum([len(x) for x in flags])[:-1])
        some = pa.array([i for i, x in enumerate(cuts) if x.any()], pa.int64())
        bits = pa.array([zstandard.compress(np.packbits(cuts[i]).tobytes()) for i in some.to_pylist()], pa.binary())
        return pa.table({"chunk": group["chunk"].combine_chunks().take(some), "bucket": group["bucket"].combine_chunks().take(some), "bits": bits})

    return match


def _hits(h: np.ndarray, n: int, bits: list[dict] | None) -> np.ndarray:
    """The answer's bits for the hashes `h`, which ascend."""
    hit, of = np.zeros(len(h), bool), _buckets(h, n)
    for x in bits or ():
        a, b = np.searchsorted(of, [x["bucket"], x["bucket"] + 1])
        hit[a:b] = np.unpackbits(np.frombuffer(zstandard.decompress(x["bits"]), np.uint8), count=b - a)
    return hit


def _live(chunk: Chunk, n: int, block: int, bits: list[dict]) -> np.ndarray:
    """By position: the block that starts here is one of those hit."""
    live = np.zeros(len(chunk.start), bool)
    at, h, head, _ = chunk.anchors(block)
    live[at] = np.repeat(_hits(h[head], n, bits), np.diff(np.r_[head, len(at)]))
    return live


def _window_requests(n: int, window: int, block: int, seeds: tuple):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                if row["block_bits"]:
                    chunk = Chunk(row["packed"], row["sizes"], seeds)
                    _, h, g, head, flags = chunk.windows(_live(chunk, n, block, row["block_bits"]), window, block)
                    yield _requests(row["chunk"], n, h[head], flags, [h[head], g[head]])

    return extend


def _left(chunk: Chunk, gone: np.ndarray, size: int, first: int) -> tuple[list[dict], bytes]:
    """Of a document: the removed stretches, and what is left."""
    edge = np.flatnonzero(np.diff(np.r_[False, gone[first : first + size], False].view(np.int8))).tolist()
    spans = list(zip(edge[::2], edge[1::2]))
    kept, last = [], 0
    for a, b in [*spans, (size, size)]:
        if last < a:
            kept.append(chunk.data[chunk.start[first + last] : chunk.end[first + a - 1]])
        last = b
    return [{"start": a, "end": b} for a, b in spans], b" ".join(kept)


def _results(n: int, window: int, block: int, seeds: tuple, id_type: pa.DataType):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                chunk = Chunk(row["packed"], row["sizes"], seeds)
                change = np.zeros(len(chunk.start) + 1, np.int64)
                if row["window_bits"]:
                    at, h, g, head, _ = chunk.windows(_live(chunk, n, block, row["block_bits"]), window, block)
                    at = at[np.repeat(_hits(h[head], n, row["window_bits"]), np.diff(np.r_[head, len(at)]))]
                    change += np.bincount(at, minlength=len(change)) - np.bincount(at + window, minlength=len(change))
                gone = np.cumsum(change)[:-1] > 0
                spans, kept = zip(*(_left(chunk, gone, size, first) for size, first in zip(row["sizes"], chunk.first)))
                yield pa.record_batch([pa.array(row["ids"], id_type), pa.array(row["sizes"], pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "spans", "kept_text"])

    return result


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", seed: int | None = None) -> DataFrame:
    """(id, n_words, spans array<struct<start,end>>, kept_text) of every row of `docs`; other columns are not read.

    A word, a run without ASCII white space, is removed if one of the `window` consecutive words that cover it is a sequence that starts anywhere else
    too, in the same document or another; all is judged on the input. spans: the maximal removed stretches, as word positions, end exclusive.
    kept_text: the other words, joined by one space. Null, empty and white texts have no words, no spans and an empty kept_text; texts under `window`
    words are kept; repeated rows, null ids included, are repeats of one another. No rows: no rows.

    Any repeated window holds, in its own document, one whole block at a multiple of (window + 1) / 2 words, which the other place's rolling blocks hit.
    Hit blocks are extended to windows, which are compared by 96 bits. Hashes are seeded, with a number drawn for each run if `seed` is None, so that no
    text can be made to collide with another. A task holds one chunk, and so one document, at a time, however long. The chunks, compressed, are dealt out and checkpointed once; both exchanges
    bring their answers to where they are.
    """
    if window < 1:
        raise ValueError("window must be positive")
    draw = random.Random(seed)
    seeds = draw.getrandbits(64), draw.getrandbits(64) | 1, draw.getrandbits(64) | 1
    spark, block = docs.sparkSession, (window + 1) // 2
    id_ddl = docs.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    chunks = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(_chunks(id_type), f"chunk bigint, ids array<{id_ddl}>, sizes array<int>, packed binary")
    chunks = checkpointed_by(chunks, "chunk")
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n = max(partitions(spark), -(-total // BUCKET_WORDS))

    def answers(requests: DataFrame, key, needs_index: bool, name: str) -> DataFrame:
        bits = requests.groupBy("bucket").applyInArrow(_answers(key, needs_index), "chunk bigint, bucket int, bits binary")
        return bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    asked = chunks.mapInArrow(_block_requests(n, block, seeds), "bucket int, chunk bigint, flags binary, h0 binary, h1 binary")
    hit = checkpointed(answers(asked, _block_keys, True, "block_bits"))
    found = chunks.join(hit, "chunk", "left")
    asked = found.mapInArrow(_window_requests(n, window, block, seeds), "bucket int, chunk bigint, flags binary, h0 binary, h1 binary")
    found = found.join(answers(asked, _window_keys, False, "window_bits"), "chunk", "left")
    out = found.mapInArrow(_results(n, window, block, seeds, id_type), f"id {id_ddl}, n_words bigint, spans array<struct<start:int,end:int>>, kept_text string")
    return out.withColumnRenamed("id", id_col)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its repeated passages of 35 words; see remove_repeats."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {"op10_repeats": op10_repeats}
ORACLE_SQL = {
    "op10_repeats": r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT r, len(words) AS n, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
s AS (SELECT p.r, p.i, md5(array_to_string(w.words[p.i:p.i + 34], ' ')) AS h FROM p JOIN w USING (r)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
g AS (SELECT DISTINCT r, i + k AS i FROM d, (SELECT unnest(range(0, 35)) AS k)),
a AS (SELECT r, list(i) AS gone FROM g GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN a USING (r)"""
}
