"""SimHash near-duplicates: fingerprints of word shingles, linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import checkpointed, join_hot, kept, table
from loam.llm.components import components

#: Codes under a leaf and nodes under an upper node of the index.
FAN = 8
#: Codes searched together, and pairs where most pairs are compared; both bound the memory of a search.
BLOCK, PAIRS = 4096, 1 << 20
#: Rows of whole runs after which a task searches what it has read.
ROWS = 200_000


def _digests(text: bytes | None, words: int, seed: int) -> bytes:
    """The XXH64 of each shingle, 8 bytes each, the highest first."""
    parts = text.lower().split() if text else []  # bytes: A-Z only, and ASCII white space only
    if not parts:
        return b""
    joined = b" ".join(parts)
    n = len(parts) - words + 1
    if n <= 1:
        return xxhash.xxh64_digest(joined, seed)
    starts = list(accumulate((len(p) + 1 for p in parts), initial=0))
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[words:])])


def _majority(digests: np.ndarray) -> bytes:
    bits = np.unpackbits(digests.reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes()


def text_fingerprint(text: bytes | None, words: int, seed: int) -> int:
    return int.from_bytes(_majority(np.frombuffer(_digests(text, words, seed), np.uint8)), "big", signed=True)


def shingle_set(text: bytes | None, words: int, seed: int) -> np.ndarray:
    """The XXH64 of each different shingle, ascending."""
    return np.unique(np.frombuffer(_digests(text, words, seed), ">u8").astype(np.uint64))


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """256 bits of a shingle_set: four majorities, of its hashes and of three more made from each. How often a shingle comes doesn't count."""
    h = shingles
    found = b""
    for k in range(4):
        found += _majority(h.byteswap().view(np.uint8))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(33)
    return found


def fingerprint(text: Column, words: int = 3, seed: int = 42) -> Column:
    """The 64-bit SimHash of a text as a BIGINT: a bit is 1 if over half of the shingles' XXH64 have it set, repeats included.

    Words are runs without ASCII white space, after A-Z is lower-cased. Fewer words than a shingle has: the whole sequence is the one shingle.
    Null, empty and white texts have the fingerprint 0.
    """

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([text_fingerprint(t.as_py(), words, seed) for t in texts.cast(pa.binary())], pa.int64())

    return simhash(text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the sequence of Gray codes, in which neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def masks(radius: int, blocks: int) -> list[int]:
    """Bit patterns, of which codes that differ in `radius` bits at most agree in one at least: all but `radius` of `blocks` blocks of bits."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64 must hold")
    ends = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:])]
    return [sum(c) for c in combinations(block, blocks - radius)]


class GrayForest:
    """One tree for each run of codes, bottom up in Gray order.

    A node holds the bits that all codes under it share, as mask and value; a search adds up the differences in the bits that its parent doesn't
    share already, and leaves a node, with all under it, as soon as the sum is over the radius.
    """

    def __init__(self, codes: np.ndarray, runs: np.ndarray) -> None:
        """codes: (n, 64-bit words), sorted by run, then Gray rank, each once in a run; runs: the run of each, ascending from 0 without gaps."""
        self.codes, self.levels = codes, []
        value, mask, run = codes, np.full(codes.shape, ~np.uint64(0)), runs
        while not self.levels or len(value) > runs[-1] + 1:
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            within = np.arange(len(run)) - np.repeat(starts, np.diff(np.r_[starts, len(run)]))
            head = np.flatnonzero(within % FAN == 0)
            end = np.r_[head[1:], len(run)]
            top = value[head]
            mask = np.bitwise_and.reduceat(~(value ^ np.repeat(top, end - head, axis=0)) & mask, head)
            value, run = top & mask, run[head]
            self.levels.append((head, end, value, mask))

    def pairs(self, queries: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j), i < j, of codes of one run that differ in `radius` bits at most, for the i in `queries` (indexes), whose runs are `runs`."""
        q, node = queries, runs  # the root of a run has its number
        above, far = np.zeros((len(q), self.codes.shape[1]), np.uint64), np.zeros(len(q), np.int64)
        for head, end, value, mask in reversed(self.levels):
            far = far + np.bitwise_count((self.codes[q] ^ value[node]) & mask[node] & ~above).sum(axis=1, dtype=np.int64)
            stay = far <= radius
            q, node, far = q[stay], node[stay], far[stay]
            width = end[node] - head[node]
            offset = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            child = np.repeat(head[node], width) + offset
            above, q, far, node = np.repeat(mask[node], width, axis=0), np.repeat(q, width), np.repeat(far, width), child
        stay = node > q
        q, node, above, far = q[stay], node[stay], above[stay], far[stay]
        near = far + np.bitwise_count((self.codes[q] ^ self.codes[node]) & ~above).sum(axis=1, dtype=np.int64) <= radius
        return q[near], node[near]


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the sets of a[i] and b[i]; returns the parents with all paths of length 1, and the smallest member as root."""
    while True:
        a, b = parent[a], parent[b]
        differ = a != b
        if not differ.any():
            return parent
        a, b = np.maximum(a, b)[differ], np.minimum(a, b)[differ]
        np.minimum.at(parent, a, b)
        while (up := parent[parent]) is not None and (up != parent).any():
            parent = up


def forest_edges(codes: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) that connect, in each run, just the codes that links of `radius` bits at most connect: each code to the root of its set."""
    forest, parent = GrayForest(codes, runs), np.arange(len(codes))
    # where hardly a node can be left out, as many pairs are compared at once as before; never under 64 codes
    cost = np.cumsum(np.bincount(runs)[runs] if radius > FAN else np.full(len(runs), PAIRS // BLOCK))
    at = 0
    while at < len(codes):
        to = max(at + 64, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")))
        q = np.arange(at, min(to, len(codes)))
        parent = _merge(parent, *forest.pairs(q, runs[q], radius))
        at = to
    moved = np.flatnonzero(parent != np.arange(len(codes)))
    return moved, parent[moved]


def _search(radius: int):
    def whole(mask: np.ndarray, key: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
        run = np.cumsum(new) - 1
        several = (np.bincount(run) > 1)[run]  # runs of one code have no links
        run, code = run[several], code[several]
        if len(code):
            run = np.unique(run, return_inverse=True)[1]
            order = np.lexsort((gray_rank(code), run))
            code = code[order]
            u, v = forest_edges(code[:, None], run[order], radius)
            yield pa.record_batch({"u": code[u].view(np.int64), "v": code[v].view(np.int64)})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rest = [np.concatenate(x) for x in zip(rest, (new[0], new[1], new[2].view(np.uint64)))]
            if len(rest[0]) >= ROWS:  # the last run may go on
                last = int(np.flatnonzero((rest[0] != rest[0][-1]) | (rest[1] != rest[1][-1]))[-1:].max(initial=-1)) + 1
                yield from whole(*(x[:last] for x in rest)) if last else ()
                rest = [x[last:] for x in rest]
        if len(rest[0]):
            yield from whole(*rest)

    return search


def links(codes: DataFrame, radius: int = 2, blocks: int = 6) -> DataFrame:
    """Edges (u, v) over the distinct non-null BIGINT `code`s that connect just what links of at most `radius` differing bits connect.

    The top nodes of the index are masked bit patterns: every code goes, by shuffle, to each pattern (all but `radius` of `blocks` blocks of bits), of
    which two linked codes share one at least. Under a pattern, a tree in Gray order is built and searched. A pattern of the default leaves at most 22
    bits free, so that even a group with every possible code is 4 million longs (32 MB); copies share one code. Each pattern gives a spanning forest,
    fewer edges than codes, whatever the number of links.
    """
    code = F.col("code")
    patterns = masks(radius, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in patterns]
    spread = codes.select("code").where(code.isNotNull()).distinct().select(F.posexplode(F.array(*[code.bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "key"), "code")
    dealt = spread.select(F.col("mask").cast("long"), "key", "code").repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(_search(radius), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint BIGINT, component_id) for every row of `docs`: component_id is the smallest id reachable over links of near fingerprints.

    Null, empty and white texts have fingerprint 0 and are linked like any other; a text of any length is one task's, which holds its shingles' hashes.
    Equal fingerprints are one node, however many rows have them: rows meet only in the aggregation of their smallest id (combined before the shuffle)
    and in a join that sends hot fingerprints to all tasks. Null ids are kept as rows, and count as no id; a component of null ids only has a null
    component_id. Other columns of `docs` are not read. No rows: no rows.
    """
    marked = kept(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("code")), "simhash")
    codes = marked.groupBy("code").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    roots = components(links(codes, radius, blocks)).withColumnRenamed("node", "code")
    named = codes.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = kept(named.join(least, "root").select("code", "component_id", "n"), "classes")
    return join_hot(marked, classes, "code").select(F.col("id").alias(id_col), F.col("code").alias("fingerprint"), "component_id")


#: Codes of a table's bucket above which it is searched in blocks, two at a time.
CROWD = 4096


def _tables(patterns: list[np.ndarray], codes: bool):
    """A row for each code and table: the table, the bits it looks at, and, if `codes`, the node and its code."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 32), axis=1)
                for mask, chosen in enumerate(patterns):
                    key = bits[:, chosen].astype(np.int64) @ (np.int64(1) << np.arange(len(chosen), dtype=np.int64))
                    found = [pa.array(np.full(len(key), mask, np.int32)), pa.array(key), *([batch.column(0), batch.column(1)] if codes else [])]
                    yield pa.record_batch(found, ["mask", "key", "node", "code"][: len(found)])

    return spread


def _wide_search(radius: int):
    def whole(rows: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        """All runs of some rows at once."""
        group = pa.concat_tables(rows)
        keys = np.stack([group[c].to_numpy().astype(np.int64) for c in ("mask", "key")])
        run = np.cumsum(np.r_[False, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        several = (np.bincount(run) > 1)[run]
        if several.any():
            run = np.unique(run[several], return_inverse=True)[1]
            node = group["node"].to_numpy()[several]
            code = np.frombuffer(b"".join(group["code"].filter(pa.array(several)).to_pylist()), ">u8").astype(np.uint64).reshape(-1, 4)
            order = np.lexsort((gray_rank(code[:, 0]), run))
            node = node[order]
            u, v = forest_edges(code[order], run[order], radius)
            yield pa.record_batch({"u": node[u], "v": node[v]})

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(x.num_rows for x in held) >= ROWS // 4:
                group = pa.concat_tables(held)
                keys = np.stack([group[c].to_numpy().astype(np.int64) for c in ("mask", "key")])
                last = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0)).max(initial=-1)) + 1
                if last:
                    yield from whole([group.slice(0, last)])
                held = [group.slice(last)]
        if held:
            yield from whole(held)

    return runs


def tables_for(bits: int, similarity: float, miss: float, width: int = 256) -> int:
    """How many tables that look at `bits` bits each let a pair of that Jaccard similarity be missed by all with probability `miss` at most.

    The pair differs in each bit with the same chance; the mean is over the binomial law of the bits in which it differs.
    """
    p, d = bit_chance(similarity), np.arange(width + 1)
    of = lambda x: np.array([lgamma(k + 1) for k in np.atleast_1d(x)])
    law = np.exp(of(width) - of(d) - of(width - d) + d * np.log(max(p, 1e-12)) + (width - d) * np.log1p(-p))
    apart, n = 1 - (1 - d / width) ** bits, 1
    while (law * apart**n).sum() > miss:
        n += 1
    return n


def wide_links(codes: DataFrame, similarity: float, miss: float = 0.005) -> DataFrame:
    """Edges (u, v) between the nodes of `codes` (node BIGINT, code BINARY(32)) that connect codes within bit_radius(similarity) of 256 bits.

    So wide a radius has no exact index; a table looks at some bits only, and links the codes that agree in these and are within the radius. Bits a
    table looks at: enough for 512 codes a bucket on average, and 12 at least. Tables: see tables_for; 45 up to 2 million codes, then more, as about the
    power 0.3 of the number of codes: 84 at 16 million, 241 at 10^9. A pair is never dropped for its bucket's size: see star_links for crowded ones.
    """
    n, radius = codes.count(), bit_radius(similarity)
    bits = min(40, max(12, (n // 512).bit_length()))
    number = tables_for(bits, similarity, miss)
    rng, patterns = np.random.default_rng(7), []
    while len(patterns) < number:
        order = rng.permutation(256)
        patterns += [np.sort(order[a : a + bits]) for a in range(0, 257 - bits, bits)][: number - len(patterns)]
    codes = codes.select("node", "code")
    spread = codes.mapInArrow(_tables(patterns, True), "mask int, key bigint, node bigint, code binary")
    keys = codes.mapInArrow(_tables(patterns, False), "mask int, key bigint")
    crowded = checkpointed(keys.groupBy("mask", "key").count().where(F.col("count") > CROWD).select("mask", "key", F.ceil(F.col("count") / CROWD).cast("int").alias("m")))
    few = crowded.limit(FEW + 1).count()
    if not few:
        dealt = spread.repartition("mask", "key").sortWithinPartitions("mask", "key")
        return dealt.mapInArrow(_wide_search(radius), "u bigint, v bigint")
    shared = F.broadcast(crowded) if few <= FEW else crowded
    dealt = spread.join(shared, ["mask", "key"], "left_anti").repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(_wide_search(radius), "u bigint, v bigint").union(star_links(spread, crowded, ["mask", "key"], radius, None))


#: Documents, and shingles, of a block in which candidates are confirmed, on average.
GROUP, GROUP_SHINGLES = 512, 1 << 22
#: Members of a large group with which all others are compared first; large groups that are sent to all tasks (more are joined).
LEADERS, FEW = 16, 20_000


def confirmed_edges(codes: np.ndarray, sets: list[np.ndarray] | None, radius: int, similarity: float | None, label: np.ndarray | None = None, of: int | None = None) -> list[tuple[int, int]]:
    """Edges (i, j) that connect just the sets that pairs of at least that Jaccard similarity, with codes within `radius`, connect.

    Of pairs that are connected already, at first those with the same label, none is measured again, so that a group of copies costs as many
    measurements as it has sets. `of`: only pairs of one of the first so many. Without sets, codes within the radius are enough.
    """
    label, found = np.arange(len(codes)) if label is None else label.copy(), []
    if sets is not None:
        size = np.array([len(x) for x in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        start = np.cumsum(size) - size
        held = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    for i in range(len(codes) - 1 if of is None else of):
        rest = np.arange(i + 1, len(codes))
        rest = rest[label[rest] != label[i]]
        if sets is not None:
            small, large = np.minimum(size[i], size[rest]), np.maximum(size[i], size[rest])
            rest = rest[small >= similarity * large - 1e-9]
        rest = rest[np.bitwise_count(codes[rest] ^ codes[i]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(rest):
            continue
        if sets is not None:
            own = ids[start[i] : start[i] + size[i]]
            held[own] = True
            common = np.array([np.count_nonzero(held[ids[start[j] : start[j] + size[j]]]) for j in rest])
            held[own] = False
            rest = rest[common >= similarity * (size[i] + size[rest] - common) - 1e-9]
        roots, first = np.unique(label[rest], return_index=True)
        found += [(i, int(j)) for j in rest[first]]
        label[np.isin(label, roots)] = label[i]
    return found


def _members(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray] | None]:
    """(nodes, codes, sets) of rows."""
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, 4)
    return rows["node"].to_numpy(), codes, [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()] if "shingles" in rows.column_names else None


def _confirm(radius: int, similarity: float):
    def of_run(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            codes = np.frombuffer(b"".join(r[1] for r in rows), ">u8").astype(np.uint64).reshape(-1, 4)
            found = confirmed_edges(codes, [np.frombuffer(r[2], np.uint64) for r in rows], radius, similarity)
            if found:
                yield pa.record_batch({"u": pa.array([rows[j][0] for _, j in found], pa.int64()), "v": pa.array([rows[i][0] for i, _ in found], pa.int64())})

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                root, node, code, shingles = (batch.column(c)[at].as_py() for c in range(4))
                if root != key:
                    yield from of_run(held)
                    key, held = root, []
                held.append((node, code, shingles))
        yield from of_run(held)

    return runs


def _star(group: list[str], radius: int, similarity: float | None):
    def match(rows: pa.Table, leaders: pa.Table) -> pa.Table:
        """Each member with the leaders that it is linked with, as bits and nodes; a leader is linked with itself."""
        made = pa.table({"bits": pa.array([], pa.int32()), "links": pa.array([], pa.list_(pa.int64()))})
        if rows.num_rows:
            node, codes, sets = _members(rows)
            mask, links = np.zeros(len(node), np.int32), [[] for _ in node]
            seen = {}
            for j, x in enumerate(leaders["leaders"][0].as_py()):
                bit = seen.setdefault(x["node"], j)  # a leader twice is one
                if bit != j:
                    continue
                code = np.frombuffer(x["code"], ">u8").astype(np.uint64)
                near = np.flatnonzero(np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64) <= radius)
                if sets is not None:
                    own = np.frombuffer(x["shingles"], np.uint64)
                    size = np.array([len(sets[i]) for i in near], np.int64)
                    near, size = (y[np.minimum(size, len(own)) >= similarity * np.maximum(size, len(own)) - 1e-9] for y in (near, size))
                    common = np.array([len(np.intersect1d(sets[i], own, assume_unique=True)) for i in near], np.int64)
                    near = near[common >= similarity * (size + len(own) - common) - 1e-9]
                mask[near] |= 1 << j
                mask[node == x["node"]] |= 1 << j
                for i in near:
                    if node[i] != x["node"]:
                        links[i].append(x["node"])
            made = pa.table({"bits": pa.array(mask), "links": pa.array(links, pa.list_(pa.int64()))})
        return pa.table([*(rows[c] for c in (*group, "node")), made["bits"], made["links"]], [*group, "node", "bits", "links"])

    return match


def main_class(masks_: list[int], counts: list[int]) -> int:
    """The leaders of the class with the most members, as bits: leaders that a member is linked with, are in one class."""
    classes: list[list[int]] = []  # bits, members
    for mask, n in zip(masks_, counts):
        joined = [c for c in classes if c[0] & mask]
        classes = [c for c in classes if not c[0] & mask] + [[mask | sum(c[0] for c in joined), n + sum(c[1] for c in joined)]] * (mask != 0)
    return max(classes, key=lambda c: (c[1], -c[0]), default=[0, 0])[0]


def _rest(radius: int, similarity: float | None):
    def match(open_: pa.Table, rows: pa.Table) -> pa.Table:
        """Edges of the members outside the main class, among one another and with all others."""
        found: list[tuple[int, int]] = []
        if open_.num_rows and rows.num_rows:
            both = pa.concat_tables([x.select([c for c in ("node", "code", "shingles") if c in x.column_names]) for x in (open_, rows)])
            node, codes, sets = _members(both)
            main = np.r_[np.zeros(open_.num_rows, bool), rows["main"].to_numpy()]
            label = np.unique(node, return_inverse=True)[1]
            label[main] = -1
            found = [(int(node[j]), int(node[i])) for i, j in confirmed_edges(codes, sets, radius, similarity, label, open_.num_rows)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], ["u", "v"])

    return match


def star_links(rows: DataFrame, large: DataFrame, group: list[str], radius: int, similarity: float | None) -> DataFrame:
    """Edges (u, v) that connect, in each group of `rows` (group, node, code, maybe shingles) that is in `large` (group, m), just what links connect.

    All members, in `m` blocks, are compared with a few leaders of their group. Members that are linked, through leaders, with most others are the main
    class, and needn't be compared with one another; each member outside it is compared with all others, block by block. So a group of copies of
    one text, however many, costs a few comparisons for each, and no link is lost in others.
    """
    few = F.broadcast(large) if large.limit(FEW + 1).count() <= FEW else large
    payload = [c for c in ("node", "code", "shingles") if c in rows.columns]
    rows = kept(rows.join(few, group).select(*group, *payload, "m"), "large")
    lead = rows.groupBy(*group).agg(*[F.min_by(F.struct(*payload), F.xxhash64("node", F.lit(j))).alias(f"l{j}") for j in range(LEADERS)], F.max("m").alias("m"))
    lead = lead.select(*group, F.array(*[f"l{j}" for j in range(LEADERS)]).alias("leaders"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("a"))
    block = F.pmod(F.xxhash64("node", F.lit(-1)), F.col("m")).cast("int")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group)
    met = rows.withColumn("a", block).select(*group, "a", *payload).groupBy(*group, "a").cogroup(lead.groupBy(*group, "a"))
    star = kept(met.applyInArrow(_star(group, radius, similarity), f"{kinds}, node bigint, bits int, links array<bigint>"), "star")

    @F.arrow_udf("int")
    def most(masks_: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.array([main_class(a, b) for a, b in zip(masks_.to_pylist(), counts.to_pylist())], pa.int32())

    counts = star.groupBy(*group, "bits").agg(F.count("*").alias("n")).groupBy(*group).agg(F.collect_list(F.struct("bits", "n")).alias("x"))
    main = counts.select(*group, most("x.bits", "x.n").alias("_main"))
    linked = star.select(F.col("node").alias("u"), F.explode("links").alias("v"))
    placed = kept(star.join(main, group).select(*group, "node", (F.col("bits").bitwiseAND(F.col("_main")) != 0).alias("main")), "placed")
    rest = placed.where("NOT main")
    if rest.isEmpty():
        return linked
    sizes = rest.groupBy(*group).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("k"))
    every = kept(rows.join(sizes, group).join(placed, [*group, "node"]), "every")
    each = every.withColumn("a", block).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(*group, "a", "b", *payload, "main")
    own = F.pmod(F.xxhash64("node", F.lit(-2)), F.col("k")).cast("int")
    open_ = every.where("NOT main").withColumn("b", own).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(*[F.col(c).alias(c) for c in (*group, "a", "b", *payload)])
    keys = [*group, "a", "b"]
    return linked.union(open_.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(_rest(radius, similarity), "u bigint, v bigint"))


def confirmed_links(docs: DataFrame, candidates: DataFrame, words: int, radius: int, similarity: float) -> DataFrame:
    """Edges (u, v) between documents of `docs` (id, text) whose shingle sets have the Jaccard similarity; looked for in each group of `candidates`.

    candidates: (node, root), a row for each id but the root of each group. The sets are made again from the texts of the groups' documents alone, as
    64-bit hashes, and each pair of a group that is within `radius` bits is measured, or connected by such pairs (see star_links for large groups).
    """

    @F.arrow_udf("struct<key: binary, code: binary, n: int, shingles: binary>")
    def described(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py(), words, 42) for t in texts.cast(pa.binary())]
        columns = [[set_key(x) for x in sets], [wide_fingerprint(x) for x in sets], [len(x) for x in sets], [x.tobytes() for x in sets]]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32(), pa.binary()))], ["key", "code", "n", "shingles"])

    members = candidates.select("node", "root").union(candidates.select(F.col("root").alias("node"), "root")).distinct()
    sets = docs.join(members, docs["id"].cast("long") == members["node"]).select("node", "root", described("text").alias("s"))
    sets = sets.groupBy("node", "root", "s.key").agg(F.first("s.code").alias("code"), F.first("s.n").alias("n"), F.first("s.shingles").alias("shingles"))
    sets = kept(sets, "shingles")
    blocks = sets.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_SHINGLES)).cast("int").alias("m"))
    large = checkpointed(blocks.where("m > 1"))
    few = large.limit(FEW + 1).count()
    small = sets.join(F.broadcast(large) if few <= FEW else large, "root", "left_anti") if few else sets
    dealt = small.select("root", "node", "code", "shingles").repartition("root").sortWithinPartitions("root")
    found = dealt.mapInArrow(_confirm(radius, similarity), "u bigint, v bigint")
    return found.union(star_links(sets.select("root", "node", "code", "shingles"), large, ["root"], radius, similarity)) if few else found


def bit_chance(similarity: float) -> float:
    """The chance that two texts of that Jaccard similarity differ in a bit."""
    return float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)


def bit_radius(similarity: float, width: int = 256, spare: float = 3.0) -> int:
    """Bits in which two texts of that Jaccard similarity differ, as expected, and `spare` standard deviations more."""
    p = bit_chance(similarity)
    return int(width * p + spare * np.sqrt(width * p * (1 - p)))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a shingle_set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without those that are near copies of one of a smaller id: sets of shingles of `words` words, Jaccard similarity from `similarity`.

    Candidates are linked by SimHash fingerprints of 256 bits, made from the different shingles (see wide_links, bit_radius); a pair of candidates counts
    only if the sets themselves, as 64-bit hashes, are as similar (see confirmed_links). Of each group connected by such pairs the rows of the smallest
    id stay, with all columns. Equal sets are one node and always found; null and empty texts are one group. Rows that share an id are one document; rows
    with a null id stay. No rows: no rows.
    """

    @F.arrow_udf("struct<key: binary, code: binary>")
    def wide(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py(), words, 42) for t in texts.cast(pa.binary())]
        return pa.StructArray.from_arrays([pa.array([set_key(x) for x in sets], pa.binary()), pa.array([wide_fingerprint(x) for x in sets], pa.binary())], ["key", "code"])

    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = kept(own.select("id", wide("text").alias("s")).select("id", "s.key", "s.code"), "wide")
    classes = checkpointed(marked.groupBy("key").agg(F.min("id").cast("long").alias("node"), F.min("code").alias("code"), F.count("*").alias("n")))
    radius = bit_radius(similarity)
    candidates = components(wide_links(classes.select("node", "code"), similarity))
    roots = components(confirmed_links(own, candidates, words, radius, similarity))
    firsts = kept(classes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("first"), "n"), "firsts")
    gone = join_hot(marked.select("id", "key"), firsts, "key").where("id != first").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents; see near_duplicates."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE_SQL: dict[str, str] = {}
