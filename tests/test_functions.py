import hashlib
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import delta as D
from loam.functions import gf256 as G
from loam.functions import hashing as H
from loam.functions import text as T
from loam.functions.chunking import ChunkSpec, chunk_ranges, cut_points
from loam.functions.features import finesse, n_transform

# chunking


def slow_cuts(data, spec):
    """One byte at a time."""
    bits = spec.avg.bit_length() - 1
    ends, start = [], 0
    while start + spec.min <= len(data):
        end = start + spec.min
        while end < min(start + spec.max, len(data)) and sum(data[end - 1 - t] * pow(257, t, 1 << 23) for t in range(spec.window)) % (1 << 23) & ((1 << bits) - 1):
            end += 1
        ends.append(end)
        start = end
    return ends if not data or ends and ends[-1] == len(data) else [*ends, len(data)]


@given(st.binary(max_size=900), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_content_defined_cuts(data, times):
    spec = ChunkSpec("cdc", 64, 48, 200, 8)
    data = data * (times + 1)
    assert cut_points(data, spec) == slow_cuts(data, spec)


@pytest.mark.parametrize("n,sizes", [(0, []), (1, [1]), (8192, [8192]), (8193, [8192, 1]), (16384, [8192, 8192])])
def test_fixed_chunks(spark, n, sizes):
    got = spark.createDataFrame([(b"x" * n,)], "content binary").select(chunk_ranges(F.col("content"), ChunkSpec()).alias("r")).first().r
    assert [r["size"] for r in got] == sizes and cut_points(b"x" * n, ChunkSpec()) == list(np.cumsum(sizes))


def test_chunk_specs():
    for wrong in (dict(method="other"), dict(avg=0), dict(method="cdc", min=9000), dict(method="cdc", max=8000), dict(method="cdc", avg=5000), dict(method="cdc", min=10)):
        with pytest.raises(ValueError):
            ChunkSpec(**wrong)


# hashing


def test_rabin_fingerprints_roll():
    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    got = H.rabin_fingerprints(data)
    for i in (0, 1, 46, 47, 48, 120, 299):
        window = data[max(0, i - 47) : i + 1].tobytes()
        assert int(got[i]) == H.poly_mod(int.from_bytes(window, "big"), H.POLYNOMIAL) < 1 << 63


def test_polynomials():
    assert H.poly_mul(0b101, 0b11) == 0b1111 and H.poly_mod(0b1111, 0b101) == 0
    assert H.poly_mul_mod(0xFFFF, 0xABCDEF, H.POLYNOMIAL) == H.poly_mod(H.poly_mul(0xFFFF, 0xABCDEF), H.POLYNOMIAL)


def test_keys(spark):
    rows = [("/a", 7), ("/b", -1), ("/ü", 2**31 - 1), ("/a", 70000)]
    df = spark.createDataFrame(rows, "n string, u int")
    for r in df.select("n", "u", H.recipe_fingerprint(F.col("n"), F.col("u")).alias("f"), H.little_endian(F.col("u")).alias("b")).collect():
        assert bytes(r.b) == struct.pack("<i", r.u) and r.f == hashlib.sha256(r.n.encode() + struct.pack("<i", r.u)).hexdigest()
    fp = hashlib.sha256(b"x").hexdigest()
    one = spark.createDataFrame([(fp,)], "f string").select(H.index_key(F.col("f")).alias("k"), H.index_key(F.col("f"), 0).alias("r")).first()
    assert bytes(one.k) == b"\x01" + bytes.fromhex(fp) and bytes(one.r)[0] == 0
    with pytest.raises(ValueError):
        H.digest(F.col("f"), "crc")


def test_similar_data_share_a_key():
    data = random.Random(2).randbytes(4000)
    same = sum(H.rabin_key_of(data[:i] + b"!" + data[i + 1 :]) == H.rabin_key_of(data) for i in range(0, 4000, 100))
    assert same >= 35 and len(H.rabin_key_of(b"")) == 16


# features


def test_features():
    data = random.Random(3).randbytes(2000)
    other = data[:100] + b"#" + data[101:]
    for f in (finesse, n_transform):
        assert f(data) == f(data) and f(b"x" * 47) is None
        assert len(set(f(data)) & set(f(other))) >= 1
        assert not set(f(data)) & set(f(random.Random(4).randbytes(2000)))


# deltas


def mutated(data, how, rng):
    a, n = rng.randrange(max(1, len(data))), rng.randint(1, 60)
    piece = rng.randbytes(n)
    b = rng.randrange(max(1, len(data)))
    return {
        "modify": data[:a] + piece + data[a + n :],
        "add": data[:a] + piece + data[a:],
        "delete": data[:a] + data[a + n :],
        "copy": data[:b] + data[a : a + n] + data[b:],
        "move": data[:a] + data[a + n :] + data[a : a + n],
        "overwrite": data[:a] + b"\0" * n + data[a + n :],
        "run": data[:a] + b"z" * 300 + data[a:],
    }[how]


@pytest.mark.parametrize("size", [128, 200, 1024, 8192])
@pytest.mark.parametrize("how", ["modify", "add", "delete", "copy", "move", "overwrite", "run"])
def test_delta_round_trip(how, size):
    rng = random.Random(size)
    base = rng.randbytes(size)
    once = mutated(base, how, rng)
    twice = mutated(once, "modify", rng)
    first, second = D.instructions(base, once), D.instructions(once, twice)
    assert D.decode(base, D.encode(base, once)) == once
    assert D.apply(base, D.merge(first, second)) == twice
    if size == 8192:
        assert len(D.encode(base, once)) < 400


@given(st.binary(max_size=400), st.binary(max_size=400))
@settings(max_examples=100, deadline=None)
def test_delta_of_anything(base, source):
    assert D.decode(base, D.encode(base, source)) == source


def test_small_delta_and_damage():
    base = bytes(random.Random(5).choices(range(97, 123), k=256))
    source = base[:128] + b"\0" * 16 + base[144:]
    delta = D.encode(base, source)
    assert len(delta) < 128
    for wrong in (b"\x80", b"\x03", b"\x29ab", D.pack([D.Op("COPY", 200, 100, b"")])):
        with pytest.raises(ValueError):
            D.decode(base, wrong)


def test_delta_limits(spark):
    rng = random.Random(6)
    b = rng.randbytes(1024)
    rows = [(b[:1023], b[:600]), (b, b[:511]), (b, b[:512]), (b, rng.randbytes(600)), (None, b), (b, None)]
    df = spark.createDataFrame([(*map(lambda x: x and bytearray(x), r),) for r in rows], "b binary, s binary")
    for secondary in D.SECONDARY:
        got = df.withColumn("d", D.delta_encode(F.col("b"), F.col("s"), secondary))
        assert [r.d is not None for r in got.collect()] == [False, False, True, False, False, False]
        assert all(r.s == r.x for r in got.where("d is not null").withColumn("x", D.delta_decode(F.col("b"), F.col("d"), secondary)).collect())


# finite field


def test_field():
    mul = G.products()
    assert all(mul[a, G.inverse(a)] == 1 for a in range(1, 256)) and (mul == mul.T).all() and mul[2, 128] == 0x1D
    assert G.cauchy_rs(4, 3)[3].tolist() == [1, 142, 244]
    with pytest.raises(ValueError):
        G.invert(np.array([[1, 2], [1, 2]], np.uint8))
    with pytest.raises(ZeroDivisionError):
        G.inverse(0)


@pytest.mark.parametrize("n,k", [(4, 3), (6, 4), (9, 3)])
def test_any_k_rows_can_be_inverted(n, k):
    from itertools import combinations

    for matrix in (G.cauchy_rs(n, k), G.cauchy_full(n, k)):
        for rows in combinations(range(n), k):
            part = matrix[list(rows)]
            assert (G.times(G.invert(part), part) == np.eye(k)).all()


# text


def test_names(spark):
    df = spark.createDataFrame([("a",), ("/a",), (None,)], "n string")
    assert [r.f for r in df.select(T.file_name(F.col("n")).alias("f")).collect()] == ["/a", "/a", None]
    for wrong in ("", "./a", "../a"):
        with pytest.raises(Exception, match="not a file name"):
            spark.createDataFrame([(wrong,)], "n string").select(T.file_name(F.col("n"))).collect()
    sizes = spark.createDataFrame([(0,), (1023,), ((3 << 30) + (5 << 20) + (7 << 10) + 9,)], "s bigint")
    assert [r.t for r in sizes.select(T.size_text(F.col("s")).alias("t")).collect()] == ["0G 0M 0K", "0G 0M 0K", "3G 5M 7K"]
    names = spark.createDataFrame([(0,), (27,), (26**3,)], "o bigint").select(T.container_name(F.col("o")).alias("c"))
    assert [r.c for r in names.collect()] == ["a" * 16, "bb" + "a" * 14, "aaab" + "a" * 12]


def slow_fingerprints(data):
    """Rabin fingerprints of the last 48 bytes at each byte, byte at a time."""
    from loam.functions.hashing import POLYNOMIAL, WINDOW, poly_mod

    gone = [poly_mod(b << 8 * WINDOW, POLYNOMIAL) for b in range(256)]
    top = [poly_mod(b << 63, POLYNOMIAL) for b in range(256)]
    found, f = [], 0
    for i, b in enumerate(data):
        f = (f << 8 | b) ^ (gone[data[i - WINDOW]] if i >= WINDOW else 0)
        f = f & (1 << 63) - 1 ^ top[f >> 63]
        found.append(f)
    return found


def test_features_and_keys_of_the_table_byte_at_a_time(spark, sf):
    """Keys and both kinds of super-features of every chunk of the table, against sequential calculations."""
    import xxhash

    from loam.functions.features import LINEAR_MAPS
    from loam.plans.queries import QUERIES

    def hashed(a, b):
        return int.from_bytes(xxhash.xxh64_digest(a.to_bytes(8, "little") + b.to_bytes(8, "little"), 12345678), "big", signed=True)

    chunks = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r.text.encode()
        chunks |= {(r.doc_id, size, i): text[i * size : (i + 1) * size] for size in (1024, 2048) for i in range(-(-len(text) // size))}
    keys = {(r.doc_id, r.secret_id): r.key for r in QUERIES["rabin_key"](spark, sf).collect()}
    prints = {x: slow_fingerprints(x) for x in set(chunks.values())}
    for (doc, size, i), x in chunks.items():
        if size == 1024:
            top = max(prints[x])
            assert keys[doc, i] == ((top ^ top >> 32) & 0xFFFFFFFF).to_bytes(4, "little").hex() * 4
    names = {hashlib.sha256(x).hexdigest(): x for (_, size, _), x in chunks.items() if size == 2048}
    for query in ("super_features_finesse", "super_features_ntransform"):
        rows = QUERIES[query](spark, sf).collect()
        assert {r.share_fp for r in rows} == set(names)
        for r in rows:
            x, n = names[r.share_fp], len(names[r.share_fp])
            if n < 48:
                want = (None,) * 3
            elif query.endswith("finesse"):
                part = n // 6
                tops = [max(prints[x][47 + m * part : 48 + (m + 1) * part], default=0) for m in range(6)]
                want = tuple(map(hashed, sorted(tops[:3], reverse=True), sorted(tops[3:], reverse=True)))
            else:
                tops = [max((f * a + b) % 2**32 for f in prints[x][47:]) for a, b in LINEAR_MAPS]
                want = tuple(map(hashed, tops[::2], tops[1::2]))
            assert (r.sf1, r.sf2, r.sf3) == want


def slow_instructions(base, source):
    """Blocks of 16 bytes of the base, looked for and extended byte at a time."""
    ops, at, added, index = [], 0, 0, {}
    for i in reversed(range(0, len(base) - 15, 16)):
        index[base[i : i + 16]] = i

    def literal(x):
        i = start = 0
        while i < len(x):
            end = next((j for j in range(i, len(x)) if x[j] != x[i]), len(x))
            if end - i >= 24:
                ops.extend([D.Op("ADD", 0, i - start, x[start:i])] * (start < i) + [D.Op("RUN", 0, end - i, x[i : i + 1])])
                start = end
            i = end
        ops.extend([D.Op("ADD", 0, len(x) - start, x[start:])] * (start < len(x)))

    while at + 16 <= len(source):
        found = index.get(source[at : at + 16])
        if found is None:
            at += 1
            continue
        back = 0
        while back < min(at - added, found) and source[at - back - 1] == base[found - back - 1]:
            back += 1
        ahead = 16
        while at + ahead < len(source) and found + ahead < len(base) and source[at + ahead] == base[found + ahead]:
            ahead += 1
        literal(source[added : at - back])
        ops.append(D.Op("COPY", found - back, back + ahead, b""))
        at = added = at + ahead
    literal(source[added:])
    return ops


@given(st.lists(st.one_of(st.tuples(st.integers(0, 999), st.integers(0, 300)), st.binary(max_size=30), st.integers(20, 40)), max_size=8), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_instructions_byte_at_a_time(parts, seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab") for _ in range(500)) + rng.randbytes(500)
    source = b"".join(base[p[0] : p[0] + p[1]] if isinstance(p, tuple) else b"z" * p if isinstance(p, int) else p for p in parts)
    found = D.instructions(base, source)
    assert found == slow_instructions(base, source) and D.apply(base, found) == source


def test_deltas_of_the_table_byte_at_a_time(spark, sf):
    """Every delta of the table is what the calculation byte at a time gives for the same base."""
    from loam.plans.queries import QUERIES

    names = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r.text.encode()
        names |= {hashlib.sha256(x).hexdigest(): x for i in range(0, len(text), 2048) if (x := text[i : i + 2048])}
    rows = QUERIES["delta_encode"](spark, sf).collect()
    assert {r.share_fp for r in rows} == set(names)
    for r in rows:
        if r.base_fp:
            assert r.delta_size == len(D.pack(slow_instructions(names[r.base_fp], names[r.share_fp]))) <= r.share_size
    assert any(r.base_fp for r in rows)


def test_merged_deltas_of_many_instructions():
    rng = random.Random(3)
    a = rng.randbytes(20_000)
    b = b"".join(x for i in range(0, 20_000, 40) for x in (a[i : i + 40], rng.randbytes(2)))
    c = b"".join(x for i in range(0, len(b), 60) for x in (b[i : i + 60], rng.randbytes(1)))
    merged = D.merge(D.instructions(a, b), D.instructions(b, c))
    assert D.apply(a, merged) == c
