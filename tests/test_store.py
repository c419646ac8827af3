"""The store's operators on hand-made files, and the store as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from loam.functions.chunking import ChunkSpec
from loam.functions.features import super_features
from loam.operators import codec, dedup, packing, recipes, similarity
from loam.operators.chunks import is_zero, secrets
from loam.operators.codec import CodecSpec
from loam.operators.metrics import Laps
from loam.plans.store import DedupStore, StoreConfig
from loam.sources import files as S
from loam.streaming.ingest import append_to, stream_files

RNG = random.Random(11)
BIG = RNG.randbytes(40_000)


def files_of(spark, rows):
    return spark.createDataFrame([(u, n, bytearray(c), len(c), i) for i, (u, n, c) in enumerate(rows)], S.FILES)


FILES = [(1, "/empty", b""), (1, "/one", b"x"), (1, "/exact", BIG[:8192]), (2, "/exact1", BIG[:8193]), (2, "/zeros", bytes(20_000)), (3, "/twice", BIG[:8192] * 2), (1, "/again", BIG[:8192]), (3, "/big", BIG), (4, "/near", BIG[:9000] + b"!!" + BIG[9000:])]


def test_secrets_and_classes(spark):
    found = secrets(files_of(spark, FILES))
    assert [(r.file_name, r.secret_size) for r in found.where("is_last").orderBy("seq").collect()] == [("/one", 1), ("/exact", 8192), ("/exact1", 1), ("/zeros", 3616), ("/twice", 8192), ("/again", 8192), ("/big", 7232), ("/near", 7234)]
    assert found.where(is_zero(F.col("data"))).count() == 3
    classes = {(r.file_name, r.secret_id): r.dup_class for r in dedup.classify(dedup.plain_shares(found)).collect()}
    assert classes["/exact", 0] == "new" and classes["/exact1", 0] == "inter" and classes["/zeros", 1] == "intra"
    assert classes["/twice", 0] == "inter" and classes["/twice", 1] == "intra" and classes["/again", 0] == "intra"


def test_stages_with_an_index(spark):
    shares = dedup.plain_shares(secrets(files_of(spark, FILES))).withColumn("fragment", F.lit(0))
    first = dedup.first_stage(shares)
    owned = {(r.file_name, r.secret_id) for r in first.where("owned").collect()}
    assert owned == {("/again", 0), ("/big", 0)}  # repeats in a fragment pass the first stage
    actions = {(r.file_name, r.secret_id): r.action for r in dedup.second_stage(first).collect()}
    assert actions["/twice", 1] == "duplicate" and actions["/exact", 0] == "store" and actions["/again", 0] == "skip"
    index = dedup.share_index(shares)
    assert dedup.first_stage(shares, index).where("not owned").count() == 0
    other = shares.withColumn("user_id", F.lit(99))
    assert {r.action for r in dedup.second_stage(dedup.first_stage(other, index), index).collect()} <= {"duplicate", "skip"}
    assert dedup.upsert_index(index, other).where("not array_contains(users, 99)").count() == 0


def test_packing(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate([100, 156, 1, 256, 300, 10])], "g int, i int, n int")
    got = packing.pack(rows, ["g"], ["i"], "n", 256).orderBy("i").collect()
    assert [(r.bin, r.offset) for r in got] == [(0, 0), (0, 100), (1, 0), (2, 0), (3, 0), (4, 0)]


@pytest.mark.parametrize("kind", ["caont", "caont_old", "aont", "crsss"])
@pytest.mark.parametrize("security", ["low", "high"])
def test_codecs(spark, kind, security):
    spec = CodecSpec(kind, 5, 2, 1, security, 7)
    found = secrets(files_of(spark, FILES))
    shares = codec.encode_shares(found, spec).cache()
    want = {(r.seq, r.secret_id): bytes(r.data) for r in found.collect()}
    sizes = shares.withColumn("want", codec.share_size(F.col("secret_size"), spec))
    assert sizes.where("share_size != want").count() == 0
    for clouds in ([0, 1, 2], [0, 3, 4], [2, 3, 4]):
        got = {(r.seq, r.secret_id): bytes(r.data) for r in codec.decode_shares(shares, ["seq", "secret_id"], spec, clouds).collect()}
        assert got == want
    equal = shares.where("file_name in ('/exact', '/again') and cloud = 4").select(F.count_distinct("data")).first()[0]
    assert equal == (2 if kind == "aont" else 1)
    with pytest.raises(Exception, match="a share is missing"):
        codec.decode_shares(shares.where("cloud != 1 or seq != 1"), ["seq", "secret_id"], spec).collect()
    if kind != "aont":
        broken = shares.withColumn("data", F.when(F.col("cloud") == 0, F.unhex(F.concat(F.lit("AA"), F.substring(F.hex("data"), 3, 100_000)))).otherwise(F.col("data")))
        with pytest.raises(Exception, match="match"):
            codec.decode_shares(broken, ["seq", "secret_id"], spec).collect()
    shares.unpersist()


@pytest.mark.parametrize("size,want", [(8192, 2736), (1, 16), (100, 48), (4096, 1376), (16384, 5472)])
def test_share_sizes(spark, size, want):
    assert spark.range(1).select(codec.share_size(F.lit(size), CodecSpec())).first()[0] == want


def test_codec_specs():
    for wrong in (dict(kind="x"), dict(m=0), dict(m=4), dict(security="mid"), dict(kind="crsss", r=3)):
        with pytest.raises(ValueError):
            CodecSpec(**wrong)
    with pytest.raises(ValueError):
        codec.decode_shares(None, [], CodecSpec("none"))
    with pytest.raises(ValueError):
        codec.decode_shares(None, [], CodecSpec(), [0, 0, 1])


def similar(spark, n):
    rows = [(0, f"s{i}", i, 0, bytearray(BIG[:3000] + bytes([i]) * 3 + BIG[3003:4000])) for i in range(n)]
    df = spark.createDataFrame(rows, "cloud int, share_fp string, seq bigint, secret_id int, data binary")
    return df.withColumns({"share_size": F.octet_length("data"), "features": super_features(F.col("data"))})


def test_delta_policies(spark):
    shares = similar(spark, 4)
    strict = {r.share_fp: (r.base_fp, r.delta_depth) for r in similarity.strict_deltas(shares).collect()}
    assert strict == {"s0": (None, 0), "s1": ("s0", 1), "s2": (None, 0), "s3": ("s2", 1)}  # the last writer's depth is 1 every other time
    chosen = similarity.select_bases(shares.drop("data"))
    stored = similarity.with_deltas(chosen, shares.select("cloud", "share_fp", "data"))
    assert {r.share_fp: r.base_fp for r in stored.collect()} == {"s0": None, "s1": "s0", "s2": "s0", "s3": "s0"}
    back = {r.share_fp: bytes(r.data) for r in similarity.resolve_deltas(stored).collect()}
    assert back == {r.share_fp: bytes(r.data) for r in shares.collect()}
    with pytest.raises(ValueError):
        similarity.select_bases(shares, "other")


def test_missing_pieces_raise(spark):
    found = secrets(files_of(spark, FILES))
    shares = dedup.plain_shares(found)
    made = recipes.recipes(shares)
    assert recipes.read_recipe(made, "/big", 3).count() == 1
    with pytest.raises(Exception, match="no recipe of /nowhere"):
        recipes.read_recipe(made, "/nowhere", 3).collect()
    none = found.limit(0).select(F.lit(0).alias("cloud"), F.lit("").alias("share_fp"), "data")
    with pytest.raises(Exception, match="no share"):
        recipes.restore(recipes.recipe_entries(shares), none).collect()


@pytest.mark.parametrize("config", [StoreConfig(ChunkSpec("fixed", 4096)), StoreConfig(ChunkSpec("cdc", 4096, 1024, 16384), CodecSpec(n=5, m=2)), StoreConfig(delta=False)])
def test_store(spark, tmp_path, config):
    store = DedupStore(spark, f"file://{tmp_path}/store", config)
    store.ingest(files_of(spark, FILES))
    newer = files_of(spark, [(1, "/one", BIG[:5000]), (9, "/other", BIG[100:20_000])]).withColumn("seq", F.col("seq") + 100)
    store.ingest(newer)
    want = {(u, n): c for u, n, c in FILES} | {(1, "/one"): BIG[:5000], (9, "/other"): BIG[100:20_000]}
    assert {(r.user_id, r.file_name): bytes(r.content) for r in store.restore().collect()} == want
    one = spark.createDataFrame([(3, "/big")], "user_id int, file_name string")
    clouds = [1, 2, 4] if config.codec else None
    assert [bytes(r.content) for r in store.restore(one, clouds).collect()] == [BIG]
    for r in store.report().collect():
        assert r.total == r.n_unique + r.delta + r.duplicate and r.duplicate == r.intra_dup + r.inter_dup
    assert {"chunk, encode, hash", "recipes", "classify", "containers", "commit"} <= set(store.laps.seconds)
    found = store.restore_report(one, clouds).first()
    assert (found.files, found.bytes) == (1, len(BIG)) and found.unique_shares + found.delta_shares >= 3 and found.restore_s > 0
    assert store.restore_report().first().files == len(want)
    index = store.index()
    assert index.select("cloud", "share_fp").distinct().count() == index.count()
    packed = store._table("containers").groupBy("ingest", "cloud", "lane", "container").agg(F.max(F.col("offset") + F.col("length")).alias("end"), F.sum("length").alias("sum"))
    assert packed.where(f"end != sum or end > {packing.CONTAINER}").count() == 0
    S.write_files(store.restore(), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").where("not endswith(file_name, '.decode')").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"abc")
    got = S.folder_files(spark, str(tmp_path), 5).collect()
    assert [(r.user_id, bytes(r.content), r.file_size) for r in got] == [(5, b"abc", 3)] and got[0].file_name.endswith("/d/a.bin")
    assert S.ServerConfig.parse("nonsense") == S.ServerConfig() and S.ServerConfig.parse("[]") == S.ServerConfig()
    assert S.ServerConfig.parse('{"cluster": [{"ip": "h", "port": "9"}], "clean": true}') == S.ServerConfig(1, "database", "container", True, (("h", 9),))
    assert S.parse_client_config("a:1\n\nb:22\n") == [("a", 1), ("b", 22)]


def test_stream_of_first_shares(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = stream_files(spark, f"{sf}/documents.parquet*", schema)
    shares = dedup.plain_shares(secrets(S.document_files(rows), ChunkSpec("fixed", 512)))
    append_to(shares, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    whole = dedup.plain_shares(secrets(S.document_files(spark.read.parquet(f"{sf}/documents.parquet")), ChunkSpec("fixed", 512)))
    assert out.count() == whole.select("share_fp").distinct().count()


def test_laps():
    laps = Laps()
    for _ in range(2):
        with laps("a"):
            pass
    assert laps.seconds["a"] >= 0


def test_sql_functions(spark, sf):
    from loam.plans.sql import register_functions, register_views

    register_views(spark, sf, ("documents", "orders"))
    register_functions(spark)
    got = spark.sql("SELECT length(rabin_key(encode(text, 'UTF-8'))) AS n, size(super_features_finesse(encode(repeat(text, 9), 'UTF-8'))) AS f FROM documents").distinct().collect()
    assert all(r.n == 16 for r in got) and {r.f for r in got} <= {3, None}
    back = spark.sql("SELECT count(*) AS n FROM (SELECT encode(text, 'UTF-8') AS a, encode(concat('x', text), 'UTF-8') AS b FROM documents) WHERE delta_decode(a, delta_encode(a, b)) = b")
    assert back.first().n == spark.table("documents").count()
    back = spark.sql("SELECT count(*) AS n FROM documents WHERE vcdiff_decode(encode('some text', 'UTF-8'), vcdiff_encode(encode('some text', 'UTF-8'), encode(text, 'UTF-8'))) = encode(text, 'UTF-8')")
    assert back.first().n == spark.table("documents").count()
    cut = spark.sql("SELECT count(*) AS n, max(c.secret_size) AS m FROM documents, LATERAL cdc_chunks(encode(text, 'UTF-8'), 256) c").first()
    assert cut.n > 200 and cut.m <= 512


def test_layout(spark):
    from loam.functions.layout import pack_entry, unpack_entry

    rows = [("ab" * 32, 0, -1, 2**31 - 1), ("cd" * 32, 70000, 8192, 2736), (None, 1, 2, 3)]
    df = spark.createDataFrame(rows, "f string, a int, b int, c int")
    packed = df.withColumn("p", pack_entry(F.col("f"), F.col("a"), F.col("b"), F.col("c")))
    got = packed.withColumn("u", unpack_entry(F.col("p"))).collect()
    assert [tuple(r.u) for r in got[:2]] == rows[:2] and got[2].p is None and len(got[0].p) == 44


def test_a_store_that_is_opened_again(spark, tmp_path):
    """Changed, unchanged and empty files, in three sessions' ingests; read from containers, and without duplicates on disk."""
    at, config = f"file://{tmp_path}/store", StoreConfig(ChunkSpec("fixed", 4096))
    (tmp_path / "in").mkdir()
    names = {"same": BIG[:20_000], "changed": BIG[:5000], "empty": b"", "filled": b""} | {f"copy{i}": BIG for i in range(10)}
    for name, content in names.items():
        (tmp_path / "in" / name).write_bytes(content)
    DedupStore(spark, at, config).ingest(S.folder_files(spark, f"{tmp_path}/in", 7))
    names |= {"changed": BIG[10_000:15_000], "filled": b"now it has", "new": BIG[39_000:]}
    for name in ("changed", "filled", "new"):
        (tmp_path / "in" / name).write_bytes(names[name])
    store = DedupStore(spark, at, config)
    assert store.ingests == 1
    store.ingest(S.folder_files(spark, f"{tmp_path}/in", 7))
    restored = lambda s: {r.file_name.rpartition("/")[2]: bytes(r.content) for r in s.restore().collect()}
    assert restored(DedupStore(spark, at, config)) == names
    (tmp_path / "in" / "changed").write_bytes(b"")
    store.ingest(S.folder_files(spark, f"{tmp_path}/in", 7))
    assert restored(store) == names | {"changed": b""} and store.ingests == 3
    held = sum(p.stat().st_size for p in (tmp_path / "store").rglob("*.parquet"))
    assert held < 200_000 and not list((tmp_path / "store" / "work").glob("*"))  # 40 kB once, and the tables
    assert store._table("payloads").agg(F.sum(F.octet_length("payload"))).first()[0] < 80_000
    again = store._table("classes").where("ingest > 0").groupBy("dup_class").count().collect()
    assert {r.dup_class: r["count"] for r in again}["new"] < 10 and "inter" not in {r.dup_class for r in again}
    with pytest.raises(ValueError):
        DedupStore(spark, at, StoreConfig(ChunkSpec("fixed", 8192)))
    assert DedupStore(spark, at, StoreConfig(ChunkSpec("fixed", 8192)), clean=True).ingests == 0


def test_an_ingest_that_fails_leaves_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    store = DedupStore(spark, at, StoreConfig(ChunkSpec("fixed", 4096)))
    with pytest.raises(ValueError):
        store.restore()
    store.ingest(files_of(spark, FILES))
    broken = files_of(spark, [(1, "/one", b"z"), (1, "/bad", b"x")]).withColumn("file_size", F.when(F.col("file_name") == "/bad", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("file_size")))
    with pytest.raises(Exception, match="lost"):
        store.ingest(broken)
    assert store.ingests == 1 and {r.file_name: bytes(r.content) for r in store.restore().collect()} == {n: c for _, n, c in FILES}
    late = DedupStore(spark, at, store.config)
    late.disk.create = lambda name, text: False  # as if another had been first
    with pytest.raises(RuntimeError):
        late.ingest(files_of(spark, [(1, "/one", b"z")]))
    store.vacuum()
    assert not list((tmp_path / "store" / "work").glob("*")) and [p.name for p in (tmp_path / "store" / "classes").glob("*/*")] == [f"attempt={store._commits()[0]}"]
    store.ingest(files_of(spark, [(1, "/one", b"z")]))
    assert {r.file_name: bytes(r.content) for r in DedupStore(spark, at, store.config).restore().collect()}["/one"] == b"z"


def test_files_in_parts(spark, tmp_path, monkeypatch):
    import hashlib

    from loam.plans import store as store_

    monkeypatch.setattr(store_, "PART_BYTES", 8192)
    monkeypatch.setattr(S, "WRITE_BYTES", 5000)
    (tmp_path / "in").mkdir()
    names = {"big": BIG, "exact": BIG[:16384], "less": BIG[:100], "empty": b""}
    for name, content in names.items():
        (tmp_path / "in" / name).write_bytes(content)
    parts = S.folder_parts(spark, f"file://{tmp_path}/in", 3, 8192)
    assert parts.where("octet_length(content) > 8192").count() == 0 and parts.where("endswith(file_name, 'big')").count() == 5
    for i, chunks in enumerate([ChunkSpec("fixed", 4096), ChunkSpec("cdc", 1024, 256, 4096, 48)]):
        store = DedupStore(spark, f"file://{tmp_path}/store{i}", StoreConfig(chunks))
        store.ingest(parts)
        assert {r.file_name.rpartition("/")[2]: bytes(r.content) for r in store.restore().collect()} == names
        out = S.export_files(store.restored_parts(), f"file://{tmp_path}/out{i}").collect()
        assert {r.file_name.rpartition("/")[2]: (r.bytes, r.md5) for r in out} == {n: (len(c), hashlib.md5(c).hexdigest()) for n, c in names.items()}
        for r in out:
            assert S.arrow_path(r.path)[0].open_input_file(S.arrow_path(r.path)[1]).read() == names[r.file_name.rpartition("/")[2]]
    whole = secrets(S.folder_files(spark, f"file://{tmp_path}/in", 3), ChunkSpec("fixed", 4096))
    from loam.operators.chunks import part_secrets

    assert sorted(map(tuple, part_secrets(parts, ChunkSpec("fixed", 4096), 8192).drop("seq").collect())) == sorted(map(tuple, whole.drop("seq").collect()))
    with pytest.raises(ValueError):
        part_secrets(parts, ChunkSpec("fixed", 5000), 8192)
    bad = spark.createDataFrame([(1, "/a/../../b", 0, bytearray(b"x"))], "user_id int, file_name string, pos int, data binary")
    with pytest.raises(Exception, match="leads out"):
        S.export_files(bad, f"file://{tmp_path}/out").collect()


def test_resumed_recipes(spark):
    rows = [("f", 0, 0, 0, "a"), ("f", 0, 0, 1, "b"), ("f", 0, 2, 2, "c"), ("g", 0, 0, 0, "a"), ("f", 1, 0, 0, "z")]
    entries = spark.createDataFrame(rows, "recipe_fp string, cloud int, past int, secret_id int, share_fp string")
    got = {(r.recipe_fp, r.cloud, r.pos): r.share_fp for r in recipes.resumed(entries).collect()}
    assert got == {("f", 0, 0): "a", ("f", 0, 1): "b", ("f", 0, 2): "c", ("g", 0, 0): "a", ("f", 1, 0): "z"}
    for wrong in (("f", 0, 4, 4, "x"), ("h", 0, 1, 1, "x"), ("f", 0, 1, 1, "x")):
        with pytest.raises(Exception, match="no recipe to resume"):
            recipes.resumed(entries.union(spark.createDataFrame([wrong], entries.schema))).collect()
