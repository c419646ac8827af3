from pyspark.sql import functions as F

from loam.functions.chunking import ChunkSpec
from loam.operators import dedup
from loam.operators.chunks import secrets
from loam.sources.files import document_files
from loam.streaming.ingest import run_index, stream_files
from loam.streaming.owners import owners


def parts(spark, sf, folder, n=3):
    """The documents in n files, which arrive one after the other."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i in range(n):
        docs.where(F.col("doc_id") % n == i).coalesce(1).write.mode("append").parquet(folder)
    return docs


def shares(files):
    return dedup.plain_shares(secrets(document_files(files), ChunkSpec("fixed", 512)))


def test_index_of_a_stream_equals_the_batch(spark, sf, tmp_path):
    docs = parts(spark, sf, f"{tmp_path}/in")
    got = run_index(shares(stream_files(spark, f"{tmp_path}/in", docs.schema)), f"{tmp_path}/index")
    want = dedup.share_index(shares(docs))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_owners(spark, sf, tmp_path):
    docs = parts(spark, sf, f"{tmp_path}/in")
    found = owners(shares(stream_files(spark, f"{tmp_path}/in", docs.schema)))
    query = found.writeStream.outputMode("update").format("memory").queryName("owners").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("owners").groupBy("cloud", "share_fp").agg(F.max_by("users", "num_users").alias("users"))
    want = {(r.cloud, r.share_fp): sorted(r.users) for r in dedup.share_index(shares(docs)).collect()}
    assert {(r.cloud, r.share_fp): r.users for r in last.collect()} == want


def test_runs_are_merged_by_levels(spark, sf, tmp_path, monkeypatch):
    """Eleven batches, three runs of a level to one of the next, and more later: the index as of the batch, out of few runs."""
    from loam.streaming import ingest

    monkeypatch.setattr(ingest, "FAN", 3)
    docs = parts(spark, sf, f"{tmp_path}/in", 11)
    stream = lambda: shares(stream_files(spark, f"{tmp_path}/in", docs.schema))
    rows = lambda df: sorted(map(tuple, df.select("cloud", "share_fp", "share_size", "users").collect()))
    assert rows(run_index(stream(), f"{tmp_path}/index")) == rows(dedup.share_index(shares(docs)))
    runs = {p.name for p in (tmp_path / "index" / "runs").iterdir()}
    assert {"2-0", "0-9", "0-10"} <= runs and not runs & {"0-0", "0-1", "0-2"} and len(runs) <= 9
    more = docs.withColumns({"doc_id": F.col("doc_id") + 10_000, "source": F.lit("src77")}).where("doc_id % 5 = 0")
    more.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert rows(run_index(stream(), f"{tmp_path}/index")) == rows(dedup.share_index(shares(docs.unionByName(more))))
    assert ingest.read_index(spark, f"{tmp_path}/none") is None
