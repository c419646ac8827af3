"""The store: files in, deduplicated, delta-compressed and packed tables on disk, files out."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.chunking import ChunkSpec
from loam.functions.features import super_features
from loam.operators import dedup, metrics, packing, recipes, similarity
from loam.operators.chunks import part_secrets, secrets
from loam.operators.codec import CodecSpec, decode_shares, encode_shares
from loam.sources.files import PART_BYTES
from loam.sources.shared import Folder

#: Bytes of a lane, and consecutive shares of a file that stay in one lane.
LANE_BYTES, RUN_SHARES = 1 << 30, 4096


@dataclass(frozen=True)
class StoreConfig:
    """lanes: sequences of containers that are filled side by side; None: one for each LANE_BYTES of an ingest."""

    chunks: ChunkSpec = ChunkSpec()
    codec: CodecSpec | None = None
    delta: bool = True
    features: str = "finesse"
    lanes: int | None = None


class DedupStore:
    """Tables below a folder that driver and executors share, a part for each ingest:

    files (a row for each upload and cloud: its recipe's head), entries (recipes), shares (a row for each unique share: delta, lane, container, offset,
    length), containers (the shares' places), payloads (the containers' bytes) and classes (every share with its class and sizes). All have the cloud as a
    column, as every cloud has an index of its own.

    An ingest writes its parts below a folder of its own attempt, which counts once its commit is written, as the last thing: an ingest that failed
    leaves nothing that is read, and the next takes its number. A store can be opened again by another session; its configuration is kept with it, and
    has to be the same. `laps` adds up the seconds of this object's ingests by step. What earlier ingests stored is not stored again, and can be a file's share, but deltas have bases of their own ingest. The bytes
    of duplicates are written to the attempt's work folder only, which goes with the commit.
    """

    TABLES = ("files", "entries", "shares", "containers", "payloads", "classes")

    def __init__(self, spark: SparkSession, folder: str, config: StoreConfig = StoreConfig(), clean: bool = False) -> None:
        """clean: removes whatever the folder has. ValueError if the store there was made with another configuration."""
        self.spark, self.folder, self.config, self.laps = spark, folder.rstrip("/"), config, metrics.Laps()
        self.disk = Folder(spark, self.folder)
        if clean:
            self.disk.remove("")
        made = json.dumps(asdict(config) | {"lanes": None}, sort_keys=True)
        kept = self.disk.read("config.json")
        if kept is None:
            self.disk.create("config.json", made)
        elif kept != made:
            raise ValueError(f"the store in {folder} was made with {kept}")

    @property
    def ingests(self) -> int:
        """How many ingests are committed."""
        return len(self._commits())

    def _commits(self) -> list[str]:
        """The attempts that count, in order."""
        numbers = sorted(int(x) for x in self.disk.names("commits"))
        if numbers != list(range(len(numbers))):
            raise ValueError(f"commits {numbers} of {self.folder} have gaps")
        return [self.disk.read(f"commits/{n}") for n in numbers]

    def _table(self, name: str, until: int | None = None) -> DataFrame:
        """The rows of all committed ingests, or of those before `until`, with their number in `ingest`."""
        commits = self._commits()[:until]
        if not commits:
            raise ValueError(f"nothing has been stored in {self.folder}")
        base = f"{self.folder}/{name}"
        paths = [f"{base}/ingest={n}/attempt={a}" for n, a in enumerate(commits)]
        return self.spark.read.option("basePath", base).parquet(*paths).drop("attempt")

    def shares(self, files: DataFrame) -> DataFrame:
        """Shares with their bytes, of files in rows, or in parts (with columns part, n_parts)."""
        in_parts = "part" in files.columns
        found = part_secrets(files, self.config.chunks, PART_BYTES) if in_parts else secrets(files, self.config.chunks)
        if self.config.codec is None:
            found = found.withColumns({"cloud": F.lit(0), "share_size": F.col("secret_size")})
        else:
            found = encode_shares(found, self.config.codec)
        return found.withColumn("share_fp", dedup.fingerprint(F.col("data")))

    def ingest(self, files: DataFrame) -> None:
        """Stores `files` (see sources.files.FILES), whose seq tells them apart; of a user's name the version with the largest seq of the last ingest
        that has one holds. Null contents are stored as empty ones. Large files may come in parts (sources.files.folder_parts). Raises, and stores
        nothing, if another ingest was committed meanwhile.
        """
        n, attempt = self.ingests, uuid.uuid4().hex
        work = f"{self.folder}/work/{attempt}"

        def once(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{work}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{work}/{name}")

        def put(df: DataFrame, name: str) -> DataFrame:
            path = f"{self.folder}/{name}/ingest={n}/attempt={attempt}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        files = files.withColumns({"content": F.coalesce("content", F.lit(b"")), "file_size": F.coalesce("file_size", F.lit(0).cast("long"))})
        with self.laps("chunk, encode, hash"):
            whole = once(self.shares(files), "shares")  # once
        shares = whole.drop("data")
        clouds = 1 if self.config.codec is None else self.config.codec.n
        firsts = files.where("part = 0") if "part" in files.columns else files
        heads = firsts.select("user_id", "file_name", "seq", "file_size", F.explode(F.sequence(F.lit(0), F.lit(clouds - 1))).alias("cloud"))
        with self.laps("recipes"):
            put(recipes.heads(heads, shares), "files")
            put(recipes.recipe_entries(shares), "entries")
        owners = self._table("classes", n).where("dup_class != 'intra'").select("cloud", "share_fp", "user_id") if n else None  # each owner once
        with self.laps("classify"):
            classes = once(dedup.classify(shares, owners), "classes")
        unique = dedup.unique_shares(classes.where("dup_class = 'new'").select("cloud", "share_fp", "seq", "secret_id", "share_size"))
        data = whole.join(unique.select("cloud", "share_fp", "seq", "secret_id"), ["cloud", "share_fp", "seq", "secret_id"], "left_semi")
        with self.laps("unique bytes"):
            data = once(data.groupBy("cloud", "share_fp").agg(F.any_value("data").alias("data")), "data")
        if self.config.delta:
            with self.laps("super-features"):
                features = once(data.select("cloud", "share_fp", super_features(F.col("data"), self.config.features).alias("features")), "features")
            stored = similarity.with_deltas(similarity.select_bases(unique.join(features, ["cloud", "share_fp"])), data).drop("features")
            with self.laps("deltas"):
                stored = once(stored.select("cloud", "share_fp", "seq", "secret_id", "share_size", "delta_depth", "delta_size", "base_fp", F.col("stored").alias("data")), "stored")
            sizes, data = stored.drop("data").withColumn("length", F.coalesce(F.col("delta_size").cast("int"), "share_size")), stored.select("cloud", "share_fp", "data")
        else:
            none = {"delta_depth": F.lit(0), "delta_size": F.lit(None).cast("long"), "base_fp": F.lit(None).cast("string")}
            sizes = unique.withColumns(none).withColumn("length", F.col("share_size"))
        lanes = self.config.lanes or max(1, -(-(sizes.agg(F.sum("length")).first()[0] or 0) // LANE_BYTES))
        run = F.pmod(F.xxhash64("seq", F.floor(F.col("secret_id") / RUN_SHARES)), F.lit(lanes))
        with self.laps("containers"):
            places = put(packing.containers(sizes, ["seq", "secret_id"], run), "containers")
            put(sizes.drop("length").join(places, ["cloud", "share_fp"]), "shares")
            put(packing.container_payloads(places, data), "payloads")
        first = classes.where("dup_class = 'new'").join(sizes.select("cloud", "share_fp", "delta_size"), ["cloud", "share_fp"], "left")
        slim = first.unionByName(classes.where("dup_class != 'new'").withColumn("delta_size", F.lit(None).cast("long")))
        with self.laps("commit"):
            self._finish(put, slim, n, attempt)

    def _finish(self, put, slim: DataFrame, n: int, attempt: str) -> None:
        put(slim.select("cloud", "share_fp", "user_id", "secret_size", "share_size", "dup_class", "delta_size"), "classes")
        if not self.disk.create(f"commits/{n}", attempt):
            self.disk.remove(f"work/{attempt}")
            raise RuntimeError(f"ingest {n} of {self.folder} was committed by another")
        self.disk.remove(f"work/{attempt}")

    def vacuum(self) -> None:
        """Removes what ingests that failed have left. None may be running."""
        self.disk.remove("work")
        commits = self._commits()
        for name in self.TABLES:
            for part in self.disk.names(name):
                n = int(part.partition("=")[2])
                for attempt in self.disk.names(f"{name}/{part}"):
                    if n >= len(commits) or attempt != f"attempt={commits[n]}":
                        self.disk.remove(f"{name}/{part}/{attempt}")

    def index(self) -> DataFrame:
        """Every share with its size, owners, delta and container."""
        entry = self._table("shares").drop("ingest", "seq", "secret_id", "share_size")
        return dedup.share_index(self._table("classes")).join(entry, ["cloud", "share_fp"])

    def report(self) -> DataFrame:
        """The report of all ingests, for each cloud, with the bytes of recipes."""
        entries = self._table("entries").groupBy("cloud").agg(F.count("*").alias("n"))
        heads = self._table("files").groupBy("cloud").agg(F.count("*").alias("m"))
        found = metrics.dedup_report(self._table("classes"), ["cloud"]).join(heads, "cloud").join(entries, "cloud", "left")
        return found.withColumn("recipe_bytes", metrics.recipe_bytes(F.col("m"), F.coalesce("n", F.lit(0)))).drop("n", "m")

    def restore_report(self, files: DataFrame | None = None, clouds: list[int] | None = None) -> DataFrame:
        """What a restore of all files, or of those of `files`, reads, and the seconds of its steps; the restored bytes are made, and not kept.

        One row: files, shares (as often as they come), unique and delta shares read, bytes restored; seconds of the recipes, of the index, of the shares
        stored whole, of those stored as deltas with their bases, and of the whole restore. Steps run one after the other, so they don't add up to it.
        """
        laps, codec = metrics.Laps(), self.config.codec
        chosen = [0] if codec is None else clouds or list(range(codec.k))
        with laps("recipes"):
            wanted = self._wanted(files).where(F.col("cloud").isin(chosen))
            entries = self._table("entries").join(wanted.select("recipe_fp", "cloud", "ingest", "seq"), ["recipe_fp", "cloud", "ingest", "seq"])
            n_files, n_shares = wanted.where(F.col("cloud") == chosen[0]).count(), entries.count()
        with laps("index"):
            own = self._table("shares").join(entries.select("cloud", "share_fp").distinct(), ["cloud", "share_fp"], "left_semi")
            n_unique, n_delta = own.agg(F.count_if(F.col("delta_depth") == 0), F.count_if(F.col("delta_depth") > 0)).first()
        run = lambda df: df.write.format("noop").mode("overwrite").save()
        with laps("whole shares"):
            run(self._bytes(own.where("delta_depth = 0")))
        with laps("delta shares"):
            run(similarity.resolve_deltas(self._bytes(self._and_bases(own.where("delta_depth > 0")))))
        with laps("restore"):
            n_bytes = self.restored_parts(files, clouds).agg(F.sum(F.octet_length("data"))).first()[0] or 0
        seconds = {f"{k.replace(' ', '_')}_s": float(v) for k, v in laps.seconds.items()}
        row = {"files": n_files, "shares": n_shares, "unique_shares": n_unique, "delta_shares": n_delta, "bytes": n_bytes, **seconds}
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if k.endswith('_s') else 'bigint'}" for k in row))

    def files(self) -> DataFrame:
        """The last version of each file."""
        return recipes.latest(self._table("files"), ["ingest", "seq"])

    def restored_parts(self, files: DataFrame | None = None, clouds: list[int] | None = None) -> DataFrame:
        """(user_id, file_name, pos, data): the secrets of the last version of all files, or of those of `files` (user_id, file_name), out of containers.

        `pos` orders a file's; an empty one has a row with null data. Shares that aren't there raise when it is run.
        """
        codec = self.config.codec
        chosen = [0] if codec is None else clouds or list(range(codec.k))
        wanted = self._wanted(files).where(F.col("cloud").isin(chosen))
        key = ["recipe_fp", "cloud", "ingest", "seq"]
        entries = self._table("entries").join(wanted.select(*key, "user_id", "file_name"), key).drop("ingest", "seq")
        index = self._table("shares")
        if files is not None:  # just the shares of these files, and their bases
            index = self._and_bases(index.join(entries.select("cloud", "share_fp").distinct(), ["cloud", "share_fp"], "left_semi"))
        parts = recipes.fetch(entries, similarity.resolve_deltas(self._bytes(index)))
        if codec is not None:
            parts = decode_shares(parts.select("user_id", "file_name", "pos", "secret_size", "cloud", "data"), ["user_id", "file_name", "pos"], codec, chosen)
        empty = wanted.where((F.col("num_shares") == 0) & (F.col("cloud") == chosen[0]))
        return parts.select("user_id", "file_name", "pos", "data").union(empty.select("user_id", "file_name", F.lit(0), F.lit(None).cast("binary")))

    def _and_bases(self, shares: DataFrame) -> DataFrame:
        """Rows of the index of shares, and those of the shares that these are deltas of."""
        bases = shares.where("base_fp is not null").select("cloud", F.col("base_fp").alias("share_fp"))
        return self._table("shares").join(shares.select("cloud", "share_fp").union(bases).distinct(), ["cloud", "share_fp"], "left_semi")

    def _bytes(self, shares: DataFrame) -> DataFrame:
        """Rows of the index of shares with what is stored of each, cut out of the containers."""
        return packing.read_slices(shares, self._table("payloads"), ["ingest", "cloud", "lane", "container"]).withColumnRenamed("data", "stored")

    def _wanted(self, files: DataFrame | None) -> DataFrame:
        if files is None:
            return self.files()
        return self.files().join(files.select("user_id", "file_name").distinct(), ["user_id", "file_name"], "left_semi")

    def restore(self, files: DataFrame | None = None, clouds: list[int] | None = None) -> DataFrame:
        """(user_id, file_name, content) of the last version of all files, or of those of `files` (user_id, file_name). For files too large for a row
        see restored_parts and sources.files.export_files.
        """
        whole = recipes.reassemble(self.restored_parts(files, clouds), ["user_id", "file_name"])
        return whole.withColumn("content", F.coalesce("content", F.lit(b"")))
