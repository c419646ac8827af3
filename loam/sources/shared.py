"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path, not made yet, below the session's spark.checkpoint.dir; with a local master and without that setting, below a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loam-")
        atexit.register(shutil.rmtree, folder, True)
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


class Folder:
    """Small files and names below a folder in any store that Spark reads, for the driver. Paths are relative to it; "" is the folder itself."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._of = path, spark._jvm.org.apache.hadoop.fs.Path
        self.system = self._of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._of(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        """What is in a folder below; nothing if there is none."""
        at = self._at(name)
        found = [x.getPath().getName() for x in self.system.listStatus(at)] if self.system.exists(at) else []
        return sorted(x for x in found if x[0] not in "._")

    def read(self, name: str) -> str | None:
        at = self._at(name)
        if not self.system.exists(at):
            return None
        stream = self.system.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that must not exist; False if it does. The whole file is there, or none: it is written aside and renamed."""
        at, aside = self._at(name), self._at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        self.system.mkdirs(at.getParent())
        stream = self.system.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.system.exists(at) or not self.system.rename(aside, at):
            self.system.delete(aside, False)
            return False
        return True

    def remove(self, name: str) -> None:
        self.system.delete(self._at(name), True)
