"""A small table with versions: R-3 / K-8, the job registry.

A write puts its rows into a folder of their own and then adds one entry to the
log, ``_log/<version>``, that names the folder.  The entry is written aside and
renamed into place, and a rename onto an existing entry fails; so a reader sees
the old version or the new one and never a part, a write that dies leaves the
old version, and of two writers that start from one version only the first
succeeds.  All files go through the file system that Spark uses for the path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has added the version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("_log").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        fs, log = self._fs(), self._path("_log")
        if not fs.exists(log):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(log)]
        return sorted(int(n) for n in names if n.isdigit())

    def _folder(self, version: int) -> str:
        stream = self._fs().open(self._path(f"_log/{version:012d}"))
        try:
            reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            return reader.readLine()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the last one); no version, no rows."""
        known = self.versions()
        if version is None and not known:
            return self.spark.createDataFrame([], self.schema)
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"no version {version}: {known}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._folder(version)}")

    def write(self, rows: DataFrame, after: int | None = None) -> int:
        """Add ``rows`` as the version after ``after`` (default: the last one) and return its number."""
        known = self.versions()
        last = known[-1] if known else 0
        after = last if after is None else after
        if after != last:
            raise Conflict(f"version {after} is not the last one ({last})")
        folder = f"data-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        rows.select(*columns).write.parquet(f"{self.path}/{folder}")
        self._commit(after + 1, folder)
        return after + 1

    def _commit(self, version: int, folder: str) -> None:
        fs, aside = self._fs(), self._path(f"_log/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(folder.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), self._conf)
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(self._path(f"_log/{version:012d}")), options)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e) or version in self.versions():
                raise Conflict(f"version {version} exists") from None
            raise
