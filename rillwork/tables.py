"""Tables between stages: written to the folder that driver and executors share, which cuts the lineage."""

from __future__ import annotations

import ctypes
import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Folders of local sessions that name none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster that would be a folder on each machine,
    so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="rillwork-")
        _LOCAL[spark.sparkContext.applicationId] = found  # the setting itself can't be changed in a running session
    return found.rstrip("/")


#: Scratch paths of the `with temporary()` blocks that are open, the innermost last.
_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the JVM ends, or the innermost temporary() block."""
    path = f"{shared_dir(spark)}/rillwork-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What searches and jobs write between stages inside the block goes when it ends: `with temporary(spark): search(...).write...`.
    A long session would otherwise keep it till its end. Results must be written or collected inside."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder. It cuts the lineage, outlives lost executors and has a known size."""
    return put(df, scratch_path(df.sparkSession, name))


#: Whether Spark removes a query's shuffle files as soon as it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside the block leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def put(df: DataFrame, path: str) -> DataFrame:
    """df as a table at a path. It is read from there, so shuffle files of the query that made it go at once."""
    with short_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """written() of what make() gives, without the tables that it wrote on its way."""
    path = scratch_path(spark, name)
    with temporary(spark):
        return put(make(), path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes from a few files, of which one task would read each; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


#: Narrow rows (ids, scores) that are broadcast, at most.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """df written, and broadcast in joins if it has `most` rows at the most; beyond, it is shuffled. For narrow rows. They are
    counted as they are written."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return F.broadcast(table) if seen.get["n"] <= most else table


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables made by written() that nothing reads any more."""
    for table in tables:
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Give memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives free memory back about once a second and at its end. Spark keeps the workers of finished
    tasks, so an executor would hold the most that any of its workers ever took, several times over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        try:
            for out in work(batches):
                yield out
                del out
                if time.monotonic() - last > 1:
                    release()
                    last = time.monotonic()
        finally:
            release()

    return run


class Folder:
    """Small files below a path, in any store that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._root, self._bytes = path.rstrip("/"), spark._jvm.java.lang.String
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._read = spark._jvm.org.apache.commons.io.IOUtils

    def _at(self, name: str):
        return self._path(f"{self._root}/{name}")

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none where there is no folder."""
        at = self._at(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._read.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file, whole or not at all; an error where there is one."""
        at, hidden = self._at(name), self._at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(at) or not self._fs.rename(hidden, at):
            self._fs.delete(hidden, False)
            raise FileExistsError(f"{self._root}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Versions:
    """A table at a path that is made of folders: a manifest says which ones, and with the next manifest all readers go over at
    once. Folders have names of their own, so no run writes into what another one has published."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names("manifests") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, before: int | None = None) -> dict | None:
        """The newest manifest, or the newest one before a number."""
        known = [n for n in self.numbers() if before is None or n < before]
        return json.loads(self.folder.read(f"manifests/{known[-1]:012d}.json")) if known else None

    def new_folder(self, name: str) -> str:
        return f"{name}-{uuid.uuid4().hex[:12]}"

    def at(self, folder: str) -> str:
        return f"{self.path}/data/{folder}"

    def read(self, schema: str, *folders: str) -> DataFrame:
        """Rows of the folders; none of no folders."""
        return self.spark.read.schema(schema).parquet(*map(self.at, folders)) if folders else self.spark.createDataFrame([], schema)

    def publish(self, manifest: dict, number: int | None = None) -> int:
        """The next manifest; an error if another writer has published one meanwhile."""
        number = max(self.numbers(), default=0) + 1 if number is None else number
        self.folder.create(f"manifests/{number:012d}.json", json.dumps(manifest))
        return number

    def clean(self, keep: int, folders: Callable[[dict], list[str]]) -> None:
        """Remove manifests before the last `keep`, and folders that none of these has."""
        numbers = self.numbers()
        live = {f for n in numbers[-keep:] for f in folders(json.loads(self.folder.read(f"manifests/{n:012d}.json")))}
        for n in numbers[:-keep]:
            self.folder.delete(f"manifests/{n:012d}.json")
        for name in self.folder.names("data"):
            if name not in live:
                self.folder.delete(f"data/{name}")
