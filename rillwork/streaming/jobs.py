"""The access summary kept up to date, and ingest of new files as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillwork.operators.score import access_summary
from rillwork.tables import Versions

SUMMARY = "chunk_id long, last_accessed_at timestamp_ntz, access_count long"


def access_stream(accesses: DataFrame, path: str, checkpoint: str, once: bool = True, buckets: int = 64) -> StreamingQuery:
    """Keep the summary of a streaming access log as a table at `path`: each batch's changed rows replace the old.

    Rows are dealt to buckets by a hash of their chunk. A batch rewrites the buckets that it touches and publishes a manifest
    of all buckets' folders under its own number, so what is written goes with the batch, readers go over in one step, and a
    batch that comes again after a crash finds its manifest and writes nothing. Folders of the last two manifests stay.
    """

    def merge(batch: DataFrame, number: int) -> None:
        versions = Versions(batch.sparkSession, path)
        if number + 1 in versions.numbers():
            batch.write.format("noop").mode("overwrite").save()  # the state behind the batch is to be written again
            return
        old = versions.manifest(before=number + 1) or {"buckets": buckets, "folders": {}}
        bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(old["buckets"]))
        rows = batch.select("chunk_id", "last_accessed_at", "access_count", bucket.alias("bucket")).persist()  # read twice, and the state behind it is not
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # as many as there are buckets at most
        held = [old["folders"][str(b)] for b in touched if str(b) in old["folders"]]
        if touched:
            before = versions.read(SUMMARY, *held).withColumn("bucket", bucket)
            merged = before.join(rows.select("chunk_id"), "chunk_id", "left_anti").unionByName(rows)
            folder = versions.new_folder(f"batch-{number}")
            merged.repartition("bucket").write.partitionBy("bucket").parquet(versions.at(folder))
            versions.publish({**old, "folders": {**old["folders"], **{str(b): f"{folder}/bucket={b}" for b in touched}}}, number + 1)
            versions.clean(2, lambda m: [f.partition("/")[0] for f in m["folders"].values()])
        rows.unpersist()

    writer = access_summary(accesses).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The summary as the newest batch left it."""
    versions = Versions(spark, path)
    m = versions.manifest()
    return versions.read(SUMMARY, *m["folders"].values()) if m else None


def ingest_stream(files: DataFrame, ingest: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Ingest new rows (path, content): those whose content hash is new go through `ingest` to out/documents/batch=N;
    their hashes are kept in out/hashes/batch=N, so a file that comes again is not taken twice. A batch that comes again
    after a crash overwrites its own rows and doesn't look at its own hashes."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("file_hash", F.sha2("content", 256)).dropDuplicates(["file_hash"])
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/hashes")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            known = spark.read.schema("file_hash string, batch long").parquet(f"{out}/hashes").where(F.col("batch") != number)
            rows = rows.join(known, "file_hash", "left_anti")
        rows = rows.persist()
        ingest(rows).write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        rows.select("file_hash").write.mode("overwrite").parquet(f"{out}/hashes/batch={number}")
        rows.unpersist()

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
