"""The vector table at a path, and reindexing that goes on after a crash and never shows two dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.operators.index import dim_violations, embed_text
from rillwork.operators.lifecycle import health_full
from rillwork.operators.provider import Embedding, embed
from rillwork.tables import Versions, small, written

SCHEMA = "chunk_id long, document_id long, embedding array<float>"
REPORT = "document_id long, total long, succeeded long, failed long, sync_status string, error string"


@dataclass(frozen=True)
class Reindexed:
    """done: whether the new vectors have taken over; report by document, so far; problems: what kept them from it."""

    done: bool
    report: DataFrame
    problems: DataFrame


class VectorStore:
    """Vectors (chunk_id, document_id, embedding) of one dimension at a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.versions = spark, Versions(spark, path)

    def vectors(self) -> DataFrame:
        m = self.versions.manifest()
        return self.versions.read(SCHEMA, *(m["folders"] if m else ()))

    def dim(self) -> int | None:
        m = self.versions.manifest()
        return m["dim"] if m else None

    def put(self, vectors: DataFrame, dim: int) -> None:
        """The vectors as the table's only rows; an error where one has another dimension."""
        folder = self.versions.new_folder("put")
        rows = vectors.select("chunk_id", "document_id", F.col("embedding").cast("array<float>").alias("embedding"))
        rows.write.parquet(self.versions.at(folder))
        self._check(self.versions.read(SCHEMA, folder), dim)
        self._take_over([folder], dim)

    def _check(self, rows: DataFrame, dim: int) -> None:
        wrong = dim_violations(rows, dim).count()
        if wrong:
            raise ValueError(f"{wrong} vectors don't have {dim} numbers")

    def _take_over(self, folders: list[str], dim: int) -> None:
        self.versions.publish({"folders": folders, "dim": dim})

    def reindex(self, targets: DataFrame, chunks: DataFrame, dim: int, provider: Embedding | None = None, batches: int = 16, most_batches: int | None = None) -> Reindexed:
        """Embed the targets' chunks anew, batch after batch, into a shadow table that takes over in the end.

        Documents are dealt to batches by a hash; what a batch gave, vectors and the states of its documents, is published with
        it, so a run that comes after a crash does the rest. When all are done the shadow's ids are held against the chunks and
        its dimension is checked; only then does it become the table, in one step, with the old vectors of documents that aren't
        targets. These must have the dimension: a change of dimension needs all documents as targets, and those whose state
        forbids it (failed) have no vector then. most_batches bounds what this run does. targets: document_id, sync_status.
        """
        base = max(self.versions.numbers(), default=0)
        shadow = Versions(self.spark, f"{self.versions.path}/reindex-{base}-{dim}-{batches}")
        m = shadow.manifest() or {"done": {}}
        own = chunks.join(targets.select("document_id", F.col("sync_status").alias("was")), "document_id").withColumn("allowed", F.col("was").isin("synced", "dirty", "pending"))
        number = F.pmod(F.xxhash64("document_id"), F.lit(batches))
        left = [b for b in range(batches) if str(b) not in m["done"]]
        for b in left if most_batches is None else left[:most_batches]:
            part = own.where(number == b)
            part = written(part.select("document_id", "chunk_id", "was", "allowed", embed_text(part).alias("text__")), "reindex-part")
            vectors, report = shadow.new_folder(f"vectors-{b}"), shadow.new_folder(f"report-{b}")
            rows = embed(part.where("allowed").select("chunk_id", "document_id", "text__"), provider, dim, "text__").select("chunk_id", "document_id", F.col("embedding").cast("array<float>").alias("embedding"))
            rows.write.parquet(shadow.at(vectors))
            has = shadow.read(SCHEMA, vectors).select("chunk_id", (F.size("embedding") == dim).alias("has"))
            good = part.join(has, "chunk_id", "left").withColumn("good", F.col("allowed") & F.coalesce("has", F.lit(False)))
            per = good.groupBy("document_id", "was").agg(F.count("*").alias("total"), F.count_if("good").alias("succeeded"))
            lost = F.col("total") - F.col("succeeded")
            state = F.when((F.col("was") == "failed") | (lost > 0), "failed").otherwise("synced")
            per.select("document_id", "total", "succeeded", lost.alias("failed"), state.alias("sync_status"), F.when(F.col("was") == "failed", "rejected: failed -> dirty").alias("error")).write.parquet(shadow.at(report))
            m = {"done": {**m["done"], str(b): [vectors, report]}}
            shadow.publish(m)
        report = shadow.read(REPORT, *(r for _, r in m["done"].values()))
        none = self.spark.createDataFrame([], "chunk_id long, problem string")
        if len(m["done"]) < batches:
            return Reindexed(False, report, none)
        new = shadow.read(SCHEMA, *(v for v, _ in m["done"].values()))
        wrong = dim_violations(new, dim).select("chunk_id", F.lit("dimension").alias("problem"))
        problems = written(health_full(own.where("allowed").select("chunk_id"), new).unionByName(wrong), "problems")
        if problems.limit(1).count():
            return Reindexed(False, report, problems)
        others = self.vectors().join(small(targets.select("document_id").distinct(), "targets"), "document_id", "left_anti")
        folder = self.versions.new_folder("reindexed")
        new.unionByName(others.select(*new.columns)).write.parquet(self.versions.at(folder))
        self._check(self.versions.read(SCHEMA, folder), dim)
        self._take_over([folder], dim)
        return Reindexed(True, report, problems)


def marked(chunks: DataFrame, store: VectorStore) -> DataFrame:
    """Chunks with context_embedded: whether they have a context and a vector in the store, which was made with it."""
    has = small(store.vectors().select("chunk_id").distinct(), "has-vector")
    rows = chunks.join(has.withColumn("has__", F.lit(True)), "chunk_id", "left")
    return rows.withColumn("context_embedded", F.coalesce(F.col("has__") & F.col("context").isNotNull() & (F.col("context") != ""), F.lit(False))).drop("has__")
