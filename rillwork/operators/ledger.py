"""Answers that are kept: completions by the hash of their prompt, and the vectors of tags.

What a model has said once is not asked again, in this run or a later one. A ledger's run asks batch after batch and
publishes each, so a run that dies goes on where it was.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.operators.provider import Completion, Embedding, embed, slices
from rillwork.tables import Versions, small, written

#: Prompts of a batch, about; requests of a task at a time; tries of a prompt, and seconds before the second one.
BATCH, AT_ONCE, TRIES, WAIT = 10_000, 4, 3, 0.5


def prompt_hash(prompt: Column, model: str) -> Column:
    """What an answer is kept by: the prompt and the model's name and version."""
    return F.sha2(F.concat_ws("\n", F.lit(model), prompt), 256)


class Ledger:
    """Answers at a path: hash, response, usage, tries, error and run, the number of the run that asked."""

    SCHEMA = "hash string, response string, usage long, tries int, error string, run int"

    def __init__(self, spark: SparkSession, path: str, model: str = "offline") -> None:
        self.spark, self.versions, self.model = spark, Versions(spark, path), model

    def answers(self) -> DataFrame:
        """One row for each prompt that was asked: the last one, of several runs."""
        m = self.versions.manifest()
        rows = self.versions.read(self.SCHEMA, *(m["folders"] if m else ()))
        return rows.groupBy("hash").agg(F.max_by(F.struct("response", "usage", "tries", "error", "run"), "run").alias("a")).select("hash", "a.*")

    def complete(self, prompts: DataFrame, provider: Completion, keep: tuple[str, ...] = ("id",), prompt: str = "prompt", batch: int = BATCH, tries: int = TRIES, wait: float = WAIT, at_once: int = AT_ONCE, most_batches: int | None = None) -> DataFrame:
        """The columns of keep with response, usage, tries, error and run of each prompt; null where it wasn't asked.

        Equal prompts are asked once. What is in the ledger isn't asked, but for failures that have tries left: `tries` is a
        prompt's budget over all runs, with waits that double. A task has at_once requests under way. most_batches bounds what
        this run asks; a later one goes on.
        """
        rows = written(prompts.select(*keep, F.col(prompt).alias("prompt__")).withColumn("hash__", F.when(F.col("prompt__").isNotNull(), prompt_hash(F.col("prompt__"), self.model))), "asked")
        known = self.answers().select(F.col("hash").alias("hash__"), "tries", (F.col("error").isNull() | (F.col("tries") >= tries)).alias("settled"))
        todo = rows.where("hash__ is not null").groupBy("hash__").agg(F.first("prompt__").alias("prompt")).join(known, "hash__", "left").where("settled is null or not settled")
        todo = written(todo.select(F.col("hash__").alias("hash"), "prompt", F.coalesce("tries", F.lit(0)).alias("tries")), "to-ask")
        n = max(1, -(-todo.count() // batch))
        m = self.versions.manifest() or {"folders": [], "runs": 0}
        run = m["runs"] + 1
        for b in range(n if most_batches is None else min(n, most_batches)):
            part = todo.where(F.pmod(F.xxhash64("hash"), F.lit(n)) == b) if n > 1 else todo
            if not part.limit(1).count():
                continue
            folder = self.versions.new_folder(f"run-{run}-{b}")
            asked(part, provider, tries, wait, at_once).withColumn("run", F.lit(run)).write.parquet(self.versions.at(folder))
            m = {"folders": [*m["folders"], folder], "runs": run}
            self.versions.publish(m)
        return rows.join(self.answers().withColumnRenamed("hash", "hash__"), "hash__", "left").select(*keep, "response", "usage", "tries", "error", "run")


def asked(prompts: DataFrame, provider: Completion, tries: int, wait: float, at_once: int) -> DataFrame:
    """hash, response, usage, tries and error. prompts: hash, prompt, tries (so far)."""

    def ask(row: tuple[str, str, int]) -> tuple[str, str | None, int | None, int, str | None]:
        key, text, done = row
        error = None
        for k in range(done, tries):
            if k > done:
                time.sleep(wait * 2 ** (k - done - 1))
            try:
                said = provider([text])[0]
                return key, said, len(text) + len(said), k + 1, None
            except Exception as e:  # any failure of a provider is a row's error
                error = f"{type(e).__name__}: {e}"
        return key, None, None, tries, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in (part for whole in batches for part in slices(whole, 1)):
                got = list(pool.map(ask, zip(*(c.to_pylist() for c in batch.columns), strict=True)))
                columns = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["hash", "response", "usage", "tries", "error"])

    return prompts.select("hash", "prompt", "tries").mapInArrow(run, "hash string, response string, usage long, tries int, error string")


class TagVectors:
    """Vectors of tags at a path, kept by tag and by the model that made them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.versions = spark, Versions(spark, path)

    def vectors(self) -> DataFrame:
        """tag, vector, and made, the number of the refresh that embedded it."""
        m = self.versions.manifest()
        return self.versions.read("tag string, vector array<float>, made int", *(m["folders"] if m else ()))

    def refresh(self, tags: DataFrame, model: str = "hash-64", provider: Embedding | None = None, dim: int = 64) -> int:
        """Embed the tags (column tag) that aren't kept, drop those that are not in use, and give how many were embedded. Another
        model or dimension makes all anew."""
        m = self.versions.manifest() or {"folders": [], "model": None, "refreshes": 0}
        number = m["refreshes"] + 1
        tags = written(tags.where("tag is not null and tag <> ''").select("tag").distinct(), "tags")
        old = self.versions.read("tag string, vector array<float>, made int", *(m["folders"] if m["model"] == f"{model}:{dim}" else ()))
        known, new = written(old.join(tags, "tag", "left_semi"), "kept-tags"), small(tags.join(old.select("tag"), "tag", "left_anti"), "new-tags")
        n = new.count()
        if not n and known.count() == old.count() and m["model"] == f"{model}:{dim}":
            return 0
        made = embed(new.withColumn("text", F.col("tag")), provider, dim).select("tag", F.col("embedding").cast("array<float>").alias("vector"), F.lit(number).alias("made"))
        folder = self.versions.new_folder(f"refresh-{number}")
        known.unionByName(made).write.parquet(self.versions.at(folder))
        self.versions.publish({"folders": [folder], "model": f"{model}:{dim}", "refreshes": number})
        self.versions.clean(2, lambda x: x["folders"])
        return n
