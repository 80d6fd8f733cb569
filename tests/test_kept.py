"""What is kept and goes on: the completion ledger, tag vectors, reindexing, the bucketed access summary."""

import pytest
from pyspark.sql import functions as F

from rillwork.operators import ledger, vector_store
from rillwork.streaming import jobs
from rillwork.tables import Versions


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def prompts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, prompt string")


def calls(spark):
    """A provider that counts its calls, over all tasks."""
    count = spark.sparkContext.accumulator(0)

    def provider(texts):
        count.add(len(texts))
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [t.upper() for t in texts]

    return provider, count


def test_equal_prompts_are_asked_once_and_kept(spark, tmp_path):
    provider, count = calls(spark)
    book = ledger.Ledger(spark, str(tmp_path))
    rows = prompts(spark, "a", "b", "a", None, "c")
    assert got(book.complete(rows, provider).fillna("-", ["response"]), "id", "response") == [(0, "A"), (1, "B"), (2, "A"), (3, "-"), (4, "C")] and count.value == 3
    again = ledger.Ledger(spark, str(tmp_path)).complete(prompts(spark, "c", "d"), provider)
    assert got(again, "id", "response", "usage", "run") == [(0, "C", 2, 1), (1, "D", 2, 2)] and count.value == 4
    ledger.Ledger(spark, str(tmp_path), "other model").complete(prompts(spark, "c"), provider)
    assert count.value == 5


def test_a_run_that_stopped_goes_on_and_asks_nothing_twice(spark, tmp_path):
    provider, count = calls(spark)
    rows = prompts(spark, *(f"p{i}" for i in range(40)))
    first = ledger.Ledger(spark, str(tmp_path)).complete(rows, provider, batch=10, most_batches=2)
    some = first.where("response is not null").count()
    assert 0 < some < 40 and count.value == some
    book = ledger.Ledger(spark, str(tmp_path))
    Versions(spark, str(tmp_path)).folder.create("data/run-9-0-left/part-0.parquet", "left by a run that died")
    assert book.complete(rows, provider, batch=10).where("response is null").count() == 0 and count.value == 40


def test_failures_have_a_budget_of_tries(spark, tmp_path):
    provider, count = calls(spark)
    book = ledger.Ledger(spark, str(tmp_path))
    rows = prompts(spark, "good", "bad")
    assert got(book.complete(rows, provider, tries=2, wait=0.0).fillna("-"), "id", "response", "tries", "error") == [(0, "GOOD", 1, "-"), (1, "-", 2, "RuntimeError: refused")]
    assert count.value == 3
    book.complete(rows, provider, tries=2, wait=0.0)
    assert count.value == 3  # used up
    assert got(book.complete(rows, lambda ts: ["ok"] * len(ts), tries=3, wait=0.0), "id", "response", "tries") == [(0, "GOOD", 1), (1, "ok", 3)]


def test_only_new_tags_are_embedded(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def provider(texts):
        asked.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    tags = lambda *x: spark.createDataFrame([(t,) for t in x], "tag string")
    store = ledger.TagVectors(spark, str(tmp_path))
    assert store.refresh(tags("a", "bb", "a", "", None), "m1", provider, 2) == 2
    assert store.refresh(tags("a", "bb"), "m1", provider, 2) == 0
    assert store.refresh(tags("bb", "ccc"), "m1", provider, 2) == 1 and asked.value == 3
    assert got(ledger.TagVectors(spark, str(tmp_path)).vectors(), "tag", "vector", "made") == [("bb", [2.0, 1.0], 1), ("ccc", [3.0, 1.0], 2)]
    assert store.refresh(tags("bb", "ccc"), "m2", provider, 2) == 2 and asked.value == 5
    assert store.refresh(tags(), "m2", provider, 2) == 0 and store.vectors().count() == 0


def corpus(spark):
    docs = spark.createDataFrame([(i, "failed" if i == 4 else "dirty") for i in range(8)], "document_id long, sync_status string")
    chunks = spark.createDataFrame([(10 * i + k, i, f"text {i} {k}", "ctx" if k else None) for i in range(8) for k in range(2)], "chunk_id long, document_id long, content string, context string")
    return docs, chunks


def test_reindexing_resumes_and_takes_over_at_once(spark, tmp_path):
    docs, chunks = corpus(spark)
    asked = spark.sparkContext.accumulator(0)

    def provider(texts):
        asked.add(len(texts))
        return [[1.0, 2.0, 3.0] for _ in texts]

    store = vector_store.VectorStore(spark, str(tmp_path))
    store.put(chunks.select("chunk_id", "document_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")), 2)
    first = store.reindex(docs, chunks, 3, provider, batches=4, most_batches=2)
    seen = asked.value
    assert not first.done and 0 < seen < 14 and got(store.vectors().select(F.size("embedding").alias("n")).distinct(), "n") == [(2,)]
    again = vector_store.VectorStore(spark, str(tmp_path))
    second = again.reindex(docs, chunks, 3, provider, batches=4)
    assert second.done and asked.value == 14 and again.dim() == 3
    assert got(again.vectors(), "chunk_id") == [(10 * i + k,) for i in range(8) if i != 4 for k in range(2)]
    assert got(second.report, "document_id", "sync_status", "succeeded") == [(i, "failed" if i == 4 else "synced", 0 if i == 4 else 2) for i in range(8)]
    marks = dict(got(vector_store.marked(chunks, again), "chunk_id", "context_embedded"))
    assert marks == {10 * i + k: bool(k) and i != 4 for i in range(8) for k in range(2)}


def test_reindexing_takes_over_only_whole_and_of_one_dimension(spark, tmp_path):
    docs, chunks = corpus(spark)
    store = vector_store.VectorStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.put(spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0, 2.0])], "chunk_id long, document_id long, embedding array<float>"), 2)
    store.put(chunks.select("chunk_id", "document_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")), 2)
    short = lambda texts: [[1.0] * (1 if "text 3 1" in t else 3) for t in texts]
    found = store.reindex(docs, chunks, 3, short, batches=2)
    assert not found.done and got(found.problems, "chunk_id", "problem") == [(31, "dimension")] and store.dim() == 2
    assert dict(got(found.report, "document_id", "sync_status"))[3] == "failed"
    with pytest.raises(ValueError):
        store.reindex(docs.where("document_id < 3"), chunks, 3, lambda ts: [[1.0] * 3 for _ in ts], batches=3)
    assert store.reindex(docs.where("document_id < 3"), chunks, 2, lambda ts: [[5.0, 5.0] for _ in ts], batches=3).done
    rows = dict(got(store.vectors(), "chunk_id", "embedding"))
    assert len(rows) == 16 and rows[0] == [5.0, 5.0] and rows[30] == [1.0, 0.0]


def test_a_batch_writes_the_buckets_that_it_touches(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), tmp_path / "ck"

    def come(*ids):
        spark.createDataFrame([(i,) for i in ids], "chunk_id long").selectExpr("chunk_id", "timestamp_ntz'2024-01-01' as accessed_at").coalesce(1).write.mode("append").parquet(str(src))
        jobs.access_stream(spark.readStream.schema("chunk_id long, accessed_at timestamp_ntz").parquet(str(src)), out, str(ck), buckets=16).awaitTermination()

    come(*range(200))
    before = Versions(spark, out).manifest()["folders"]
    come(7, 7)
    after = Versions(spark, out).manifest()["folders"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert jobs.latest(spark, out).where("chunk_id = 7").first().access_count == 3 and jobs.latest(spark, out).count() == 200
    assert len(Versions(spark, out).numbers()) == 2
