"""Corpus lifecycle: states, consistency, deletion, tags, reindexing, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions.text import file_name, file_type
from rillwork.operators.index import contextual, embed_text, payload_update, vector_upsert
from rillwork.operators.phrase_index import StoredIndex
from rillwork.operators.prompts import tags
from rillwork.operators.provider import Completion, Embedding, embed, keywords
from rillwork.tables import scratch_path, written

# The legal changes of state.
LEGAL = {"pending": ("synced", "failed"), "synced": ("dirty",), "dirty": ("synced", "failed"), "failed": ("pending",)}


def is_legal(old: Column, new: Column) -> Column:
    allowed = F.lit(False)
    for a, targets in LEGAL.items():
        allowed = allowed | ((old == a) & new.isin(*targets))
    return allowed


def apply_transitions(status: DataFrame, requests: DataFrame) -> DataFrame:
    """id, old, new and outcome of each request: applied, noop, rejected, or unknown where the id has no state."""
    both = requests.join(status.withColumnRenamed("sync_status", "old"), "id", "left")
    old, new = F.col("old"), F.col("new")
    outcome = F.when(old.isNull(), "unknown").when(old == new, "noop").when(is_legal(old, new), "applied").otherwise("rejected")
    return both.select("id", "old", "new", outcome.alias("outcome"), F.when(outcome == "applied", new).otherwise(old).alias("sync_status"))


def health_fast(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts of chunks and of vectors for each document, and whether they agree."""
    c = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    v = vectors.groupBy("document_id").agg(F.count("*").alias("n_vectors"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return c.join(v, "document_id", "full_outer").select("document_id", zero("n_chunks"), zero("n_vectors")).withColumn("ok", F.col("n_chunks") == F.col("n_vectors"))


def health_full(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunk_id and problem: missing (no vector) or orphaned (no chunk)."""
    c, v = chunks.select("chunk_id", F.lit(1).alias("c")), vectors.select("chunk_id", F.lit(1).alias("v"))
    both = c.join(v, "chunk_id", "full_outer").where("c is null or v is null")
    return both.select("chunk_id", F.when(F.col("v").isNull(), "missing").otherwise("orphaned").alias("problem"))


def health_mark(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """document_id, old and new state: after a failed check synced becomes dirty and pending becomes failed."""
    bad = health_fast(chunks, vectors).where("not ok").select("document_id")
    lost = health_full(chunks, vectors).where("problem = 'missing'").join(chunks.select("chunk_id", "document_id"), "chunk_id").select("document_id")
    marked = docs.join(bad.unionByName(lost).distinct().withColumn("bad", F.lit(True)), "document_id", "left")
    old = F.col("sync_status")
    new = F.when(F.col("bad") & (old == "synced"), "dirty").when(F.col("bad") & (old == "pending"), "failed").otherwise(old)
    return marked.select("document_id", old.alias("old_status"), new.alias("new_status"))


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without what belongs to the ids. With key document_id, tables that only have chunk_id lose the
    chunks of the documents; with key chunk_id only the chunks' own rows go."""
    chunks = tables["chunks"]
    gone_chunks = chunks.join(ids.select(key), key, "left_semi").select("chunk_id")
    by_document = key == "document_id"
    out = {}
    for name, table in tables.items():
        if by_document and "document_id" in table.columns:
            out[name] = table.join(ids.select("document_id"), "document_id", "left_anti")
        elif "chunk_id" in table.columns:
            out[name] = table.join(gone_chunks, "chunk_id", "left_anti")
        else:
            out[name] = table
    return out


def retag(chunks: DataFrame, new_tags: DataFrame) -> DataFrame:
    """The tags of whole documents (document_id, tags) on all of their chunks; others keep theirs."""
    return chunks.join(new_tags.select("document_id", F.col("tags").alias("new_tags")), "document_id", "left").withColumn("tags", F.coalesce("new_tags", "tags")).drop("new_tags")


def retag_untagged(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, provider: Completion = keywords) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) with new tags for documents that have none: text rebuilt from chunks, asked for, and written to
    all chunks and to the vectors' payload."""
    todo = untagged_docs(docs, chunks)
    texts = rebuild_document(chunks.join(todo, "document_id", "left_semi")).withColumnRenamed("text", "content")
    new = written(tags(texts, tag_use(chunks), provider), "new-tags")
    payload = chunks.select("chunk_id", "document_id").join(new, "document_id").select("chunk_id", "tags")
    return retag(chunks, new), payload_update(vectors, payload)


def untagged_docs(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents none of whose chunks has a tag."""
    some = F.sum(F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, 1).otherwise(0))
    return docs.select("document_id").join(chunks.groupBy("document_id").agg(some.alias("n")), "document_id", "left").where(F.coalesce("n", F.lit(0)) == 0).select("document_id")


def unique_tags(chunks: DataFrame) -> DataFrame:
    """Distinct tags that aren't empty."""
    return tag_use(chunks).select("tag")


def tag_use(chunks: DataFrame) -> DataFrame:
    """tag and n, how many times it is in use."""
    return chunks.select(F.explode("tags").alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


def doc_tags(chunks: DataFrame) -> DataFrame:
    """Distinct sorted tags of each document."""
    return chunks.select("document_id", F.explode_outer("tags").alias("tag")).groupBy("document_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def doc_chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks of each document: all, and those in sync."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.count_if(F.col("sync_status") == "synced").alias("synced_count"))


def rebuild_document(chunks: DataFrame) -> DataFrame:
    """A document's text from its chunks in order, joined by line ends."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n").alias("text"))


def document_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The document list: file name and type, counts, tags, weight, state."""
    stats, tags = doc_chunk_stats(chunks), doc_tags(chunks)
    both = docs.join(stats, "document_id", "left").join(tags, "document_id", "left")
    return both.select(
        "document_id", file_name(F.col("source_path"), F.col("title")).alias("file_name"), file_type(F.col("source_path")).alias("file_type"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce("synced_count", F.lit(0)).alias("synced_count"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "weight", "sync_status",
    )


def reindex_targets(docs: DataFrame, document_id: int | None = None, everything: bool = False) -> DataFrame:
    """One document, all, or those that are dirty or failed."""
    if document_id is not None:
        return docs.where(F.col("document_id") == document_id)
    return docs if everything else docs.where(F.col("sync_status").isin("dirty", "failed"))


def reindex(targets: DataFrame, chunks: DataFrame, vectors: DataFrame, provider: Embedding | None = None, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """Embed the targets' chunks anew and merge them: (vectors after the run, report by document).

    The report has chunks, those with a vector of the dimension in the merged table, and the states. A document that is in
    sync becomes dirty first. One that failed can't, so its chunks are rejected and it stays. vectors: chunk_id, embedding.
    """
    own = chunks.join(targets.select("document_id", F.col("sync_status").alias("was")), "document_id").withColumn("allowed", F.col("was").isin("synced", "dirty", "pending"))
    own = own.withColumn("text__", embed_text(own)).select("document_id", "chunk_id", "was", "allowed", "text__")
    new = embed(own.where("allowed").select("chunk_id", "text__"), provider, dim, "text__").select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
    merged = written(vector_upsert(vectors.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")), new), "reindexed")
    has = merged.select("chunk_id", (F.size("embedding") == dim).alias("has"))
    done = own.join(has, "chunk_id", "left").withColumn("good", F.col("allowed") & F.coalesce("has", F.lit(False)))
    per = done.groupBy("document_id", "was").agg(F.count("*").alias("total"), F.count_if("good").alias("succeeded"))
    failed = F.col("total") - F.col("succeeded")
    status = F.when(F.col("was") == "failed", "failed").when(failed == 0, "synced").otherwise("failed")
    report = per.select("document_id", "total", "succeeded", failed.alias("failed"), status.alias("sync_status"), F.when(F.col("was") == "failed", "rejected: failed -> dirty").alias("error"))
    return merged, report


def reindex_errors(report: DataFrame) -> DataFrame:
    """The errors of a run, a row each."""
    return report.where("error is not null").select("document_id", "error")


def reindex_rollup(report: DataFrame) -> DataFrame:
    """One row: documents that succeeded and failed, and how many errors there are; reindex_errors() lists them."""
    return report.agg(F.count_if(F.col("failed") == 0).alias("succeeded"), F.count_if(F.col("failed") > 0).alias("failed"), F.count("error").alias("errors"))


def contextualize_update(chunks: DataFrame, contexts: DataFrame, vectors: DataFrame, provider: Embedding | None = None, dim: int = 64, index: StoredIndex | None = None) -> tuple[DataFrame, DataFrame, StoredIndex]:
    """Chunks that get a context, their vectors embedded anew and merged, and the index over contexts, which takes up the
    chunks that it doesn't have. Without an index, a new one in the scratch folder.

    context_embedded becomes true where a context came; marks that were true stay. chunks may lack that column: then no
    chunk's context has been embedded.
    """
    marked = F.coalesce("context_embedded", F.lit(False)) if "context_embedded" in chunks.columns else F.lit(False)
    both = chunks.join(contexts.select("chunk_id", F.col("context").alias("new")), "chunk_id", "left").withColumn("changed", F.col("context").isNull() & F.col("new").isNotNull())
    both = both.withColumn("context", F.coalesce("context", "new")).withColumn("context_embedded", F.col("changed") | marked).drop("new")
    both = written(both, "contextualised")
    fresh = both.where("changed").select("chunk_id", embed_text(both).alias("text__"))
    new = embed(fresh, provider, dim, "text__").select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
    merged = vector_upsert(vectors.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")), new)
    index = StoredIndex.open(chunks.sparkSession, scratch_path(chunks.sparkSession, "context-index")) if index is None else index
    return both.drop("changed"), merged, index.add(contextual(both))


def write_violations(chunks: DataFrame) -> DataFrame:
    """Rows that must not be written: a context marked as embedded that isn't there, or a state that is not open."""
    lost = F.col("context_embedded") & F.col("context").isNull()
    closed = ~F.col("sync_status").isin("pending", "dirty")
    return chunks.where(lost | closed).select("chunk_id", F.when(lost, "no_context").otherwise("bad_status").alias("violation"))


def set_chunk_status(chunks: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """A new state for a set of chunks."""
    return chunks.join(ids.select("chunk_id", F.lit(True).alias("hit")), "chunk_id", "left").withColumn("sync_status", F.when(F.col("hit"), status).otherwise(F.col("sync_status"))).drop("hit")
