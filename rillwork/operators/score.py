"""Score algebra over hit tables (query_id, chunk_id, score, ...).

A list of the one-query view is a window partition here: by query_id, and by path where paths are unioned. Ties go
by chunk_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.functions.vectors import cosine
from rillwork.tables import small, written

RRF_K = 60
ALPHA, BETA, GAMMA = 0.6, 0.2, 0.2
BASE_HOURS = 24.0
FINAL_THRESHOLD = 0.60
DIGITS = 6


def best_first(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")


def rank_hits(hits: DataFrame, *keys: str) -> DataFrame:
    """Add rank, from 1, within each list."""
    return hits.withColumn("rank", F.row_number().over(best_first(*(keys or ("query_id",)))).cast("long"))


def top_hits(hits: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k of each list; Spark limits the groups before the shuffle."""
    return rank_hits(hits, *keys).where(F.col("rank") <= k).drop("rank")


def normalize_scores(hits: DataFrame, *keys: str) -> DataFrame:
    """Min-max within each list, to 6 digits; 1.0 where all scores are equal."""
    w = Window.partitionBy(*(keys or ("query_id",)))
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("score", F.when(high == low, F.lit(1.0)).otherwise(F.round((F.col("score") - low) / (high - low), DIGITS)))


def rrf_fuse(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of hit lists, normalised. A single list comes back unchanged."""
    if not lists:
        raise ValueError("nothing to fuse")
    weights = [1.0] * len(lists) if weights is None else weights
    if len(weights) != len(lists):
        raise ValueError(f"{len(weights)} weights for {len(lists)} lists")
    if len(lists) == 1:
        return lists[0]
    paths = [x.select("query_id", "chunk_id", "score", F.lit(i).alias("path"), F.lit(float(w)).alias("weight")) for i, (x, w) in enumerate(zip(lists, weights, strict=True))]
    ranked = rank_hits(reduce(DataFrame.unionByName, paths), "query_id", "path")
    return normalize_scores(ranked.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score")))


def metadata_score(hits: DataFrame, queries: DataFrame, chunk_tags: DataFrame, tag_vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """Add metadata_score: the best (cosine + 1) / 2 over a chunk's tags, times the document's weight.

    Without tags, or without a query vector, 0.5 times the weight. chunk_tags: chunk_id, tags; tag_vectors: tag,
    vector; weights: chunk_id, weight. Each query meets each tag once, not once for every chunk that has it.
    """
    tagged = hits.select("query_id", "chunk_id").join(chunk_tags, "chunk_id").select("query_id", "chunk_id", F.explode("tags").alias("tag"))
    pairs = tagged.select("query_id", "tag").distinct().join(tag_vectors, "tag").join(queries.where("embedding is not null").select("query_id", "embedding"), "query_id")
    met = pairs.select("query_id", "tag", ((cosine(F.col("embedding"), F.col("vector")) + 1) / 2).alias("sim"))
    best = tagged.join(met, ["query_id", "tag"])
    best = best.groupBy("query_id", "chunk_id").agg(F.max("sim").alias("sim"))
    with_sim = hits.join(best, ["query_id", "chunk_id"], "left").join(weights, "chunk_id", "left")
    return with_sim.withColumn("metadata_score", F.coalesce("sim", F.lit(0.5)) * F.coalesce("weight", F.lit(1.0))).drop("sim", "weight")


def access_summary(accesses: DataFrame) -> DataFrame:
    """Last access and number of accesses of each chunk."""
    return accesses.groupBy("chunk_id").agg(F.max("accessed_at").alias("last_accessed_at"), F.count("*").alias("access_count"))


def retention(last: Column, count: Column, as_of: Column, base_hours: float = BASE_HOURS, forgotten: bool = False) -> Column:
    """exp(-t / S) with t hours since the last access and S = base (1 + ln(1 + n)); its complement if forgotten."""
    if base_hours <= 0:
        return F.lit(0.0)
    hours = F.timestamp_diff("MICROSECOND", last, as_of) / 3.6e9
    kept = F.exp(-hours / (base_hours * (1 + F.log(1 + count))))
    value = F.when(last.isNull(), 0.0).otherwise(kept)
    return 1 - value if forgotten else value


def retention_score(hits: DataFrame, accesses: DataFrame, as_of: Column, base_hours: float = BASE_HOURS, forgotten: bool = False) -> DataFrame:
    """Add retention_score; chunks without accesses get 0, or 1 if forgotten. Of the log only accesses to hits are summed up."""
    ids = small(hits.select("chunk_id").distinct(), "scored-ids")
    accesses = accesses.join(ids, "chunk_id", "left_semi")
    both = hits.join(access_summary(accesses), "chunk_id", "left")
    return both.withColumn("retention_score", retention(F.col("last_accessed_at"), F.col("access_count"), as_of, base_hours, forgotten)).drop("last_accessed_at", "access_count")


def rerank(hits: DataFrame, threshold: float = FINAL_THRESHOLD, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> DataFrame:
    """From score, metadata_score and retention_score: the final score, all four to 6 digits, cut at the threshold."""
    final = alpha * F.col("score") + beta * F.col("metadata_score") + gamma * F.col("retention_score")
    r = lambda c: F.round(c, DIGITS)
    out = hits.select("query_id", "chunk_id", r(final).alias("final"), r(F.col("score")).alias("retrieval_score"), r(F.col("metadata_score")).alias("metadata_score"), r(F.col("retention_score")).alias("retention_score"))
    return out.withColumnRenamed("final", "score").where(F.col("score") >= threshold)


def of_hits(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Columns of the chunks that were found, and of no others: their ids are broadcast up to a bound, so that what
    isn't found is never shuffled. Written, as several joins read it."""
    ids = small(hits.select("chunk_id").distinct(), "hit-ids")
    return written(chunks.select("chunk_id", *columns).join(ids, "chunk_id", "left_semi"), "hit-chunks")


def of_documents(rows: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Columns of the documents of some chunks, and of no others."""
    ids = small(rows.select("document_id").distinct(), "hit-documents")
    return docs.select("document_id", *columns).join(ids, "document_id", "left_semi")


def hydrate(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Content and title for the last few hits; missing sub-scores are 0, missing content is empty."""
    for c in ("retrieval_score", "metadata_score", "retention_score"):
        if c not in hits.columns:
            hits = hits.withColumn(c, F.lit(0.0))
    hits = written(hits, "last-hits")
    found = of_hits(hits, chunks, "document_id", "content")
    titled = found.join(of_documents(found, docs, "title"), "document_id", "left").select("chunk_id", "content", F.col("title").alias("document_title"))
    out = hits.join(titled, "chunk_id", "left").withColumnRenamed("score", "final_score")
    return out.withColumn("content", F.coalesce("content", F.lit(""))).fillna(0.0, ["retrieval_score", "metadata_score", "retention_score"])
