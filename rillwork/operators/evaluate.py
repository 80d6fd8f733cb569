"""Evaluation: sampling, splits, metrics and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.functions.text import strip, tokens
from rillwork.operators.score import of_hits, rank_hits
from rillwork.tables import small, written

#: Tokens by which a passage's candidates are found, and passages up to which these are broadcast.
ANCHOR, BROADCAST_QUERIES = 4, 100_000


def draw(key: Column, seed: int) -> Column:
    """A random order that any engine can repeat: the MD5 of the key and a seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def eligible_chunks(chunks: DataFrame, docs: DataFrame, least: int = 100, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Chunks of titled documents with content of `least` characters or more; of the included documents, or not of
    the excluded ones."""
    if include is not None and exclude is not None:
        raise ValueError("include and exclude can't both be given")
    docs = docs.where(F.coalesce(F.col("title"), F.lit("")) != "")
    if include is not None:
        docs = docs.join(include.select("document_id"), "document_id", "left_semi")
    if exclude is not None:
        docs = docs.join(exclude.select("document_id"), "document_id", "left_anti")
    return chunks.where(F.length("content") >= least).join(docs.select("document_id", F.col("title").alias("document_title")), "document_id")


def sample_quota(eligible: DataFrame, total: int) -> DataFrame:
    """document_id, n_chunks and quota.

    A document's share is rounded half to even and 1 at least; while the sum is too large, the largest quota loses
    one. That is the same as laying the quotas out in units and dropping the highest units first, which needs no
    loop: a quota's units are its levels 1 to q, and so many of the highest levels go as there are too many.
    """
    per = eligible.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    all_of_them = per.agg(F.sum("n_chunks").alias("n_all"))
    share = per.crossJoin(F.broadcast(all_of_them))  # one row
    quota = F.when(F.col("n_all") <= total, F.col("n_chunks")).otherwise(F.greatest(F.lit(1), F.bround(F.lit(total) * F.col("n_chunks") / F.col("n_all")))).cast("long")
    share = share.withColumn("quota", quota)
    # how many units stand at each level, from the top; the level at which the excess ends, and what is left there
    levels = share.groupBy("quota").agg(F.count("*").alias("docs"))
    units = levels.select(F.explode(F.sequence(F.lit(1).cast("long"), "quota")).alias("level"), "docs").groupBy("level").agg(F.sum("docs").alias("at_level"))
    excess = share.agg((F.sum("quota") - F.least(F.lit(total), F.max("n_all"))).alias("excess"))
    above = units.crossJoin(F.broadcast(excess)).withColumn("above", F.coalesce(F.sum("at_level").over(Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = above.where((F.col("above") < F.col("excess")) & (F.col("above") + F.col("at_level") >= F.col("excess"))).agg(F.max("level").alias("cut_level"), F.max(F.col("excess") - F.col("above")).alias("cut_rows"))
    ranked = share.crossJoin(F.broadcast(cut))
    held = F.least("quota", F.col("cut_level") - 1)
    at_cut = ranked.where(F.col("quota") >= F.col("cut_level")).select("document_id", "cut_rows")
    # of the documents that reach the cut level the first ones, in order, lose that unit too
    order = _numbered_by(at_cut, "document_id")
    kept = ranked.join(order.select("document_id", "no"), "document_id", "left")
    final = F.when(F.col("cut_level").isNull() | (F.col("quota") < F.col("cut_level")), F.col("quota")).otherwise(held + F.when(F.col("no") > F.col("cut_rows"), 1).otherwise(0))
    return kept.select("document_id", "n_chunks", final.cast("long").alias("quota"))


def _numbered_by(rows: DataFrame, key: str) -> DataFrame:
    """Numbers from 1 in order of a key, by ranges: rows of a range in one task, sizes of the ranges summed up. Ranges are written,
    as two plans that read them would each merge small ones in their own way."""
    ranged = written(rows.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = ranged.withColumn("in_part", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    return inside.join(F.broadcast(before), "part").withColumn("no", (F.col("before") + F.col("in_part")).cast("long")).drop("part", "before", "in_part")


def sample_stratified(eligible: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """chunk_id and document_id: each document's quota of its chunks, drawn at random."""
    quota = sample_quota(eligible, total).select("document_id", "quota")
    w = Window.partitionBy("document_id").orderBy(draw(F.col("chunk_id"), seed), "chunk_id")
    drawn = eligible.withColumn("no", F.row_number().over(w)).where(F.col("no") <= total)  # no quota is larger, so groups are cut before the shuffle
    return drawn.join(quota, "document_id").where(F.col("no") <= F.col("quota")).select("chunk_id", "document_id")


def auto_split(docs: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """document_id and included: max(1, round(n * fraction)) documents, drawn at random."""
    keyed = docs.select("document_id", draw(F.col("document_id"), seed).alias("d"))
    n = docs.count()
    most = max(1, round(n * fraction)) if n else 0
    return _numbered_by(keyed, "d").select("document_id", (F.col("no") <= most).alias("included"))


def split_manifest(split: DataFrame, fraction: float) -> DataFrame:
    """The manifest as rows (split_ratio, document_id, side), since lists of all ids outgrow a row."""
    return split.select(F.lit(fraction).alias("split_ratio"), "document_id", F.when(F.col("included"), "included").otherwise("excluded").alias("side"))


def _runs_of(k: int) -> Column:
    """Each k words of w that stand together."""
    return F.transform("w", lambda _, i: F.array_join(F.slice("w", i + 1, F.lit(k)), " "))


def _letters_of(n: int) -> Column:
    """Each n letters of token that stand together."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - n + 1, F.lit(1))), lambda i: F.substring("token", i, F.lit(n)))


def containing(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ground truth: query_id and chunk_id where the content holds the query's whole text.

    A passage may begin or end within a word, so only its inner tokens are sure to be tokens of the content: up to ANCHOR of
    them are met in an equi-join. A passage of one or two tokens has none; the longer one then stands within a token of the
    content, and such tokens are found in the vocabulary by their first three letters. The text decides in the end.
    """
    text = written(queries.select("query_id", "text", tokens(F.col("text")).alias("w")).where(F.size("w") > 0), "passages")
    words = written(chunks.select("chunk_id", tokens(F.col("content")).alias("w")), "words")
    few = F.broadcast if text.count() <= BROADCAST_QUERIES else lambda df: df
    many = F.least(F.lit(ANCHOR), F.size("w") - 2)
    inner = text.where(F.size("w") > 2).select("query_id", F.array_join(F.slice("w", F.lit(2), many), " ").alias("gram"), many.alias("k"))
    widths = [r["k"] for r in inner.select("k").distinct().collect()]  # ANCHOR at most
    pairs = text.select("query_id", F.lit(0).cast("long").alias("chunk_id")).where(F.lit(False))
    for k in widths:
        rows = words.select("chunk_id", F.explode(F.array_distinct(_runs_of(k))).alias("gram"))
        pairs = pairs.unionByName(rows.join(few(inner.where(F.col("k") == k)), "gram").select("query_id", "chunk_id"))
    longer = F.when(F.length(F.element_at("w", 1)) >= F.length(F.element_at("w", -1)), F.element_at("w", 1)).otherwise(F.element_at("w", -1))
    short = text.where(F.size("w") <= 2).select("query_id", longer.alias("part")).withColumn("gram", F.substring("part", 1, 3))
    sizes = [r["n"] for r in short.select(F.length("gram").alias("n")).distinct().collect()]  # three at most
    if sizes:
        vocabulary = written(words.select(F.explode(F.array_distinct("w")).alias("token")).distinct(), "vocabulary")
        starts = F.flatten(F.array(*map(_letters_of, sizes)))
        within = vocabulary.select("token", F.explode(F.array_distinct(starts)).alias("gram")).join(few(short), "gram").where(F.contains("token", "part")).select("query_id", "token")
        held = words.select("chunk_id", F.explode(F.array_distinct("w")).alias("token"))
        pairs = pairs.unionByName(held.join(small(within.distinct(), "tokens-within"), "token").select("query_id", "chunk_id"))
    pairs = written(pairs.distinct(), "may-contain")
    found = of_hits(pairs, chunks, "content")
    return pairs.join(few(text.select("query_id", "text")), "query_id").join(found, "chunk_id").where(F.contains("content", "text")).select("query_id", "chunk_id")


def run(queries: DataFrame, search: Callable[[DataFrame], DataFrame], qrels: DataFrame, k: int) -> DataFrame:
    """An evaluation run: blank queries are skipped, the others searched without recording accesses, ranked and measured."""
    asked = queries.where(F.coalesce(strip(F.col("text")), F.lit("")) != "")
    return eval_metrics(asked, rank_hits(search(asked)).select("query_id", "chunk_id", "rank"), qrels, k)


def eval_metrics(queries: DataFrame, ranked: DataFrame, qrels: DataFrame, k: int, sizes: DataFrame | None = None) -> DataFrame:
    """reciprocal_rank, ndcg_at_k and found_at_k of each query; 0 without ground truth or with k <= 0.

    queries: query_id; ranked: query_id, chunk_id, rank from 1; qrels: query_id, chunk_id. Where the truth is a large set
    that needn't be laid out, sizes (query_id, n_truth) tells how large, and qrels has only what was retrieved of it.
    """
    truth = qrels.select("query_id", "chunk_id").distinct()
    size = truth.groupBy("query_id").agg(F.count("*").alias("n_truth")) if sizes is None else sizes
    hits = ranked.join(truth, ["query_id", "chunk_id"])
    in_k = F.col("rank") <= k
    per = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(F.when(in_k, 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.count(F.when(in_k, 1)).alias("found"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_truth"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i.cast("double") + 1))
    both = queries.select("query_id").join(size, "query_id", "left").join(per, "query_id", "left")
    fair = (F.coalesce("n_truth", F.lit(0)) > 0) & F.lit(k > 0)
    return both.select(
        "query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.when(fair, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0), 6).alias("ndcg_at_k"),
        F.round(F.when(fair, F.coalesce("found", F.lit(0)) / F.col("n_truth")).otherwise(0.0), 6).alias("found_at_k"),
    )


def eval_report(metrics: DataFrame, k: int) -> DataFrame:
    """One row: queries, MRR, and the means at k; zeros for none."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return metrics.agg(F.count("*").alias("num_queries"), F.lit(k).cast("long").alias("top_k"), mean("reciprocal_rank").alias("mrr"), mean("ndcg_at_k").alias("mean_ndcg_at_k"), mean("found_at_k").alias("mean_found_at_k"))


def hit_counts(retrieved: DataFrame, qrels: DataFrame) -> DataFrame:
    """Retrieved chunks of each query that are in its ground truth."""
    return retrieved.select("query_id", "chunk_id").distinct().join(qrels.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count("*").alias("n_hits"))
