"""Query transformation: variants (query_id, variant_no, text, route) from model responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.functions.text import parse_strings, strip
from rillwork.operators.provider import Completion, complete, echo

REWRITE_PROMPT = "Rewrite this search query so that it is clear, specific and free of noise. Answer with the query alone."
FUSION_PROMPT = "Write {n} differently worded queries with the meaning of this one. Answer with a JSON array of strings alone."
HYDE_PROMPT = "Write a short passage, as from a manual, that answers this query. Answer with the passage alone."
#: Kinds of rewriting in the training-pair data set.
REWRITE_TYPES = {
    "paraphrase": "Say this query in other words.",
    "keywords": "Turn this query into a few keywords.",
    "colloquial": "Say this query as one would in talk.",
}
VARIANTS = 4


def identity(queries: DataFrame) -> DataFrame:
    """Each query as it is, by the direct route."""
    return queries.select("query_id", F.lit(0).cast("long").alias("variant_no"), "text", F.lit("direct").alias("route"))


def prompted(queries: DataFrame, instruction: str) -> DataFrame:
    """Add prompt: the instruction, a blank line, the query."""
    return queries.withColumn("prompt", F.concat(F.lit(instruction + "\n\n"), "text"))


def rewrite(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """One cleaned text per query; missing, blank or unchanged answers leave the query as it is."""
    both = queries.select("query_id", "text").join(responses.select("query_id", "response"), "query_id", "left")
    clean = strip(F.col("response"))
    text = F.when(clean.isNull() | (clean == "") | (clean == F.col("text")), F.col("text")).otherwise(clean)
    return both.select("query_id", F.lit(0).cast("long").alias("variant_no"), text.alias("text"), F.lit("direct").alias("route"))


def fusion(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """The variants of a JSON array, by the fusion route; the query itself where there are none."""
    both = queries.select("query_id", "text").join(responses.select("query_id", "response"), "query_id", "left").withColumn("v", parse_strings(F.col("response")))
    found = both.select("query_id", F.posexplode("v").alias("i", "text")).select("query_id", F.col("i").cast("long").alias("variant_no"), "text", F.lit("fusion").alias("route"))
    return found.unionByName(identity(both.where(F.coalesce(F.size("v"), F.lit(0)) <= 0)))


def hyde(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """The query's own text with `hypothesis`, the passage to embed, by the hyde route; without one, identity."""
    both = queries.select("query_id", "text").join(responses.select("query_id", "response"), "query_id", "left")
    clean = strip(F.col("response"))
    good = clean.isNotNull() & (clean != "")
    return both.select("query_id", F.lit(0).cast("long").alias("variant_no"), "text", F.when(good, "hyde").otherwise("direct").alias("route"), F.when(good, clean).alias("hypothesis"))


def compose_variants(parts: list[DataFrame]) -> DataFrame:
    """The variants of several transformers, numbered anew in their order."""
    rows = reduce(DataFrame.unionByName, [p.select("query_id", "variant_no", "text", "route", F.lit(i).alias("part")) for i, p in enumerate(parts)])
    return rows.select("query_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("part", "variant_no")) - 1).cast("long").alias("variant_no"), "text", "route")


def first_direct(variants: DataFrame) -> DataFrame:
    """The first variant of the direct route of each query."""
    return variants.where(F.col("route") == "direct").groupBy("query_id").agg(F.min_by("text", "variant_no").alias("text"))


def rewrite_pairs(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """Training pairs from (query_id, rewrite_type, response): not null, of 5 characters or more, and not the query
    itself but for case and outer blanks."""
    clean = strip(F.col("response"))
    both = queries.select("query_id", "text").join(responses.select("query_id", "rewrite_type", "response"), "query_id").withColumn("rewritten", clean)
    good = F.col("rewritten").isNotNull() & (F.length("rewritten") >= 5) & (F.lower("rewritten") != F.lower(strip(F.col("text"))))
    return both.where(good).select("query_id", F.col("text").alias("original_query"), F.col("rewritten").alias("rewritten_query"), "rewrite_type")


def rewrite_stats(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of each query, and whether it got none."""
    n = pairs.groupBy("query_id").agg(F.count("*").alias("n_pairs"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"), F.col("n_pairs").isNull().alias("failed"))


def rewrite_dataset(queries: DataFrame, provider: Completion = echo) -> DataFrame:
    """All three kinds of rewriting for each query, asked and filtered."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("say")) for k, v in REWRITE_TYPES.items()))).alias("k")
    asked = queries.select("query_id", "text", kinds).select("query_id", F.col("k.kind").alias("rewrite_type"), F.concat("k.say", F.lit("\n\n"), "text").alias("prompt"))
    return rewrite_pairs(queries, complete(asked, provider, ("query_id", "rewrite_type")).select("query_id", "rewrite_type", "response"))
