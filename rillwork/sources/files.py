"""Files in and out: text and Markdown files, parsed-PDF blocks, JSON data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.text import strip

TEXT_TYPES = ("txt", "md", "markdown")
MOST_BYTES = 50 * 1024 * 1024
TEST_SET = "query string, ground_truth_chunk_ids array<string>, source_document_id string, metadata struct<query_type:string,generator_model:string>"
REWRITE_SET = "original_query string, rewritten_query string, rewrite_type string, ground_truth_chunk_ids array<string>, source_document_id string"


def discover(spark: SparkSession, folder: str, types: tuple[str, ...] = TEXT_TYPES) -> DataFrame:
    """Files below a folder with one of the suffixes, in any case of letters, in order of their paths: path, length, content,
    file_type. Order is a range sort by path; a job that doesn't need it loses nothing, as later joins and sums drop it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", "length", "content", suffix.alias("file_type")).where(F.col("file_type").isin(*types)).orderBy("path")


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def first_by_hash(rows: DataFrame) -> DataFrame:
    """file_hash and doc_id: of rows with equal content the one with the least id, which the others repeat."""
    return rows.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))


def parse_files(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """source_path, file_type, title (the stem), file_size, file_hash, content, error.

    Too large, not UTF-8 and blank files have an error and no content; line ends become \\n and outer white space goes.
    """
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string"))
    clean = strip(F.regexp_replace(text, "\r\n?", "\n"))
    error = F.when(F.col("length") > most_bytes, "too large").when(text.isNull(), "not UTF-8").when(clean == "", "empty")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = files.select(F.col("path").alias("source_path"), "file_type", stem.alias("title"), F.col("length").alias("file_size"), file_hash(F.col("content")).alias("file_hash"), clean.alias("content"), error.alias("error"))
    return rows.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))


def rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a batch goes on without the files that failed."""
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("source_path", "error")


def block_title(blocks: Column, stem: Column) -> Column:
    """The first top-level text block of page 0 that isn't blank, else the stem. blocks: JSON of a parsed PDF."""
    items = F.from_json(blocks, "array<struct<text:string,text_level:int,page_idx:int>>")
    heads = F.filter(items, lambda b: (b["text_level"] == 1) & (b["page_idx"] == 0) & (strip(b["text"]) != ""))
    return F.coalesce(strip(F.try_element_at(heads, F.lit(1))["text"]), stem)


def parsed_pairs(files: DataFrame) -> DataFrame:
    """Extracted documents: the Markdown file of a stem and, where it has one, its blocks. The Markdown must be there."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    rows = files.select(stem.alias("stem"), "file_type", F.col("content").cast("string").alias("content"))
    md = rows.where("file_type = 'md'").groupBy("stem").agg(F.min("content").alias("markdown"))
    js = rows.where("file_type = 'json'").groupBy("stem").agg(F.min("content").alias("blocks"))
    name = F.regexp_extract("stem", r"([^/]+)$", 1)
    return md.join(js, "stem", "left").select("stem", "markdown", "blocks", block_title(F.col("blocks"), name).alias("title"))


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of evaluation entries."""
    return spark.read.schema(TEST_SET).option("multiLine", "true").json(path)


def read_rewrite_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REWRITE_SET).option("multiLine", "true").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Test sets, reports, manifests and rewrite pairs, a JSON object a line."""
    rows.write.mode("errorifexists").json(path)


def append_accesses(accesses: DataFrame, path: str) -> None:
    """The access log only grows."""
    accesses.select("chunk_id", "accessed_at").write.mode("append").parquet(path)
