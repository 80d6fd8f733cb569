"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import lines, one_bit, packing, pieces, quality_classifier, quality_rules, shared_terms, sharding, simhash, spans, tiff, toxicity, warc
from rillwork.llm.shared import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def end_tokenizer():
    """The encoder of the contract: the ids of the file byte_bpe_50k.json, its added strings with their own ones."""
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), end_tokenizer())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text without cross-site boilerplate, and how many lines went."""
    return lines.remove_boilerplate(documents(spark, sf_dir), removed_col="n_removed").select("doc_id", "text", "n_removed")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archives to the shared folder and read them back; digests of responses are of what was read."""
    folder = scratch_path(spark, "warc")
    warc.write_warc(warc.page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    rows = warc.read_warc(spark, folder).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).try_cast("long")
    own = F.col("payload").isNotNull()
    return rows.select(
        number("record_id").alias("page_id"), F.when(own, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and tell whether the text came back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir).select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ids = pieces.encoded(docs, model, "key")
    ids = ids.select("key", F.size("ids").cast("long").alias("n_ids"), F.crc32(F.array_join("ids", " ")).alias("ids_crc32"), "ids")
    text = pieces.decoded(ids, model, ("key", "n_ids", "ids_crc32"))
    return text.select("key.doc_id", "n_ids", "ids_crc32", (F.sha2("text", 256) == F.col("key.sha")).alias("lossless"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_verdicts(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.balanced_shards(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(documents(spark, sf_dir)).select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.stored_texts(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"
    )
    pages = tiff.tiff_pages(stored, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"), feature=True)
    n = F.length("samples")
    return pages.select(
        "doc_id", "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", n - 63, F.lit(64))).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_terms.shared_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans.aligned(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), texts=False)
    return rows.withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_toxicity, op3_packing, op4_line_dedup, op5_warc, op6_sentencepiece, op7_quality_rules, op8_sharding, op9_simhash, op10_tiff, op11_ranked_search, op12_one_bit_search, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4, "op5_warc": OP5, "op7_quality_rules": OP7, "op11_ranked_search": OP11}


OP7 = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), grams AS (
  SELECT doc_id, pos, CASE WHEN lead(w, 7) OVER p IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p,
    lead(w, 4) OVER p, lead(w, 5) OVER p, lead(w, 6) OVER p, lead(w, 7) OVER p) END AS gram
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
), often AS (
  SELECT doc_id, pos, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 THEN 1 ELSE 0 END AS o FROM grams
), covered AS (
  SELECT doc_id, max(o) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM often
), repeats AS (SELECT doc_id, sum(c) AS n FROM covered GROUP BY doc_id),
stats AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(DISTINCT w) AS n_distinct, max(strlen(w)) AS longest FROM words GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (strlen(coalesce(text, '')) - strlen(translate(coalesce(text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_distinct, 0) AS n_distinct, coalesce(longest, 0) AS longest,
    strlen(coalesce(text, '')) - strlen(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper
  FROM documents d LEFT JOIN stats USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * greatest(n_words, 1)
    OR (10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3) OR 2 * word_chars < 4 * greatest(n_words, 1) OR word_chars > 15 * greatest(n_words, 1)
    OR (20 * n_distinct < n_words AND n_words >= 100) OR 2 * n_upper > word_chars OR longest > 1000) AS kept
FROM m
"""

OP4 = """
WITH lines AS (
  SELECT doc_id, source, pos, line, trim(line) AS key FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), wide AS (
  SELECT key FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT source) >= 6
), ranked AS (
  SELECT l.doc_id, l.pos, l.line, w.key IS NOT NULL AND row_number() OVER (PARTITION BY l.key ORDER BY l.doc_id, l.pos) > 1 AS gone
  FROM lines l LEFT JOIN wide w ON l.key = w.key
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n_removed FROM ranked GROUP BY doc_id
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS kept FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to FROM q
"""

OP11 = r"""
WITH q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, n_docs),
part AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS c
  FROM tf JOIN lengths USING (doc_id) JOIN w USING (term), corpus
), scored AS (SELECT item_id, doc_id, sum(c)::BIGINT AS score FROM q JOIN part USING (term) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
) WHERE rank <= 10
"""
