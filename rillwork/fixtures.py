"""The given tables as the engine's tables, in Spark and, beside it, in SQL."""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillwork.functions.text import tokens
from rillwork.operators.index import contextual
from rillwork.operators.phrase_index import StoredIndex
from rillwork.plans.compose import Corpus
from rillwork.tables import shared_dir

AS_OF = "2024-02-01 00:00:00"
#: Every row whose id is divisible by this is a search query.
EVERY = 50
CITATIONS = "\n\n".join(f"[{i}] Name, A. (2020). Journal. https://x" for i in range(1, 7))


@cache
def schema(path: str) -> StructType:
    """A given table's columns, which a session looks up once."""
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(schema(path)).parquet(path)


def sync_status():
    return F.element_at(F.array(*map(F.lit, ("pending", "synced", "dirty", "failed"))), (F.col("doc_id") % 4 + 1).cast("int"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("document_id"), F.concat("source", F.lit("/"), "doc_id").alias("title"), F.concat(F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("source_path"),
        F.when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"), sync_status().alias("sync_status"),
        F.timestamp_add("SECOND", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"), "text", "lang", "source",
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    label = F.col("label")
    one, two = F.concat(F.lit("tag_"), label), F.concat(F.lit("tag_"), (label + 1) % 10)
    tags = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<string>")).when(F.col("vec_id") % 2 == 0, F.array(one, two)).otherwise(F.array(one))
    return table(spark, d, "embeddings").join(known, "vec_id", "left_semi").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), tags.alias("tags"), "embedding", "label")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """The chunks without tags. Joins for these would shuffle every text of a large table, so what needs content alone reads this."""
    context = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("lang "), "lang", F.lit(" source "), "source"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), F.col("text").alias("content"), context.alias("context"), sync_status().alias("sync_status"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    tagged = vectors(spark, d).select("chunk_id", "tags")
    return texts(spark, d).join(tagged, "chunk_id", "left").select("chunk_id", "document_id", "chunk_index", "content", "context", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "sync_status")


def tag_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector for each tag: that of the least id with the label. There are ten labels."""
    return vectors(spark, d).groupBy("label").agg(F.min_by("embedding", "chunk_id").alias("vector")).select(F.concat(F.lit("tag_"), "label").alias("tag"), "vector")


def accesses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    return rows.select(F.get_json_object("props", "$.k").cast("long").alias("chunk_id"), F.col("ts").alias("accessed_at"))


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def queries(spark: SparkSession, d: str) -> DataFrame:
    """query_id, text (the second and third token of the document) and embedding, null where it has none."""
    rows = table(spark, d, "documents").where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(tokens(F.col("text")), 2, 2), " ").alias("text"))
    return rows.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def index(spark: SparkSession, d: str, context: bool = False) -> StoredIndex:
    """The stored phrase index of the chunks, or of those with context. It lies in the shared folder under a name that follows
    from the files of the tables; the first search that asks for it builds it, later ones, of any session, open it."""
    names = [f for t in ("documents", "embeddings") for f in sorted(table(spark, d, t).inputFiles())]
    stat = lambda f: (at := spark._jvm.org.apache.hadoop.fs.Path(f)).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    key = hashlib.md5("".join(f"{f} {(s := stat(f)).getLen()} {s.getModificationTime()}\n" for f in names).encode()).hexdigest()
    rows = contextual(texts(spark, d)) if context else texts(spark, d)
    n = table(spark, d, "documents").where("doc_id % 2 = 0" if context else "doc_id is not null").count()  # a chunk for each document
    return StoredIndex.open(spark, f"{shared_dir(spark)}/phrase-index-{'context' if context else 'content'}-{key}").backfill(rows, n=n)


def corpus(spark: SparkSession, d: str, *indexes: str) -> Corpus:
    """The tables, with the stored indexes that are named: content, context."""
    made = {i: index(spark, d, i == "context") for i in indexes}
    return Corpus(docs(spark, d), chunks(spark, d), vectors(spark, d), tag_vectors(spark, d), accesses(spark, d), made.get("content"), made.get("context"))


def structured(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text with paragraphs, headings and a list of references."""
    tail = F.when(F.col("doc_id") % 3 == 0, "\n\n# Acknowledgements\n\nThanks.").otherwise("")
    text = F.concat(F.lit("# Introduction\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n# References\n\n" + CITATIONS), tail)
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


def broken_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with gaps, and with orphans."""
    v = vectors(spark, d)
    orphans = v.where("chunk_id % 13 = 0").withColumns({"chunk_id": F.col("chunk_id") + 1_000_000_000, "document_id": F.col("document_id") + 1_000_000_000})
    return v.where("chunk_id % 11 <> 0").unionByName(orphans)


#: A response for a key k: one of six, good and bad.
RESPONSES = ('["one way", " other way ", ""]', '```json\n["fenced"]\n```', '[1, "a"]', '["broken', "[]", "   ")
SYNTH_RESPONSES = ('[{"query": "what is it", "query_type": "structural"}, {"query": " "}]', '```json\n[{"query": "why"}]\n```', "no json here", '[{"query": "how so", "query_type": "comparative"}]', "[]", "   ")


def response(key, choices: tuple[str, ...] = RESPONSES):
    return F.element_at(F.array(*map(F.lit, choices)), (key % len(choices) + 1).cast("int"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """User turns of conversations as queries with given responses."""
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text").withColumn("response", response(F.col("query_id")))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


TOKENS = r"list_filter(string_split_regex(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

#: The same tables as common table expressions; each may use those it names.
CTES: dict[str, str] = {
    "docs": "SELECT d.doc_id AS document_id, source || '/' || d.doc_id AS title, '/' || source || '/' || d.doc_id || '.txt' AS source_path, CASE WHEN quality = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight, ['pending', 'synced', 'dirty', 'failed'][d.doc_id % 4 + 1] AS sync_status, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id) AS created_at, text, lang, source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "vecs": "SELECT vec_id AS chunk_id, vec_id AS document_id, CASE WHEN vec_id % 7 = 0 THEN []::VARCHAR[] WHEN vec_id % 2 = 0 THEN ['tag_' || label, 'tag_' || ((label + 1) % 10)] ELSE ['tag_' || label] END AS tags, embedding::DOUBLE[] AS embedding, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)",
    "chunks": "SELECT d.document_id AS chunk_id, d.document_id, 0::BIGINT AS chunk_index, text AS content, CASE WHEN d.document_id % 2 = 0 THEN 'lang ' || lang || ' source ' || source END AS context, coalesce(v.tags, []::VARCHAR[]) AS tags, sync_status FROM docs d LEFT JOIN vecs v ON v.chunk_id = d.document_id",
    "tag_vecs": "SELECT 'tag_' || label AS tag, arg_min(embedding, chunk_id) AS vector FROM vecs GROUP BY label",
    "accesses": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS chunk_id, ts AS accessed_at FROM events WHERE event_type IN ('view', 'click')",
    "summary": "SELECT chunk_id, max(accessed_at) AS last_accessed_at, count(*) AS access_count FROM accesses GROUP BY chunk_id",
    "queries": f"SELECT doc_id AS query_id, array_to_string(({TOKENS.format('text')})[2:3], ' ') AS text, e.embedding::DOUBLE[] AS embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE doc_id % {EVERY} = 0",
    "structured": "SELECT doc_id, '# Introduction' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || " + quoted("\n\n# References\n\n" + CITATIONS) + " || CASE WHEN doc_id % 3 = 0 THEN " + quoted("\n\n# Acknowledgements\n\nThanks.") + " ELSE '' END AS text FROM documents",
    "broken": "SELECT chunk_id, document_id FROM vecs WHERE chunk_id % 11 <> 0 UNION ALL SELECT chunk_id + 1000000000, document_id + 1000000000 FROM vecs WHERE chunk_id % 13 = 0",
    "turns": f"SELECT conv_id * 1000 + turn AS query_id, text, {_list(RESPONSES)}[(conv_id * 1000 + turn) % 6 + 1] AS response FROM conversations WHERE role = 'user'",
}
NEEDS = {"chunks": ["docs", "vecs"], "tag_vecs": ["vecs"], "summary": ["accesses"], "broken": ["vecs"]}


def with_ctes(sql: str, names: str = "", more: dict[str, str] | None = None) -> str:
    """SQL after the named tables and what these need, then more ones in order."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in wanted:
            wanted.append(name)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({CTES[n]})" for n in wanted] + [f"{n} AS ({s})" for n, s in (more or {}).items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + sql
