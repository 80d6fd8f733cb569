"""Registered queries: each operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork import fixtures as fx
from rillwork.functions import text as tx
from rillwork.operators import evaluate, index, ingest, ledger, lifecycle, phrase_index, prepare, prompts, provider, refine, retrieve, score, semantic, terms, transform, vector_store
from rillwork.plans import compose
from rillwork.sources import files
from rillwork.streaming import jobs
from rillwork.tables import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
TOP_K = 10
VECTOR_FROM = 0.1
#: The given vectors are near random, so reranking cuts at zero.
LOW = {"vector": {"threshold": VECTOR_FROM}, "rerank": {"threshold": 0.0}}
DIM = 64


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def hits(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("score", F.round("score", digits))


def vector_hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.vector_topk(fx.queries(spark, d), fx.vectors(spark, d), TOP_K, VECTOR_FROM)


def bm25_hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.phrase_topk(fx.queries(spark, d), fx.texts(spark, d), TOP_K, stored=fx.index(spark, d))


# sources and sinks


@query
def file_hash(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", files.file_hash(F.encode("text", "UTF-8")).alias("file_hash"))


@query
def ingest_rejects(spark, d):
    """Documents of which no chunk comes, or whose chunks and vectors differ in number."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 97 == 0, "  ").otherwise(F.col("text")).alias("text"))
    chunks = prepare.chunk_fixed(docs)
    vectors = chunks.where((F.col("doc_id") % 89 != 0) | (F.col("chunk_index") > 0))
    return ingest.rejects(docs, chunks, vectors)


@query
def record_access(spark, d):
    """The log after an access to each searched document."""
    new = fx.queries(spark, d).select(F.col("query_id").alias("chunk_id"), fx.as_of().alias("accessed_at"))
    return fx.accesses(spark, d).unionByName(new)


@query
def vector_upsert(spark, d):
    old = fx.vectors(spark, d).select("chunk_id", "label")
    new = old.where("chunk_id % 5 = 0").select("chunk_id", (F.col("label") + 100).alias("label"))
    more = new.select((F.col("chunk_id") + 1_000_000_000).alias("chunk_id"), "label")
    return index.vector_upsert(old, new.unionByName(more))


@query
def vector_delete(spark, d):
    return index.vector_delete(fx.vectors(spark, d).select("chunk_id", "label"), fx.docs(spark, d).where("sync_status = 'failed'").select(F.col("document_id").alias("chunk_id")))


@query
def vector_fetch(spark, d):
    return index.vector_fetch(fx.vectors(spark, d), fx.docs(spark, d).where("sync_status = 'dirty'").select(F.col("document_id").alias("chunk_id"))).select("chunk_id", "tags")


@query
def payload_update(spark, d):
    v = fx.vectors(spark, d).select("chunk_id", "tags")
    return index.payload_update(v, v.where("chunk_id % 3 = 0").select("chunk_id", F.array(F.lit("new")).alias("tags")))


@query
def point_counts(spark, d):
    return fx.vectors(spark, d).groupBy("document_id").agg(F.count("*").alias("n"))


@query
def dim_violations(spark, d):
    v = fx.vectors(spark, d).withColumn("embedding", F.when(F.col("chunk_id") % 10 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return index.dim_violations(v, 64)


@query
def postings_build(spark, d):
    return index.postings(fx.texts(spark, d))


@query
def context_postings(spark, d):
    return index.postings(index.contextual(fx.texts(spark, d)))


@query
def block_title(spark, d):
    """Titles from page blocks; every third document has none of the first level."""
    rows = fx.docs(spark, d)
    block = lambda text, level, page: F.struct(text.alias("text"), F.lit(level).alias("text_level"), F.lit(page).alias("page_idx"))
    level = F.struct(F.substring("text", 1, 20).alias("text"), F.when(F.col("document_id") % 3 == 0, 2).otherwise(1).alias("text_level"), F.lit(0).alias("page_idx"))
    blocks = F.to_json(F.array(block(F.lit(" "), 1, 0), block(F.lit("later"), 1, 1), level))
    return rows.select("document_id", files.block_title(blocks, F.col("title")).alias("title"))


# filters and look-ups


@query
def filter_doc_tags(spark, d):
    return index.filter_vectors(fx.vectors(spark, d), tags=["tag_1", "tag_3"]).select("chunk_id", "tags")


@query
def bm25_doc_filter(spark, d):
    """Hits within one document; the statistics are of all."""
    return hits(retrieve.phrase_topk(fx.queries(spark, d), fx.texts(spark, d), TOP_K, document_id=100, stored=fx.index(spark, d)))


@query
def select_reindex_targets(spark, d):
    return lifecycle.reindex_targets(fx.docs(spark, d)).select("document_id", "sync_status")


@query
def lookup_chunks(spark, d):
    ids = fx.accesses(spark, d).select("chunk_id").distinct()
    return fx.texts(spark, d).join(ids, "chunk_id", "left_semi").select("chunk_id", "content")


@query
def chunks_without_context(spark, d):
    return fx.texts(spark, d).where("context is null").select("chunk_id")


@query
def dedup_file_hash(spark, d):
    """Documents whose content no document with a smaller id has."""
    return files.first_by_hash(file_hash(spark, d))


@query
def preview(spark, d):
    return fx.texts(spark, d).select("chunk_id", tx.preview(F.col("content"), 120).alias("preview"))


# joins, aggregations, windows


@query
def access_summary(spark, d):
    return score.access_summary(fx.accesses(spark, d))


@query
def untagged_docs(spark, d):
    return lifecycle.untagged_docs(fx.docs(spark, d), fx.chunks(spark, d))


@query
def unique_tags(spark, d):
    return lifecycle.unique_tags(fx.chunks(spark, d))


@query
def doc_tags(spark, d):
    return lifecycle.doc_tags(fx.chunks(spark, d)).select("document_id", F.array_join("tags", ",").alias("tags"))


def fixed_chunks(spark, d) -> DataFrame:
    rows = prepare.chunk_fixed(fx.table(spark, d, "documents"))
    return rows.withColumnRenamed("doc_id", "document_id").withColumn("sync_status", F.when(F.col("chunk_index") % 3 == 0, "synced").otherwise("dirty"))


@query
def doc_chunk_stats(spark, d):
    return lifecycle.doc_chunk_stats(fixed_chunks(spark, d))


@query
def cache_hit_rate(spark, d):
    use = fixed_chunks(spark, d).select("document_id", F.when(F.col("chunk_index") > 0, F.col("document_id") % 7 * 100).otherwise(0).alias("hit"), F.col("char_count").alias("miss"))
    return prompts.cache_hit_rate(use).select("document_id", "n_chunks", "hit", "miss", F.round("hit_rate", 0).alias("hit_rate"), "low")


@query
def rewrite_stats(spark, d):
    t = fx.turns(spark, d)
    return transform.rewrite_stats(t, transform.rewrite_pairs(t, rewrite_responses(t)))


@query
def rebuild_document(spark, d):
    return lifecycle.rebuild_document(fixed_chunks(spark, d))


@query
def rank_hits(spark, d):
    return hits(score.rank_hits(vector_hits(spark, d)))


@query
def list_documents(spark, d):
    return fx.docs(spark, d).select("document_id", "title", "created_at").orderBy(F.desc("created_at"))


@query
def hit_counts(spark, d):
    return evaluate.hit_counts(search_results(spark, d, "linear"), fx.vectors(spark, d).where("label < 5").select(F.col("chunk_id").alias("query_id"), "chunk_id"))


# preparation


@query
def strip_markdown(spark, d):
    return prepare.strip_markdown_sections(fx.structured(spark, d)).select("doc_id", "filtered_text", "removed_chars", "cut_point")


@query
def content_filter(spark, d):
    return prepare.content_filter(fx.structured(spark, d)).select("doc_id", "filtered_text", "removed_chars", "cut_point")


@query
def content_filter_md(spark, d):
    """Every fifth document has no headings, so only its tail can be cut."""
    rows = fx.structured(spark, d).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("# "), F.lit(""))).otherwise(F.col("text")))
    return prepare.content_filter(rows, markdown=True).select("doc_id", "filtered_text", "removed_chars", "cut_point")


@query
def citation_density(spark, d):
    rows = prepare.paragraphs(fx.structured(spark, d))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), prepare.citation_density(F.col("para")).alias("density"))


@query
def chunk_recursive(spark, d):
    return prepare.chunk_recursive(fx.table(spark, d, "documents"))


@query
def chunk_fixed(spark, d):
    return prepare.chunk_fixed(fx.table(spark, d, "documents"))


@query
def embed_text(spark, d):
    c = fx.chunks(spark, d)
    return c.select("chunk_id", index.embed_text(c).alias("text"))


@query
def embed_hash(spark, d):
    rows = provider.hashed(fx.texts(spark, d).select("chunk_id", "content"), DIM, "content", pa.float64())
    return rows.select("chunk_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query
def ingest_corpus(spark, d):
    """The whole preparation: strip, chunk, context, embed, tag, write."""
    done = ingest.ingest(fx.structured(spark, d), fx.chunks(spark, d))
    vectors = done.vectors.select("chunk_id", F.md5(F.to_json("embedding")).alias("vector_md5"))
    return done.chunks.join(vectors, "chunk_id").select("chunk_id", "document_id", "chunk_index", "content", "context", "context_embedded", F.array_join("tags", ",").alias("tags"), "vector_md5", "metadata")


@query
def ingest_store(spark, d):
    """A store that three runs went to: some documents, all of them, and all again, which adds nothing. Read after opening it
    anew; equal texts are taken once."""
    docs, path = fx.structured(spark, d), scratch_path(spark, "store")
    options = {"chunker": prepare.chunk_fixed, "dim": DIM, "dedup": True}
    store = ingest.CorpusStore.open(spark, path).ingest(docs.where("doc_id % 2 = 0"), **options)
    store.ingest(docs, **options).ingest(docs, **options)
    store = ingest.CorpusStore.open(spark, path)
    states = store.table("documents").select(F.col("doc_id").alias("document_id"), F.unhex("file_hash").alias("hash"), "sync_status")
    vectors = store.table("vectors").select("chunk_id", F.size("embedding").cast("long").alias("dim"))
    words = store.index().lengths
    chunks = store.table("chunks").select("chunk_id", "document_id", "chunk_index", F.unhex(F.md5("content")).alias("md5"), "context", F.array_join("tags", ",").alias("tags"))
    rows = chunks.join(vectors, "chunk_id").join(words, "chunk_id").join(states, "document_id")
    as_text = lambda c: F.lower(F.hex(c))
    return rows.select("document_id", "chunk_index", as_text("md5").alias("content_md5"), "context", "tags", "dim", "dl", as_text("hash").alias("file_hash"), "sync_status")


# retrieval and scoring


@query
def vector_topk(spark, d):
    return hits(vector_hits(spark, d))


@query
def vector_topk_filtered(spark, d):
    v = index.filter_vectors(fx.vectors(spark, d), tags="tag_2")
    return hits(retrieve.vector_topk(fx.queries(spark, d), v, TOP_K, VECTOR_FROM))


@query
def vector_topk_ann(spark, d):
    return hits(retrieve.vector_topk_ann(fx.queries(spark, d), fx.vectors(spark, d), TOP_K, VECTOR_FROM))


@query
def bm25_topk(spark, d):
    return hits(bm25_hits(spark, d))


@query
def terms_topk(spark, d):
    """The twelve words of each query's document that stand behind the first, in any order."""
    asked = fx.table(spark, d, "documents").where(F.col("doc_id") % fx.EVERY == 0).select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(tx.tokens(F.col("text")), 2, 12), " ").alias("text"))
    return hits(terms.terms_topk(asked, fx.texts(spark, d), TOP_K, stored=fx.index(spark, d)))


@query
def bm25_passing(spark, d):
    """The same without a stored index."""
    return hits(retrieve.phrase_topk(fx.queries(spark, d), fx.texts(spark, d), TOP_K))


@query
def bm25_stored(spark, d):
    """The same from an index that came about in parts: two thirds of the chunks, some deleted, all added, merged, and opened
    anew."""
    c = fx.texts(spark, d)
    path = scratch_path(spark, "index")
    made = phrase_index.StoredIndex.open(spark, path).add(c.where("chunk_id % 3 <> 0"))
    made.delete(c.where("chunk_id % 5 = 1").select("chunk_id")).add(c).merge().vacuum()
    return hits(retrieve.phrase_topk(fx.queries(spark, d), c, TOP_K, stored=phrase_index.StoredIndex.open(spark, path)))


@query
def index_append(spark, d):
    """Postings of an index that a second and a third run went on with; the third had nothing to add."""
    c = fx.texts(spark, d)
    made = phrase_index.StoredIndex.open(spark, scratch_path(spark, "index")).add(c.where("chunk_id % 3 <> 0"))
    made = made.backfill(c)
    return made.add(c).backfill(c).postings


@query
def index_delete(spark, d):
    """Postings and lengths without the failed documents, some of which come again after the deletion."""
    c = fx.texts(spark, d)
    made = phrase_index.StoredIndex.open(spark, scratch_path(spark, "index")).add(c)
    made = made.delete(c.where("sync_status = 'failed'").select("chunk_id")).add(c.where("sync_status = 'failed' and chunk_id % 3 = 0"))
    places = F.aggregate("positions", F.lit(0).cast("long"), lambda s, p: s + p)  # a token has one entry for a chunk
    entries = made.entries.select("chunk_id", F.size("positions").alias("n"), places.alias("places"))
    return entries.groupBy("chunk_id").agg(F.sum("n").alias("n"), F.sum("places").alias("places"), F.count("*").alias("terms")).join(made.lengths, "chunk_id", "right").fillna(0)


@query
def context_bm25_topk(spark, d):
    return hits(retrieve.phrase_topk(fx.queries(spark, d), index.contextual(fx.texts(spark, d)), TOP_K, stored=fx.index(spark, d, True)))


@query
def semantic_dedup(spark, d):
    """Classes of documents whose hashed vectors have a cosine of 0.95 or more with one another's."""
    rows = provider.hashed(fx.texts(spark, d).select("chunk_id", "content"), DIM, "content", pa.float64())
    return semantic.near_copies(rows).withColumnRenamed("id", "chunk_id")


@query
def normalize_scores(spark, d):
    return score.normalize_scores(vector_hits(spark, d))


@query
def rrf_fuse(spark, d):
    return score.rrf_fuse([vector_hits(spark, d), bm25_hits(spark, d)])


@query
def rrf_weighted(spark, d):
    return score.rrf_fuse([vector_hits(spark, d), bm25_hits(spark, d)], [0.7, 0.3])


def all_scores(spark, d, forgotten: bool = False) -> DataFrame:
    c = fx.corpus(spark, d)
    weights = c.chunks.select("chunk_id", "document_id").join(c.documents.select("document_id", "weight"), "document_id").select("chunk_id", "weight")
    rows = score.metadata_score(score.normalize_scores(vector_hits(spark, d)), fx.queries(spark, d), c.chunks.select("chunk_id", "tags"), c.tag_vectors, weights)
    return score.retention_score(rows, c.accesses, fx.as_of(), forgotten=forgotten)


@query
def metadata_score(spark, d):
    return all_scores(spark, d).select("query_id", "chunk_id", F.round("metadata_score", 6).alias("metadata_score"))


@query
def retention_score(spark, d):
    ids = fx.chunks(spark, d).select(F.lit(0).alias("query_id"), "chunk_id")
    return score.retention_score(ids, fx.accesses(spark, d), fx.as_of()).select("chunk_id", F.round("retention_score", 6).alias("retention_score"))


@query
def retention_forgotten(spark, d):
    ids = fx.chunks(spark, d).select(F.lit(0).alias("query_id"), "chunk_id")
    return score.retention_score(ids, fx.accesses(spark, d), fx.as_of(), forgotten=True).select("chunk_id", F.round("retention_score", 6).alias("retention_score"))


@query
def rerank(spark, d):
    return score.rerank(all_scores(spark, d), 0.4)


def search_results(spark, d, name: str) -> DataFrame:
    """query_id, chunk_id and the four scores, cut at TOP_K."""
    indexes = {"linear": [], "hybrid": ["content"], "hybrid_contextual_bm25": ["context"], "full_hybrid": ["content", "context"]}[name]
    return compose.compose(compose.preset(name, **LOW))(fx.queries(spark, d), fx.corpus(spark, d, *indexes), TOP_K, fx.as_of())


@query
def hydrate(spark, d):
    return score.hydrate(search_results(spark, d, "linear"), fx.chunks(spark, d), fx.docs(spark, d))


@query
def search_linear(spark, d):
    return search_results(spark, d, "linear")


@query
def search_hybrid(spark, d):
    return search_results(spark, d, "hybrid")


@query
def search_hybrid_context(spark, d):
    return search_results(spark, d, "hybrid_contextual_bm25")


@query
def search_full_hybrid(spark, d):
    return search_results(spark, d, "full_hybrid")


@query
def search_custom(spark, d):
    """Two sources fused with weights, not reranked."""
    spec = compose.Spec([("v", "vector", LOW["vector"]), ("b", "context_bm25", {}), ("m", "merge", {"weights": [2.0, 1.0], "k": 10})], [("v", "m"), ("b", "m")])
    return compose.compose(spec)(fx.queries(spark, d), fx.corpus(spark, d, "context"), TOP_K, fx.as_of())


@query
def search_response(spark, d):
    full = score.hydrate(search_results(spark, d, "linear"), fx.chunks(spark, d), fx.docs(spark, d))
    out = compose.search_response(full, fx.chunks(spark, d), fx.docs(spark, d))
    return out.select("query_id", "chunk_id", F.length("content").cast("long").alias("n_content"), "document_id", "document_title", "source_path", "final_score", F.col("score_detail.retrieval_score").alias("retrieval_score"), F.array_join("tags", ",").alias("tags"))


# transformation


def variants(spark, d) -> DataFrame:
    t = fx.turns(spark, d)
    return transform.compose_variants([transform.identity(t), transform.fusion(t, t)])


@query
def parse_variants(spark, d):
    t = fx.turns(spark, d)
    return transform.fusion(t, t)


@query
def compose_variants(spark, d):
    return variants(spark, d)


@query
def first_direct_variant(spark, d):
    return transform.first_direct(variants(spark, d))


@query
def rewrite_queries(spark, d):
    t = fx.turns(spark, d).select("query_id", "text")
    return transform.rewrite(t, provider.complete(transform.prompted(t, transform.REWRITE_PROMPT), keep=("query_id",)))


@query
def hyde_queries(spark, d):
    t = fx.turns(spark, d).select("query_id", "text")
    found = transform.hyde(t, provider.complete(transform.prompted(t, transform.HYDE_PROMPT), keep=("query_id",)))
    return provider.embed(found, dim=DIM, text="hypothesis").withColumn("embedding", F.md5(F.to_json("embedding")))


def rewrite_responses(t: DataFrame) -> DataFrame:
    """Given rewrites of three kinds: one good, one that only shouts, one that may be too short or missing."""
    kinds = F.explode(F.array(F.struct(F.lit("paraphrase").alias("k"), F.concat(F.lit(" in other words: "), "text").alias("r")), F.struct(F.lit("keywords").alias("k"), F.lower("text").alias("r")), F.struct(F.lit("colloquial").alias("k"), F.when(F.col("query_id") % 2 == 0, "say").alias("r"))))
    return t.select("query_id", kinds.alias("x")).select("query_id", F.col("x.k").alias("rewrite_type"), F.col("x.r").alias("response"))


@query
def rewrite_pairs(spark, d):
    t = fx.turns(spark, d)
    return transform.rewrite_pairs(t, rewrite_responses(t))


@query
def search_fusion(spark, d):
    """Three variants of each query: itself, with the next document's vector, and with the phrase turned round."""
    q = fx.queries(spark, d).where("embedding is not null")
    other = fx.vectors(spark, d).select((F.col("chunk_id") - 1).alias("query_id"), F.col("embedding").alias("other"))
    turned = F.array_join(F.reverse(F.split("text", " ")), " ")
    v = q.select("query_id", F.lit(0).alias("variant_no"), "text", "embedding").unionByName(q.join(other, "query_id").select("query_id", F.lit(1).alias("variant_no"), "text", F.col("other").alias("embedding")))
    v = v.unionByName(q.select("query_id", F.lit(2).alias("variant_no"), turned.alias("text"), "embedding"))
    return compose.search_variants(q, v, fx.corpus(spark, d, "content"), compose.preset("hybrid", **LOW), TOP_K, fx.as_of())


@query
def search_routes(spark, d):
    """Dispatch by route: one direct variant for every other query; for the rest the query by the fusion route beside a
    hypothesis, the next document's vector, by the hyde route."""
    q = fx.queries(spark, d)
    row = lambda df, no, route, vector: df.select("query_id", F.lit(no).alias("variant_no"), "text", F.col(vector).alias("embedding"), F.lit(route).alias("route"))
    other = fx.vectors(spark, d).select((F.col("chunk_id") - 1).alias("query_id"), F.col("embedding").alias("other"))
    mixed = q.where("query_id % 100 <> 0")
    v = row(q.where("query_id % 100 = 0"), 0, "direct", "embedding").unionByName(row(mixed, 0, "fusion", "embedding")).unionByName(row(mixed.join(other, "query_id"), 1, "hyde", "other"))
    return compose.search_variants(q, v, fx.corpus(spark, d, "content"), compose.preset("hybrid", **LOW), TOP_K, fx.as_of())


# model steps


@query
def tag_prompt(spark, d):
    return prompts.tag_prompt(fx.chunks(spark, d).select("document_id", "content"), lifecycle.unique_tags(fx.chunks(spark, d)))


@query
def parse_tags(spark, d):
    return fx.turns(spark, d).select("query_id", F.array_join(tx.parse_strings(F.col("response")), "|").alias("tags"))


@query
def context_prompt(spark, d):
    return prompts.context_prompt(fx.chunks(spark, d), fx.docs(spark, d).select("document_id", "text")).select("chunk_id", F.md5("prompt").alias("prompt_md5"))


@query
def compress_hits(spark, d):
    """The hits of a search cut to their central sentences."""
    full = score.hydrate(search_results(spark, d, "linear"), fx.chunks(spark, d), fx.docs(spark, d))
    return refine.compress_hits(full.select("query_id", "chunk_id", "content"), budget=60)


@query
def summarize_documents(spark, d):
    """Summaries of all documents by levels of prompts."""
    rows = prepare.chunk_fixed(fx.table(spark, d, "documents")).withColumnRenamed("doc_id", "document_id")
    return refine.summarize(rows)


@query
def complete_ledger(spark, d):
    """Answers of a ledger that two runs asked: the first had every second turn's prompt, and one batch of three."""
    t = transform.prompted(fx.turns(spark, d).select("query_id", "text"), transform.REWRITE_PROMPT)
    path = scratch_path(spark, "ledger")
    some = t.where("query_id % 2 = 0")
    ledger.Ledger(spark, path).complete(some, provider.echo, ("query_id",))
    return ledger.Ledger(spark, path).complete(t, provider.echo, ("query_id",), batch=1 + t.count() // 3).select("query_id", "response", "usage", F.col("tries").cast("long").alias("tries"), F.col("run").cast("long").alias("run"))


@query
def tag_vectors_refresh(spark, d):
    """Vectors of all tags in use, kept from a refresh that knew some of them, and one that is in use no more."""
    path, use = scratch_path(spark, "tags"), lifecycle.tag_use(fx.chunks(spark, d)).select("tag")
    first = use.where("tag in ('tag_1', 'tag_2', 'tag_3')").unionByName(use.limit(1).select(F.lit("not in use").alias("tag")))
    ledger.TagVectors(spark, path).refresh(first, dim=DIM)
    ledger.TagVectors(spark, path).refresh(use, dim=DIM)
    return ledger.TagVectors(spark, path).vectors().select("tag", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"), F.col("made").cast("long").alias("made"))


@query
def rag_prompt(spark, d):
    full = score.hydrate(search_results(spark, d, "linear"), fx.chunks(spark, d), fx.docs(spark, d)).withColumn("final_score", F.round("final_score", 2))
    return prompts.rag_prompt(fx.queries(spark, d), full).select("query_id", F.md5("prompt").alias("prompt_md5"))


@query
def generate_answers(spark, d):
    full = score.hydrate(search_results(spark, d, "linear"), fx.chunks(spark, d), fx.docs(spark, d))
    return prompts.generate_answers(fx.queries(spark, d), full)


@query
def answer_sources(spark, d):
    rows = prompts.answer_sources(search_results(spark, d, "linear").withColumnRenamed("score", "final_score"), fx.chunks(spark, d), fx.docs(spark, d))
    return rows.select("query_id", F.array_join(F.transform("sources", lambda x: F.concat(x["chunk_id"].cast("string"), F.lit(":"), x["file_name"])), ",").alias("sources"))


def titled_chunks(spark, d) -> DataFrame:
    return evaluate.eligible_chunks(fx.chunks(spark, d), fx.docs(spark, d))


@query
def synth_prompt(spark, d):
    return prompts.synth_prompt(titled_chunks(spark, d), with_context=True).select("chunk_id", F.md5("prompt").alias("prompt_md5"))


@query
def parse_synth(spark, d):
    c = fx.chunks(spark, d)
    return prompts.parse_synth(c.select("chunk_id", fx.response(F.col("chunk_id"), fx.SYNTH_RESPONSES).alias("response")))


# evaluation


def grouped_chunks(spark, d) -> DataFrame:
    """Chunks in few documents of uneven size: the square of the id's remainder."""
    key = F.floor(F.sqrt(F.col("chunk_id") % 400)).cast("long")
    return fx.chunks(spark, d).select("chunk_id", key.alias("document_id"))


@query
def sample_quota(spark, d):
    return evaluate.sample_quota(grouped_chunks(spark, d), 50)


@query
def sample_stratified(spark, d):
    return evaluate.sample_stratified(grouped_chunks(spark, d), 50)


@query
def auto_split(spark, d):
    return evaluate.auto_split(fx.docs(spark, d), 0.3)


@query
def split_manifest(spark, d):
    return evaluate.split_manifest(evaluate.auto_split(fx.docs(spark, d), 0.3), 0.3)


def measured(spark, d) -> DataFrame:
    """Metrics of a search whose ground truth is all chunks with the label of the query's own document."""
    found = written(score.rank_hits(search_results(spark, d, "linear")).select("query_id", "chunk_id", "rank"), "found")
    v = fx.vectors(spark, d).select("chunk_id", "label")
    own = fx.queries(spark, d).select("query_id").join(v.withColumnRenamed("chunk_id", "query_id"), "query_id")
    right = found.join(own, "query_id").join(v, ["chunk_id", "label"])
    sizes = own.join(v.groupBy("label").agg(F.count("*").alias("n_truth")), "label").select("query_id", "n_truth")
    return evaluate.eval_metrics(fx.queries(spark, d), found, right, TOP_K, sizes)


@query
def eval_metrics(spark, d):
    return measured(spark, d)


@query
def eval_report(spark, d):
    return evaluate.eval_report(measured(spark, d), TOP_K)


@query
def eval_run(spark, d):
    """Whole benchmark passages as queries of the hybrid search; a document that contains the passage is right."""
    b = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit(None).cast("array<float>").alias("embedding"))
    corpus = fx.corpus(spark, d, "content")
    search = lambda q: compose.compose(compose.preset("hybrid", **LOW))(q, corpus, TOP_K, fx.as_of())
    return evaluate.run(b, search, evaluate.containing(b, fx.chunks(spark, d)), TOP_K)


# lifecycle


@query
def apply_transitions(spark, d):
    status = fx.docs(spark, d).select(F.col("document_id").alias("id"), "sync_status")
    asked = F.element_at(F.array(*map(F.lit, ("synced", "dirty", "failed", "pending", "synced"))), (F.col("id") % 5 + 1).cast("int"))
    return lifecycle.apply_transitions(status, status.select("id", asked.alias("new")))


@query
def health_fast(spark, d):
    return lifecycle.health_fast(fx.chunks(spark, d), fx.broken_vectors(spark, d))


@query
def health_full(spark, d):
    return lifecycle.health_full(fx.chunks(spark, d), fx.broken_vectors(spark, d))


@query
def health_mark(spark, d):
    return lifecycle.health_mark(fx.docs(spark, d), fx.chunks(spark, d), fx.broken_vectors(spark, d))


@query
def delete_cascade(spark, d):
    """What is left in each table without the failed documents."""
    ids = fx.docs(spark, d).where("sync_status = 'failed'").select("document_id")
    left = lifecycle.delete_cascade({"documents": fx.docs(spark, d), "chunks": fx.chunks(spark, d), "vectors": fx.vectors(spark, d), "accesses": fx.accesses(spark, d), "postings": index.postings(fx.chunks(spark, d))}, ids)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n") for n, t in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query
def retag_chunks(spark, d):
    chunks, _ = lifecycle.retag_untagged(fx.docs(spark, d), fx.chunks(spark, d), fx.vectors(spark, d))
    return chunks.select("chunk_id", F.array_join("tags", ",").alias("tags"))


@query
def retag_payload(spark, d):
    """The vectors' tags after retagging."""
    _, vectors = lifecycle.retag_untagged(fx.docs(spark, d), fx.chunks(spark, d), fx.vectors(spark, d))
    return vectors.select("chunk_id", F.array_join("tags", ",").alias("tags"))


def reindexed(spark, d) -> tuple[DataFrame, DataFrame]:
    return lifecycle.reindex(lifecycle.reindex_targets(fx.docs(spark, d)), fx.chunks(spark, d), fx.broken_vectors(spark, d), dim=DIM)


@query
def reindex_report(spark, d):
    return reindexed(spark, d)[1]


@query
def reindex_vectors(spark, d):
    """The vectors' ids and dimensions after the run."""
    return reindexed(spark, d)[0].select("chunk_id", F.size("embedding").cast("long").alias("dim"))


@query
def reindex_errors(spark, d):
    return lifecycle.reindex_errors(reindexed(spark, d)[1])


@query
def reindex_rollup(spark, d):
    return lifecycle.reindex_rollup(reindex_report(spark, d))


@query
def reindex_resume(spark, d):
    """A table of 32 numbers reindexed to 64 by two runs, of which the first stops after some batches: until the second has
    ended, queries see the old one. Failed documents are refused and have no vector then."""
    store = vector_store.VectorStore(spark, scratch_path(spark, "vectors"))
    store.put(fx.vectors(spark, d).select("chunk_id", "document_id", F.slice("embedding", 1, 32).alias("embedding")), 32)
    args = (fx.docs(spark, d), fx.chunks(spark, d), DIM)
    assert not store.reindex(*args, batches=4, most_batches=2).done and store.dim() == 32
    done = store.reindex(*args, batches=4)
    rows = vector_store.marked(fx.chunks(spark, d), store).select("document_id", "chunk_id", "context_embedded")
    sizes = store.vectors().select("chunk_id", F.size("embedding").cast("long").alias("dim"))
    return rows.join(sizes, "chunk_id", "left").join(done.report.select("document_id", "sync_status", "error"), "document_id").select("chunk_id", "dim", "context_embedded", "sync_status", "error")


@query
def contextualize_update(spark, d):
    c = fx.chunks(spark, d)
    todo = c.where("context is null")
    ctx = prompts.contexts(todo, fx.docs(spark, d).select("document_id", "text"))
    chunks, vectors, _ = lifecycle.contextualize_update(c, ctx, fx.vectors(spark, d), dim=DIM)
    return chunks.join(vectors, "chunk_id", "left").select("chunk_id", "context", "context_embedded", F.md5(F.to_json("embedding")).alias("vector_md5"))


@query
def write_violations(spark, d):
    return lifecycle.write_violations(fx.chunks(spark, d).withColumn("context_embedded", F.col("chunk_id") % 3 == 0))


@query
def document_summary(spark, d):
    rows = lifecycle.document_summary(fx.docs(spark, d), fx.chunks(spark, d))
    return rows.withColumn("tags", F.array_join("tags", ","))


@query
def set_chunk_status(spark, d):
    c = fx.chunks(spark, d)
    return lifecycle.set_chunk_status(c, fx.vectors(spark, d).select("chunk_id"), "synced").select("chunk_id", "sync_status")


@query
def stream_access_summary(spark, d):
    """The summary as a stream over the event files leaves it."""
    root = scratch_path(spark, "stream")
    schema = fx.table(spark, d, "events").schema
    log = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").where(F.col("event_type").isin("view", "click")).select(F.get_json_object("props", "$.k").cast("long").alias("chunk_id"), F.col("ts").alias("accessed_at"))
    jobs.access_stream(log, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return jobs.latest(spark, f"{root}/table").select("chunk_id", "last_accessed_at", "access_count")


def queries() -> dict[str, Query]:
    return dict(FOUND)


