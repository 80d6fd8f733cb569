"""Search pipelines from small specs. compose() checks a spec and gives a function from queries and a corpus to hits.

Building a search already runs jobs: what several branches read (hits, entries of the asked tokens, the chunks that
were found) is written to the shared folder, and sizes are looked at before something is broadcast.

A node is (id, kind, config); kinds are vector, bm25, context_bm25, merge and rerank. A bm25 node takes the query as one
phrase or, with the mode terms, as its terms. A normaliser stands after
every node that feeds another, and after the last one unless it reranks. Merging ranks raw scores, so a normaliser
before it changes nothing and is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.operators.index import TextIndex, contextual
from rillwork.operators.phrase_index import StoredIndex
from rillwork.operators.retrieve import VECTOR_THRESHOLD, phrase_topk, vector_topk
from rillwork.operators.score import ALPHA, BETA, FINAL_THRESHOLD, GAMMA, RRF_K, hydrate, metadata_score, normalize_scores, of_documents, of_hits, rank_hits, rerank, retention_score, rrf_fuse, top_hits
from rillwork.operators.terms import terms_topk
from rillwork.sources.files import append_accesses
from rillwork.tables import written


@dataclass
class Corpus:
    """The tables that a search reads. documents: document_id, title, weight; chunks: chunk_id, document_id, content,
    context, tags; vectors: chunk_id, document_id, tags, embedding; tag_vectors: tag, vector; accesses: chunk_id,
    accessed_at. index and context_index, if given, are stored text indexes of the chunks and of those with context."""

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    tag_vectors: DataFrame
    accesses: DataFrame
    index: TextIndex | StoredIndex | None = None
    context_index: TextIndex | StoredIndex | None = None


@dataclass
class Spec:
    """Nodes and edges of a pipeline."""

    nodes: list[tuple[str, str, dict[str, Any]]]
    edges: list[tuple[str, str]] = field(default_factory=list)


SOURCES = ("vector", "bm25", "context_bm25")


def preset(name: str, **config: dict[str, Any]) -> Spec:
    """linear, hybrid, hybrid_contextual_bm25 or full_hybrid; config by kind of node."""
    kinds = {"linear": ["vector"], "hybrid": ["vector", "bm25"], "hybrid_contextual_bm25": ["vector", "context_bm25"], "full_hybrid": ["vector", "bm25", "context_bm25"]}[name]
    nodes = [(k, k, config.get(k, {})) for k in kinds] + [("rerank", "rerank", config.get("rerank", {}))]
    if len(kinds) == 1:
        return Spec(nodes, [(kinds[0], "rerank")])
    return Spec([*nodes, ("merge", "merge", config.get("merge", {}))], [*((k, "merge") for k in kinds), ("merge", "rerank")])


def ordered(spec: Spec) -> list[str]:
    """Ids in an order in which every node comes after its inputs; raises on a spec that makes no sense."""
    kinds = {i: k for i, k, _ in spec.nodes}
    if len(kinds) != len(spec.nodes):
        raise ValueError("two nodes have one id")
    inputs: dict[str, list[str]] = {i: [] for i in kinds}
    for a, b in spec.edges:
        if a not in kinds or b not in kinds:
            raise ValueError(f"edge {a} -> {b} names no node")
        inputs[b].append(a)
    for i, k in kinds.items():
        n = len(inputs[i])
        if k in SOURCES and n or k == "merge" and n < 2 or k == "rerank" and n != 1:
            raise ValueError(f"{i} ({k}) has {n} inputs")
        if k not in (*SOURCES, "merge", "rerank"):
            raise ValueError(f"{k} is no kind of node")
    if len(set(kinds) - {a for a, _ in spec.edges}) != 1:
        raise ValueError("a pipeline has one last node")
    done: list[str] = []
    while len(done) < len(kinds):
        ready = [i for i in kinds if i not in done and all(x in done for x in inputs[i])]
        if not ready:
            raise ValueError("the edges form a circle")
        done += ready
    return done


def compose(spec: Spec) -> Callable[..., DataFrame]:
    """search(queries, corpus, top_k, as_of, forgotten=False, rerank_queries=None, cut=True) → hits with sub-scores.

    queries: query_id, text, embedding. rerank_queries, if given, are those that reranking looks at. Without cut, the last
    node's whole lists.
    """
    order = ordered(spec)
    kinds = {i: (k, c) for i, k, c in spec.nodes}
    feeds = {a for a, _ in spec.edges}

    def search(queries: DataFrame, corpus: Corpus, top_k: int, as_of: Column, forgotten: bool = False, rerank_queries: DataFrame | None = None, cut: bool = True) -> DataFrame:
        out: dict[str, DataFrame] = {}
        for i in order:
            kind, config = kinds[i]
            given = [out[a] for a, b in spec.edges if b == i]
            if kind == "vector":
                hits = vector_topk(queries, corpus.vectors, top_k, config.get("threshold", VECTOR_THRESHOLD))
            elif kind == "bm25":
                find = terms_topk if config.get("mode") == "terms" else phrase_topk
                hits = find(queries, corpus.chunks, top_k, stored=corpus.index)
            elif kind == "context_bm25":
                hits = phrase_topk(queries, contextual(corpus.chunks), top_k, stored=corpus.context_index)
            elif kind == "merge":
                hits = rrf_fuse(given, config.get("weights"), config.get("k", RRF_K))
            else:
                seen = queries if rerank_queries is None else rerank_queries
                hits = rerank_hits(given[0], seen, corpus, as_of, forgotten, config)
            merged_next = any(kinds[b][0] == "merge" for a, b in spec.edges if a == i)
            if (i in feeds and not merged_next and kind != "rerank") or (i not in feeds and kind not in ("rerank", "merge")):
                hits = normalize_scores(hits)
            out[i] = hits
        return top_hits(out[order[-1]], top_k, "query_id") if cut else out[order[-1]]

    return search


def rerank_hits(hits: DataFrame, queries: DataFrame, corpus: Corpus, as_of: Column, forgotten: bool = False, config: dict[str, Any] | None = None) -> DataFrame:
    """The three signals and their weighted sum."""
    config = config or {}
    hits = written(hits.select("query_id", "chunk_id", "score"), "hits")  # few, and several branches read them
    found = of_hits(hits, corpus.chunks, "document_id", "tags")
    weights = found.join(of_documents(found, corpus.documents, "weight"), "document_id").select("chunk_id", "weight")
    hits = metadata_score(hits, queries, found.select("chunk_id", "tags"), corpus.tag_vectors, weights)
    hits = retention_score(hits, corpus.accesses, as_of, forgotten=forgotten)
    return rerank(hits, config.get("threshold", FINAL_THRESHOLD), config.get("alpha", ALPHA), config.get("beta", BETA), config.get("gamma", GAMMA))


def search(queries: DataFrame, corpus: Corpus, spec: Spec, top_k: int = 10, as_of: Column | None = None, forgotten: bool = False, record_to: str | None = None) -> DataFrame:
    """End to end: retrieve, score, cut at top_k, and only then fetch content and titles.

    record_to, if given, is the access log to which an access to each hit, at as_of, is appended. The hits are written
    before, so an access that this search records doesn't count in it.
    """
    if not 1 <= top_k <= 50:
        raise ValueError("top_k is from 1 to 50")
    as_of = F.current_timestamp() if as_of is None else as_of
    hits = compose(spec)(queries, corpus, top_k, as_of, forgotten)
    if record_to is not None:
        hits = written(hits, "found")
        append_accesses(hits.select("chunk_id", as_of.alias("accessed_at")), record_to)
    return hydrate(hits, corpus.chunks, corpus.documents)


def search_variants(queries: DataFrame, variants: DataFrame, corpus: Corpus, spec: Spec, top_k: int, as_of: Column, forgotten: bool = False) -> DataFrame:
    """Search by variants, dispatched by their route. Variants are rows, so their number isn't fixed.

    All variants retrieve in one pass, a hyde variant by the vector of its hypothesis. The list of a query's only variant
    stays as the pipeline gives it, whatever its route. Else each variant's list is cut, those of a route fuse by reciprocal
    rank, and those of several routes fuse once more. Reranking looks at the original query in any case. spec: its
    sources and their merge; a last reranker's config is used. variants: query_id, variant_no, text, embedding and route
    (fusion, if there is no such column).
    """
    if "route" not in variants.columns:
        variants = variants.withColumn("route", F.lit("fusion"))
    config = next((c for _, k, c in spec.nodes if k == "rerank"), {})
    sources = [(i, k, c) for i, k, c in spec.nodes if k in SOURCES]
    inner = Spec([*sources, ("merge", "merge", next((c for _, k, c in spec.nodes if k == "merge"), {}))], [(i, "merge") for i, _, _ in sources]) if len(sources) > 1 else Spec(sources)
    vid = F.concat_ws(":", F.col("query_id").cast("string"), F.col("variant_no").cast("string"))
    keyed = written(variants.select("query_id", "variant_no", "text", "embedding", "route", vid.alias("vid")), "variants")
    n = keyed.groupBy("query_id").agg(F.count("*").alias("n"))
    names = keyed.select("vid", "query_id", "route").join(n, "query_id")
    lists = compose(inner)(keyed.select(F.col("vid").alias("query_id"), "text", "embedding"), corpus, top_k, as_of, cut=False)
    ranked = written(rank_hits(lists.withColumnRenamed("query_id", "vid").join(names, "vid"), "vid"), "lists")
    alone = ranked.where("n = 1").select("query_id", "chunk_id", "score")
    several = ranked.where((F.col("n") > 1) & (F.col("rank") <= top_k))
    by_route = several.groupBy("query_id", "route", "chunk_id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))
    routes = Window.partitionBy("query_id")
    by_route = rank_hits(by_route, "query_id", "route").withColumn("routes", F.size(F.collect_set("route").over(routes)))
    fused = by_route.groupBy("query_id", "chunk_id").agg(F.sum(F.when(F.col("routes") == 1, F.col("score")).otherwise(1.0 / (RRF_K + F.col("rank")))).alias("score"))
    return top_hits(rerank_hits(alone.unionByName(normalize_scores(fused)), queries, corpus, as_of, forgotten, config), top_k, "query_id")


def search_response(results: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """What a caller gets: content, document, title, final score, the sub-scores, tags."""
    results = written(results, "results")
    found = of_hits(results, chunks, "document_id", "tags")
    where = found.join(of_documents(found, docs, "title", "source_path"), "document_id")
    detail = F.struct("retrieval_score", "metadata_score", "retention_score").alias("score_detail")
    return results.drop("document_title").join(where, "chunk_id").select("query_id", "chunk_id", "content", "document_id", F.coalesce("title", F.lit("")).alias("document_title"), "source_path", "final_score", detail, "tags")
