"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from rillwork.fixtures import AS_OF, RESPONSES, SYNTH_RESPONSES, TOKENS, _list, quoted, with_ctes
from rillwork.operators.prepare import APPENDIX_HEADINGS, CITATION_FEATURES, REFERENCE_HEADINGS
from rillwork.operators.prompts import CONTEXT_ASK, CONTEXT_ROLE, SYNTH_ASK, SYNTH_BACKGROUND, SYNTH_COUNT, SYNTH_TITLE, TAG_ASK, TAG_KNOWN, TAG_TEXT
from rillwork.operators.transform import REWRITE_PROMPT

TOP = 10
WORDS = {
    "tok": "SELECT chunk_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT chunk_id, " + TOKENS.format("content") + " AS t FROM corpus)",
    "lens": "SELECT chunk_id, len(" + TOKENS.format("coalesce(content, '')") + ") AS dl FROM corpus",
    "stat": "SELECT count(*) AS n_all, avg(dl) AS avgdl FROM lens",
    "phrases": "SELECT query_id, t[1] AS a, t[2] AS b, len(t) AS m FROM (SELECT query_id, " + TOKENS.format("text") + " AS t FROM asked) WHERE len(t) > 0",
    "found": "SELECT p.query_id, x.chunk_id, count(*) AS f FROM phrases p JOIN tok x ON x.token = p.a LEFT JOIN tok y ON y.chunk_id = x.chunk_id AND y.pos = x.pos + 1 AND y.token = p.b WHERE p.m = 1 OR y.token IS NOT NULL GROUP BY ALL",
    "holders": "SELECT query_id, count(*) AS n FROM found GROUP BY query_id",
    "bm25": "SELECT query_id, chunk_id, (CASE WHEN ln((n_all - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_all - n + 0.5) / (n + 0.5)) END) * (f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM found JOIN holders USING (query_id) JOIN lens USING (chunk_id), stat",
}


def phrase(name: str, corpus: str = "chunks", asked: str = "queries", keep: str = "true") -> dict[str, str]:
    """Tables that end in `name`, the phrase hits of each query."""
    import re

    out = {}
    tables = {"corpus": f"SELECT * FROM {corpus}" if " " not in corpus else corpus, "asked": asked if " " in asked else f"SELECT query_id, text FROM {asked}"} | WORDS
    for k, sql in tables.items():
        out[f"{name}_{k}"] = re.sub(r"\b(corpus|asked|tok|lens|stat|phrases|found|holders|bm25)\b(?!\.)", lambda m: f"{name}_{m[1]}", sql) if k not in ("corpus", "asked") else sql
    out[name] = f"SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM {name}_bm25 WHERE {keep}) WHERE r <= {4 * TOP}"
    return out


CONTEXTUAL = "SELECT chunk_id, concat_ws(chr(10) || chr(10), context, content) AS content FROM chunks WHERE context IS NOT NULL"
COS = "CASE WHEN list_dot_product({0}, {0}) * list_dot_product({1}, {1}) = 0 THEN 0.0 ELSE list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))) END"


def vector(name: str, asked: str = "queries", keep: str = "true") -> dict[str, str]:
    """The table `name`, vector hits of each query."""
    sims = f"SELECT q.query_id, v.chunk_id, round({COS.format('q.embedding', 'v.embedding')}, 9) AS score FROM {asked} q, vecs v WHERE q.embedding IS NOT NULL AND {keep}"
    return {f"{name}_sim": sims, name: f"SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM {name}_sim WHERE score >= 0.1) WHERE r <= {2 * TOP}"}


def normal(name: str, of: str) -> dict[str, str]:
    w = "OVER (PARTITION BY query_id)"
    return {name: f"SELECT query_id, chunk_id, CASE WHEN max(score) {w} = min(score) {w} THEN 1.0::DOUBLE ELSE round((score - min(score) {w}) / (max(score) {w} - min(score) {w}), 6) END AS score FROM {of}"}


def fused(name: str, lists: list[str], weights: list[float] | None = None, k: int = 60) -> dict[str, str]:
    weights = weights or [1.0] * len(lists)
    union = " UNION ALL ".join(f"SELECT query_id, chunk_id, {w}::DOUBLE AS w, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM {x}" for x, w in zip(lists, weights, strict=True))
    return {f"{name}_u": union, f"{name}_s": f"SELECT query_id, chunk_id, sum(w / ({k} + r)) AS score FROM {name}_u GROUP BY ALL"} | normal(name, f"{name}_s")


KEPT = f"coalesce(exp(-(date_diff('microsecond', last_accessed_at, TIMESTAMP '{AS_OF}') / 3.6e9) / (24.0 * (1 + ln(1 + access_count)))), 0.0)"


def reranked(name: str, of: str, threshold: float = 0.0) -> dict[str, str]:
    """The tables `name`_parts, with all signals, and `name`, the reranked hits."""
    sim = f"SELECT h.query_id, h.chunk_id, max(({COS.format('q.embedding', 't.vector')} + 1) / 2) AS sim FROM {of} h JOIN queries q ON q.query_id = h.query_id AND q.embedding IS NOT NULL JOIN (SELECT chunk_id, unnest(tags) AS tag FROM chunks) c ON c.chunk_id = h.chunk_id JOIN tag_vecs t ON t.tag = c.tag GROUP BY ALL"
    parts = f"SELECT h.query_id, h.chunk_id, h.score, coalesce(sim, 0.5) * weight AS metadata_score, {KEPT} AS retention_score FROM {of} h LEFT JOIN {name}_sims s ON s.query_id = h.query_id AND s.chunk_id = h.chunk_id JOIN docs d ON d.document_id = h.chunk_id LEFT JOIN summary a ON a.chunk_id = h.chunk_id"
    out = f"SELECT * FROM (SELECT query_id, chunk_id, round(0.6 * score + 0.2 * metadata_score + 0.2 * retention_score, 6) AS score, round(score, 6) AS retrieval_score, round(metadata_score, 6) AS metadata_score, round(retention_score, 6) AS retention_score FROM {name}_parts) WHERE score >= {threshold}"
    return {f"{name}_sims": sim, f"{name}_parts": parts, name: out}


def best(of: str) -> str:
    return f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM {of}) WHERE r <= {TOP}"


BASE = "docs vecs chunks tag_vecs accesses summary queries"
LINEAR = vector("v") | normal("nv", "v") | reranked("rr", "nv") | {"linear": best("rr")}


def presets(lists: list[str]) -> str:
    parts = vector("v") | (phrase("b") if "b" in lists else {}) | (phrase("cb", CONTEXTUAL) if "cb" in lists else {}) | fused("fu", lists) | reranked("rr", "fu")
    return with_ctes(best("rr"), BASE, parts)


W = r"[\p{L}\p{N}_]"


def matches(column: str, patterns: list[str], flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{flags}{p}')" for p in patterns) + ")"


def headed(column: str) -> str:
    """A reference or appendix heading."""
    return f"((length({column}) <= 30 AND {matches(column, REFERENCE_HEADINGS, '(?i)')}) OR (length({column}) <= 50 AND {matches(column, APPENDIX_HEADINGS, '(?i)')}))"


DENSITY = "(" + " + ".join(f"CASE WHEN regexp_matches(para, '{p}') THEN 1.0 ELSE 0.0 END" for p in CITATION_FEATURES) + ") / 8.0::DOUBLE"
TRIMMED = r"regexp_replace({0}, '\s+$', '')"


def paras(of: str) -> dict[str, str]:
    split = f"SELECT doc_id, text, length(text) AS total, unnest(string_split(text, chr(10) || chr(10))) AS para, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS i FROM {of}"
    off = "SELECT *, coalesce(sum(length(para) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM para_rows"
    return {"para_rows": split, "paras": off}


def tails(of: str) -> dict[str, str]:
    """The table `tails`: doc_id and cut_point."""
    title = r"regexp_replace(regexp_replace(para, '^\s+|\s+$', '', 'g'), '^#+\s*', '')"
    flagged = f"SELECT *, CASE WHEN {DENSITY} >= 0.25 THEN 1 ELSE 0 END AS dense, off / total >= 0.40 AS late, trim(para) <> '' AND {headed(title)} AS named FROM paras"
    seen = "SELECT *, coalesce(sum(dense) OVER n, 0) AS near, count(dense) OVER n AS n_near, sum(CASE WHEN late AND dense = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM flagged WINDOW n AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
    runs = "SELECT doc_id, min(off) AS off FROM (SELECT doc_id, run, min(off) AS off FROM seen WHERE late AND dense = 1 GROUP BY ALL HAVING count(*) >= 5) GROUP BY doc_id"
    heads = "SELECT doc_id, min(off) AS off FROM seen WHERE late AND named AND (n_near = 0 OR near >= 2) GROUP BY doc_id"
    return paras(of) | {"flagged": flagged, "seen": seen, "runs": runs, "heads": heads, "tails": "SELECT doc_id, coalesce(h.off, r.off)::BIGINT AS cut_point FROM heads h FULL JOIN runs r USING (doc_id)"}


def sections(of: str) -> dict[str, str]:
    """The table `stripped`: filtered_text, removed_chars, cut_point; null cut points where nothing was found."""
    lines = f"SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos, len(string_split(text, chr(10))) AS n FROM {of}"
    full = "SELECT *, CASE WHEN pos < n THEN line || chr(10) ELSE line END AS whole, length(regexp_extract(line, '^(#+)\\s', 1)) AS named, regexp_matches(line, '^#+$') AND pos < n AS bare FROM line_rows"
    level = "SELECT *, CASE WHEN named > 0 THEN named WHEN bare THEN length(line) ELSE 0 END AS level, CASE WHEN named > 0 THEN trim(regexp_extract(line, '^#+\\s+(.*)', 1)) ELSE '' END AS title, coalesce(sum(length(whole)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM line_full"
    ranges = f"SELECT a.doc_id, a.pos AS a, coalesce(min(b.pos), any_value(a.n) + 1) AS b FROM line_level a LEFT JOIN line_level b ON b.doc_id = a.doc_id AND b.pos > a.pos AND b.level > 0 AND b.level <= a.level WHERE a.level > 0 AND {headed('a.title')} GROUP BY a.doc_id, a.pos"
    marked = "SELECT l.*, EXISTS (SELECT 1 FROM line_ranges r WHERE r.doc_id = l.doc_id AND l.pos >= r.a AND l.pos < r.b) AS gone FROM line_level l"
    out = f"SELECT doc_id, {TRIMMED.format('coalesce(string_agg(whole, ' + repr('') + ' ORDER BY pos) FILTER (NOT gone), ' + repr('') + ')')} AS filtered_text, coalesce(sum(length(whole)) FILTER (gone), 0)::BIGINT AS removed_chars, (min(off) FILTER (gone))::BIGINT AS cut_point FROM line_marked GROUP BY doc_id"
    return {"line_rows": lines, "line_full": full, "line_level": level, "line_ranges": ranges, "line_marked": marked, "stripped_raw": out, "stripped": f"SELECT doc_id, CASE WHEN cut_point IS NULL THEN t.text ELSE filtered_text END AS filtered_text, removed_chars, cut_point FROM stripped_raw JOIN {of} t USING (doc_id)"}


FIXED = {
    "sizes": "SELECT doc_id, text AS t, length(text) AS n, length(text) <= 256 OR length(text) // 10 < 20 AS whole FROM fixed_docs WHERE regexp_replace(text, '\\s', '', 'g') <> ''",
    "sized": "SELECT *, CASE WHEN whole THEN n ELSE least(n // 10, 1024) END AS size FROM sizes",
    "laps": "SELECT *, CASE WHEN whole OR greatest(50, least(floor(size * 0.1::DOUBLE)::BIGINT, 200)) >= size THEN 0 ELSE greatest(50, least(floor(size * 0.1::DOUBLE)::BIGINT, 200)) END AS lap FROM sized",
    "counts": "SELECT *, size - lap AS step, greatest(ceil((n - size)::DOUBLE / (size - lap))::BIGINT + 1, 1) AS cnt FROM laps",
    "cuts": "SELECT *, cnt > 1 AND n - (cnt - 1) * step < 50 AS merged FROM counts",
    "fixed": "SELECT doc_id, i AS chunk_index, CASE WHEN merged AND i = cnt - 2 THEN substring(t, i * step + 1, size) || substring(t, (i + 1) * step + 1, size) ELSE substring(t, i * step + 1, size) END AS content, size AS chunk_size FROM (SELECT *, unnest(range(0, cnt - merged::BIGINT)) AS i FROM cuts)",
}
FIXED_DOCS = {"fixed_docs": "SELECT doc_id, text FROM documents"} | FIXED
FIXED_CHUNKS = FIXED_DOCS | {"fc": "SELECT doc_id AS document_id, chunk_index, content, length(content) AS char_count, CASE WHEN chunk_index % 3 = 0 THEN 'synced' ELSE 'dirty' END AS sync_status FROM fixed"}

UNFENCED = r"CASE WHEN starts_with(r, '```') THEN trim(list_aggregate(list_filter(string_split(r, chr(10)), lambda x: NOT starts_with(x, '```')), 'string_agg', chr(10)), ' ' || chr(10) || chr(9)) ELSE r END"
PARSED = {
    "raws": "SELECT query_id, text, trim(response, ' ' || chr(10) || chr(9)) AS r FROM turns",
    "plain": f"SELECT query_id, text, {UNFENCED} AS r FROM raws",
    "arrays": "SELECT query_id, text, CASE WHEN json_valid(r) AND json_type(TRY_CAST(r AS JSON)) = 'ARRAY' AND len(list_filter(json_extract(TRY_CAST(CASE WHEN json_valid(r) THEN r END AS JSON), '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 THEN list_filter(list_transform(json_extract_string(r, '$[*]'), lambda x: trim(x)), lambda x: x <> '') ELSE []::VARCHAR[] END AS v FROM plain",
    "fused": "SELECT query_id, unnest(v) AS text, generate_subscripts(v, 1) - 1 AS variant_no, 'fusion' AS route FROM arrays WHERE len(v) > 0 UNION ALL SELECT query_id, text, 0, 'direct' FROM arrays WHERE len(v) = 0",
    "variants": "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, variant_no) - 1 AS variant_no, text, route FROM (SELECT query_id, 0 AS part, 0 AS variant_no, text, 'direct' AS route FROM turns UNION ALL SELECT query_id, 1, variant_no, text, route FROM fused)",
}
PAIRS = {
    "asked3": "SELECT query_id, text, unnest([{'k': 'paraphrase', 'r': ' in other words: ' || text}, {'k': 'keywords', 'r': lower(text)}, {'k': 'colloquial', 'r': CASE WHEN query_id % 2 = 0 THEN 'say' END}]) AS x FROM turns",
    "pairs": r"SELECT query_id, text AS original_query, s AS rewritten_query, x.k AS rewrite_type FROM (SELECT *, regexp_replace(x.r, '^\s+|\s+$', '', 'g') AS s FROM asked3) WHERE s IS NOT NULL AND length(s) >= 5 AND lower(s) <> lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))",
}
CODES = "list_transform(" + TOKENS.format("content") + ", lambda t: ('0x' || substr(md5(t), 1, 6))::BIGINT)"
HASHED = {
    "codes": f"SELECT chunk_id, {CODES} AS c FROM chunks",
    "sums": "SELECT chunk_id, list_transform(range(0, 64), lambda i: coalesce(list_sum(list_transform(list_filter(c, lambda x: x % 64 = i), lambda x: CASE WHEN (x // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)), 0.0::DOUBLE)) AS s FROM codes",
}
QRELS = {"qrels": "SELECT q.query_id, b.chunk_id FROM queries q JOIN vecs a ON a.chunk_id = q.query_id JOIN vecs b ON b.label = a.label"}


def metrics(queries: str, ranked: str, qrels: str) -> dict[str, str]:
    return {
        "truth": f"SELECT query_id, count(*) AS n_truth FROM {qrels} GROUP BY query_id",
        "scored": f"SELECT h.query_id, min(r) AS first, sum(CASE WHEN r <= {TOP} THEN 1 / log2(r + 1) END) AS dcg, count(CASE WHEN r <= {TOP} THEN 1 END) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM {ranked}) h JOIN {qrels} t ON t.query_id = h.query_id AND t.chunk_id = h.chunk_id GROUP BY h.query_id",
        "metrics": f"SELECT q.query_id, round(coalesce(1.0::DOUBLE / first, 0.0), 6) AS reciprocal_rank, round(coalesce(dcg / list_sum(list_transform(range(1, least(n_truth, {TOP}) + 1), lambda i: 1 / log2(i + 1))), 0.0), 6) AS ndcg_at_k, round(coalesce(n::DOUBLE / n_truth, 0.0), 6) AS found_at_k FROM {queries} q LEFT JOIN truth USING (query_id) LEFT JOIN scored USING (query_id)",
    }


QUOTA = {
    "gc": "SELECT chunk_id, floor(sqrt(chunk_id % 400))::BIGINT AS document_id FROM chunks",
    "per": "SELECT document_id, count(*) AS n_chunks FROM gc GROUP BY ALL",
    "q0": "SELECT *, CASE WHEN (SELECT sum(n_chunks) FROM per) <= 50 THEN n_chunks ELSE greatest(1, round_even(50 * n_chunks / (SELECT sum(n_chunks) FROM per), 0))::BIGINT END AS q FROM per",
    "units": "SELECT document_id, unnest(range(1, q + 1)) AS level FROM q0",
    "ordered": "SELECT *, row_number() OVER (ORDER BY level DESC, document_id) AS no FROM units",
    "quota": "SELECT p.document_id, any_value(n_chunks) AS n_chunks, count(o.level) AS quota FROM per p LEFT JOIN ordered o ON o.document_id = p.document_id AND no > (SELECT count(*) - least(50, (SELECT sum(n_chunks) FROM per)) FROM units) GROUP BY p.document_id",
}
SPLIT = {"split": "SELECT document_id, row_number() OVER (ORDER BY md5(document_id || ':0')) <= greatest(1, round_even((SELECT count(*) FROM docs) * 0.3::DOUBLE, 0)) AS included FROM docs"}
HEALTH = {
    "fast": "SELECT coalesce(c.document_id, v.document_id) AS document_id, coalesce(c.n, 0) AS n_chunks, coalesce(v.n, 0) AS n_vectors FROM (SELECT document_id, count(*) AS n FROM chunks GROUP BY ALL) c FULL JOIN (SELECT document_id, count(*) AS n FROM broken GROUP BY ALL) v ON c.document_id = v.document_id",
    "full_check": "SELECT coalesce(c.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN b.chunk_id IS NULL THEN 'missing' ELSE 'orphaned' END AS problem FROM chunks c FULL JOIN broken b ON c.chunk_id = b.chunk_id WHERE c.chunk_id IS NULL OR b.chunk_id IS NULL",
}
REINDEX = {"report": "SELECT d.document_id, count(*) AS total, count(*) FILTER (d.sync_status <> 'failed') AS succeeded, d.sync_status AS was FROM docs d JOIN chunks c ON c.document_id = d.document_id WHERE d.sync_status IN ('dirty', 'failed') GROUP BY d.document_id, d.sync_status"}
SOURCES = "string_agg(l.chunk_id || ':' || regexp_extract(d.source_path, '[^/]+$'), ',' ORDER BY -l.score, l.chunk_id)"


def oracle_sql() -> dict[str, str]:
    w = with_ctes
    up = "SELECT chunk_id, label + 100 AS label FROM vecs WHERE chunk_id % 5 = 0"
    tags = "list_aggregate({0}, 'string_agg', ',')"
    hydrated = "SELECT l.query_id, l.chunk_id, c.content, d.title AS document_title, l.score AS final_score, l.retrieval_score, l.metadata_score, l.retention_score FROM linear l JOIN chunks c ON c.chunk_id = l.chunk_id JOIN docs d ON d.document_id = c.document_id"
    tag_parts = f"{quoted(TAG_TEXT)} || substring(content, 1, 8000) || CASE WHEN n > 0 THEN {quoted(TAG_KNOWN)} || known ELSE '' END || {quoted(TAG_ASK)}"
    known = "(SELECT to_json(list(tag ORDER BY tag))::VARCHAR AS known, count(*) AS n FROM (SELECT DISTINCT unnest(tags) AS tag FROM chunks))"
    tagged = {
        "said": f"SELECT document_id, unnest(regexp_extract_all(lower({tag_parts}), '\\p{{L}}{{6,}}')) AS w FROM chunks, {known} WHERE len(tags) = 0",
        "often": "SELECT document_id, w, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, w) AS r FROM said GROUP BY document_id, w",
        "newly": "SELECT document_id, string_agg(w, ',' ORDER BY r) AS tags FROM often WHERE r <= 3 GROUP BY document_id",
    }
    synth = f"SELECT chunk_id, trim({_list(SYNTH_RESPONSES)}[chunk_id % 6 + 1], ' ' || chr(10)) AS r FROM chunks"
    return {
        "file_hash": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
        "ingest_rejects": w("SELECT d.doc_id, CASE WHEN n IS NULL THEN 'no chunks' ELSE 'vector count' END AS error FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM fixed GROUP BY ALL) f ON f.doc_id = d.doc_id WHERE n IS NULL OR d.doc_id % 89 = 0", "", {"fixed_docs": "SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN '  ' ELSE text END AS text FROM documents"} | FIXED),
        "record_access": w(f"SELECT * FROM accesses UNION ALL SELECT query_id, TIMESTAMP '{AS_OF}' FROM queries", "accesses queries"),
        "vector_upsert": w(f"SELECT chunk_id, label FROM vecs WHERE chunk_id % 5 <> 0 UNION ALL {up} UNION ALL SELECT chunk_id + 1000000000, label FROM ({up})", "vecs"),
        "vector_delete": w("SELECT chunk_id, label FROM vecs WHERE chunk_id NOT IN (SELECT document_id FROM docs WHERE sync_status = 'failed')", "docs vecs"),
        "vector_fetch": w("SELECT chunk_id, tags FROM vecs WHERE chunk_id IN (SELECT document_id FROM docs WHERE sync_status = 'dirty')", "docs vecs"),
        "payload_update": w("SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN ['new'] ELSE tags END AS tags FROM vecs", "vecs"),
        "point_counts": w("SELECT document_id, count(*) AS n FROM vecs GROUP BY ALL", "vecs"),
        "dim_violations": w("SELECT chunk_id, len(e)::BIGINT AS dim FROM (SELECT chunk_id, CASE WHEN chunk_id % 10 = 0 THEN embedding[1:63] ELSE embedding END AS e FROM vecs) WHERE len(e) <> 64", "vecs"),
        "postings_build": w("SELECT chunk_id, token, pos FROM p_tok", "chunks", {"p_corpus": "SELECT * FROM chunks", "p_tok": WORDS["tok"].replace("FROM corpus", "FROM p_corpus")}),
        "context_postings": w("SELECT chunk_id, token, pos FROM p_tok", "chunks", {"p_corpus": CONTEXTUAL, "p_tok": WORDS["tok"].replace("FROM corpus", "FROM p_corpus")}),
        "block_title": w(r"SELECT document_id, CASE WHEN document_id % 3 <> 0 AND regexp_replace(substring(text, 1, 20), '^\s+|\s+$', '', 'g') <> '' THEN regexp_replace(substring(text, 1, 20), '^\s+|\s+$', '', 'g') ELSE title END AS title FROM docs", "docs"),
        "filter_doc_tags": w("SELECT chunk_id, tags FROM vecs WHERE list_has_any(tags, ['tag_1', 'tag_3'])", "vecs"),
        "bm25_doc_filter": w("SELECT query_id, chunk_id, round(score, 6) AS score FROM b", "chunks queries", phrase("b", keep="chunk_id = 100")),
        "select_reindex_targets": w("SELECT document_id, sync_status FROM docs WHERE sync_status IN ('dirty', 'failed')", "docs"),
        "lookup_chunks": w("SELECT chunk_id, content FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM accesses)", "chunks accesses"),
        "chunks_without_context": w("SELECT chunk_id FROM chunks WHERE context IS NULL", "chunks"),
        "dedup_file_hash": "SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id FROM documents GROUP BY ALL",
        "preview": w("SELECT chunk_id, replace(substring(content, 1, 120), chr(10), ' ') || CASE WHEN length(content) > 120 THEN '...' ELSE '' END AS preview FROM chunks", "chunks"),
        "access_summary": w("SELECT * FROM summary", "summary"),
        "stream_access_summary": w("SELECT * FROM summary", "summary"),
        "untagged_docs": w("SELECT document_id FROM chunks GROUP BY document_id HAVING sum(CASE WHEN len(tags) > 0 THEN 1 ELSE 0 END) = 0", "chunks"),
        "unique_tags": w("SELECT DISTINCT unnest(tags) AS tag FROM chunks", "chunks"),
        "doc_tags": w(f"SELECT document_id, coalesce({tags.format('list_sort(list_distinct(tags))')}, '') AS tags FROM chunks", "chunks"),
        "doc_chunk_stats": w("SELECT document_id, count(*) AS chunk_count, count(*) FILTER (sync_status = 'synced') AS synced_count FROM fc GROUP BY ALL", "", FIXED_CHUNKS),
        "cache_hit_rate": w("SELECT document_id, n_chunks, hit::BIGINT AS hit, miss::BIGINT AS miss, CASE WHEN hit + miss > 0 THEN round(round(hit::DOUBLE / (hit + miss) * 100, 1), 0) END AS hit_rate, n_chunks >= 3 AND hit::DOUBLE / (hit + miss) * 100 < 50 AS low FROM (SELECT document_id, count(*) AS n_chunks, sum(CASE WHEN chunk_index > 0 THEN document_id % 7 * 100 ELSE 0 END) AS hit, sum(char_count) AS miss FROM fc GROUP BY ALL)", "", FIXED_CHUNKS),
        "rewrite_stats": w("SELECT t.query_id, count(p.query_id) AS n_pairs, count(p.query_id) = 0 AS failed FROM turns t LEFT JOIN pairs p ON p.query_id = t.query_id GROUP BY t.query_id", "turns", PAIRS),
        "rebuild_document": w("SELECT document_id, string_agg(content, chr(10) ORDER BY chunk_index) AS text FROM fc GROUP BY ALL", "", FIXED_CHUNKS),
        "rank_hits": w("SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM v", "vecs queries", vector("v")),
        "list_documents": w("SELECT document_id, title, created_at FROM docs", "docs"),
        "hit_counts": w("SELECT query_id, count(*) AS n_hits FROM linear WHERE query_id = chunk_id AND chunk_id IN (SELECT chunk_id FROM vecs WHERE label < 5) GROUP BY ALL", BASE, LINEAR),
        "strip_markdown": w("SELECT * FROM stripped", "structured", sections("structured")),
        "content_filter": w(f"SELECT s.doc_id, CASE WHEN cut_point IS NULL THEN text ELSE {TRIMMED.format('substring(text, 1, cut_point)')} END AS filtered_text, CASE WHEN cut_point IS NULL THEN 0 ELSE length(text) - cut_point END AS removed_chars, cut_point FROM structured s LEFT JOIN tails USING (doc_id)", "structured", tails("structured")),
        "content_filter_md": w(f"SELECT s.doc_id, CASE WHEN s.cut_point IS NULL AND t.cut_point IS NOT NULL THEN {TRIMMED.format('substring(text, 1, t.cut_point)')} ELSE filtered_text END AS filtered_text, CASE WHEN s.cut_point IS NULL AND t.cut_point IS NOT NULL THEN length(text) - t.cut_point ELSE removed_chars END AS removed_chars, coalesce(s.cut_point, t.cut_point) AS cut_point FROM stripped s JOIN mixed USING (doc_id) LEFT JOIN tails t USING (doc_id)", "structured", {"mixed": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, '# ', '') ELSE text END AS text FROM structured"} | sections("mixed") | tails("mixed")),
        "citation_density": w(f"SELECT doc_id, i, {DENSITY} AS density FROM paras", "structured", paras("structured")),
        "chunk_fixed": w("SELECT doc_id, chunk_index, content, length(content) AS char_count, chunk_size FROM fixed", "", FIXED_DOCS),
        "ingest_store": w(
            f"SELECT f.doc_id AS document_id, f.chunk_index, md5(f.content) AS content_md5, '{CONTEXT_ASK} #' || substring(md5('{CONTEXT_ROLE}' || chr(10) || '<document>' || chr(10) || t.text || chr(10) || '</document>' || chr(10) || '<chunk>' || chr(10) || f.content || chr(10) || '</chunk>' || chr(10) || '{CONTEXT_ASK}'), 1, 8) AS context, coalesce(g.tags, '') AS tags, 64::BIGINT AS dim, len({TOKENS.format('f.content')}) AS dl, sha256(o.text) AS file_hash, 'synced' AS sync_status FROM fixed f JOIN fixed_docs t USING (doc_id) JOIN firsts o USING (doc_id) LEFT JOIN newly g USING (doc_id)",
            "structured",
            {"evens": "SELECT min(doc_id) AS doc_id, text FROM structured WHERE doc_id % 2 = 0 GROUP BY text", "firsts": "SELECT * FROM evens UNION ALL SELECT min(doc_id) AS doc_id, text FROM structured WHERE text NOT IN (SELECT text FROM evens) GROUP BY text"}
            | sections("firsts") | tails("firsts") | {"fixed_docs": f"SELECT s.doc_id, CASE WHEN s.cut_point IS NULL AND t.cut_point IS NOT NULL THEN {TRIMMED.format('substring(f.text, 1, t.cut_point)')} ELSE filtered_text END AS text FROM stripped s JOIN firsts f USING (doc_id) LEFT JOIN tails t USING (doc_id)"} | FIXED
            | {"said": f"SELECT doc_id, unnest(regexp_extract_all(lower({quoted(TAG_TEXT)} || substring(text, 1, 8000) || {quoted(TAG_ASK)}), '\\p{{L}}{{6,}}')) AS w FROM fixed_docs", "often": "SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, w) AS r FROM said GROUP BY doc_id, w", "newly": "SELECT doc_id, string_agg(w, ',' ORDER BY r) AS tags FROM often WHERE r <= 3 GROUP BY doc_id"},
        ),
        "embed_text": w("SELECT chunk_id, CASE WHEN context <> '' THEN context || chr(10) || chr(10) || content ELSE content END AS text FROM chunks", "chunks"),
        "embed_hash": w("SELECT chunk_id, CASE WHEN list_sum(list_transform(s, lambda x: x * x)) = 0 THEN s ELSE list_transform(s, lambda x: round(x / sqrt(list_sum(list_transform(s, lambda y: y * y))), 6)) END AS embedding FROM sums", "chunks", HASHED),
        "semantic_dedup": "WITH RECURSIVE " + w(
            "SELECT c.chunk_id, coalesce(m.class_id, c.chunk_id) AS class_id FROM chunks c LEFT JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) m ON m.a = c.chunk_id",
            "chunks", HASHED | {"lens": "SELECT chunk_id, s, sqrt(list_dot_product(s, s)) AS n FROM sums", "near": "SELECT x.chunk_id AS a, y.chunk_id AS b FROM lens x JOIN lens y ON x.n > 0 AND y.n > 0 AND x.chunk_id <> y.chunk_id AND round(list_dot_product(x.s, y.s) / (x.n * y.n), 9) >= 0.95", "reach": "SELECT a, a AS b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b"},
        ).removeprefix("WITH "),
        "vector_topk": w("SELECT query_id, chunk_id, round(score, 6) AS score FROM v", "vecs queries", vector("v")),
        "vector_topk_filtered": w("SELECT query_id, chunk_id, round(score, 6) AS score FROM v", "vecs queries", vector("v", keep="list_contains(v.tags, 'tag_2')")),
        "bm25_topk": w("SELECT query_id, chunk_id, round(score, 6) AS score FROM b", "chunks queries", phrase("b")),
        "terms_topk": w(
            f"SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM summed) WHERE r <= {4 * TOP}", "chunks",
            {"asked": f"SELECT DISTINCT doc_id AS query_id, unnest(({TOKENS.format('text')})[2:13]) AS token FROM documents WHERE doc_id % 50 = 0", "corpus": "SELECT * FROM chunks", "tok": WORDS["tok"], "lens": WORDS["lens"], "stat": WORDS["stat"],
             "tf": "SELECT token, chunk_id, count(*) AS f FROM tok WHERE token IN (SELECT token FROM asked) GROUP BY ALL", "idf": "SELECT token, CASE WHEN ln((n_all - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_all - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM tf, stat GROUP BY token, n_all",
             "summed": "SELECT query_id, chunk_id, round(sum(idf * (f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)))), 12) AS score FROM asked JOIN tf USING (token) JOIN idf USING (token) JOIN lens USING (chunk_id), stat GROUP BY ALL"},
        ),
        "bm25_passing": w("SELECT query_id, chunk_id, round(score, 6) AS score FROM b", "chunks queries", phrase("b")),
        "index_append": w("SELECT chunk_id, token, pos FROM p_tok", "chunks", {"p_corpus": "SELECT * FROM chunks", "p_tok": WORDS["tok"].replace("FROM corpus", "FROM p_corpus")}),
        "index_delete": w("SELECT c.chunk_id, coalesce(t.n, 0) AS n, coalesce(t.places, 0)::BIGINT AS places, coalesce(t.terms, 0) AS terms, coalesce(t.n, 0) AS dl FROM chunks c LEFT JOIN (SELECT chunk_id, count(*) AS n, sum(pos) AS places, count(DISTINCT token) AS terms FROM p_tok GROUP BY chunk_id) t ON t.chunk_id = c.chunk_id WHERE sync_status <> 'failed' OR c.chunk_id % 3 = 0", "chunks", {"p_corpus": "SELECT * FROM chunks", "p_tok": WORDS["tok"].replace("FROM corpus", "FROM p_corpus")}),
        "bm25_stored": w("SELECT query_id, chunk_id, round(score, 6) AS score FROM b", "chunks queries", phrase("b")),
        "context_bm25_topk": w("SELECT query_id, chunk_id, round(score, 6) AS score FROM b", "chunks queries", phrase("b", CONTEXTUAL)),
        "normalize_scores": w("SELECT * FROM nv", "vecs queries", vector("v") | normal("nv", "v")),
        "rrf_fuse": w("SELECT * FROM fu", "chunks queries", vector("v") | phrase("b") | fused("fu", ["v", "b"])),
        "rrf_weighted": w("SELECT * FROM fu", "chunks queries", vector("v") | phrase("b") | fused("fu", ["v", "b"], [0.7, 0.3])),
        "metadata_score": w("SELECT query_id, chunk_id, round(metadata_score, 6) AS metadata_score FROM rr_parts", BASE, LINEAR),
        "retention_score": w(f"SELECT c.chunk_id, round({KEPT}, 6) AS retention_score FROM chunks c LEFT JOIN summary s ON s.chunk_id = c.chunk_id", "chunks summary"),
        "retention_forgotten": w(f"SELECT c.chunk_id, round(1 - {KEPT}, 6) AS retention_score FROM chunks c LEFT JOIN summary s ON s.chunk_id = c.chunk_id", "chunks summary"),
        "rerank": w("SELECT * FROM rr", BASE, vector("v") | normal("nv", "v") | reranked("rr", "nv", 0.4)),
        "hydrate": w(hydrated, BASE, LINEAR),
        "search_linear": w("SELECT * FROM linear", BASE, LINEAR),
        "search_hybrid": presets(["v", "b"]),
        "search_hybrid_context": presets(["v", "cb"]),
        "search_full_hybrid": presets(["v", "b", "cb"]),
        "search_custom": w(best("fu"), BASE, vector("v") | phrase("cb", CONTEXTUAL) | fused("fu", ["v", "cb"], [2.0, 1.0], 10)),
        "search_response": w(f"SELECT h.query_id, h.chunk_id, length(c.content) AS n_content, d.document_id, d.title AS document_title, d.source_path, h.score AS final_score, h.retrieval_score, coalesce({tags.format('c.tags')}, '') AS tags FROM linear h JOIN chunks c ON c.chunk_id = h.chunk_id JOIN docs d ON d.document_id = c.document_id", BASE, LINEAR),
        "parse_variants": w("SELECT query_id, variant_no, text, route FROM fused", "turns", PARSED),
        "compose_variants": w("SELECT * FROM variants", "turns", PARSED),
        "first_direct_variant": w("SELECT query_id, arg_min(text, variant_no) AS text FROM variants WHERE route = 'direct' GROUP BY ALL", "turns", PARSED),
        "rewrite_pairs": w("SELECT * FROM pairs", "turns", PAIRS),
        "search_fusion": w(
            best("rr"), BASE,
            {"qv": "SELECT * FROM queries WHERE embedding IS NOT NULL", "var": "SELECT query_id * 1000 AS query_id, text, embedding FROM qv UNION ALL SELECT q.query_id * 1000 + 1, text, v.embedding FROM qv q JOIN vecs v ON v.chunk_id = q.query_id + 1 UNION ALL SELECT query_id * 1000 + 2, array_to_string(list_reverse(string_split(text, ' ')), ' '), embedding FROM qv"}
            | vector("v", "var") | phrase("b", asked="var") | fused("inner_fu", ["v", "b"]) | {"cut": best("inner_fu"), "outer_s": "SELECT query_id // 1000 AS query_id, chunk_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM cut) GROUP BY ALL"}
            | normal("fu", "outer_s") | reranked("rr", "fu"),
        ),
        "search_routes": w(
            best("rr"), BASE,
            {"qr": "SELECT query_id, text, embedding FROM queries", "var": "SELECT query_id * 1000 AS query_id, text, embedding FROM qr UNION ALL SELECT q.query_id * 1000 + 1, text, v.embedding FROM qr q JOIN vecs v ON v.chunk_id = q.query_id + 1 WHERE q.query_id % 100 <> 0", "many": "SELECT query_id // 1000 AS query_id, count(*) AS n FROM var GROUP BY ALL"}
            | vector("v", "var") | phrase("b", asked="var") | fused("inner_fu", ["v", "b"])
            | {"places": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM inner_fu", "outer_s": f"SELECT p.query_id // 1000 AS query_id, chunk_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM places p JOIN many m ON m.query_id = p.query_id // 1000 WHERE n > 1 AND r <= {TOP} GROUP BY ALL"}
            | normal("outer_n", "outer_s") | {"fu": "SELECT * FROM outer_n UNION ALL SELECT p.query_id // 1000, chunk_id, score FROM places p JOIN many m ON m.query_id = p.query_id // 1000 WHERE n = 1"} | reranked("rr", "fu"),
        ),
        "complete_ledger": w(
            "SELECT query_id, response, length(prompt) + length(response) AS usage, 1::BIGINT AS tries, CASE WHEN bool_or(query_id % 2 = 0) OVER (PARTITION BY text) THEN 1 ELSE 2 END::BIGINT AS run FROM (SELECT *, regexp_extract(trim(prompt, ' ' || chr(10) || chr(9)), '[^\\n]*$') || ' #' || substring(md5(prompt), 1, 8) AS response FROM rewrite_prompts)",
            "turns", {"rewrite_prompts": f"SELECT query_id, text, {quoted(REWRITE_PROMPT)} || chr(10) || chr(10) || text AS prompt FROM turns"},
        ),
        "tag_vectors_refresh": w(
            "SELECT tag, CASE WHEN list_sum(list_transform(s, lambda x: x * x)) = 0 THEN s ELSE list_transform(s, lambda x: round((x / sqrt(list_sum(list_transform(s, lambda y: y * y))))::FLOAT::DOUBLE, 5)) END AS vector, CASE WHEN tag IN ('tag_1', 'tag_2', 'tag_3') THEN 1 ELSE 2 END::BIGINT AS made FROM tag_sums",
            "chunks", {"tag_use": "SELECT DISTINCT unnest(tags) AS tag FROM chunks", "tag_codes": f"SELECT tag, {CODES.replace('content', 'tag')} AS c FROM tag_use", "tag_sums": HASHED["sums"].replace("chunk_id", "tag").replace("FROM codes", "FROM tag_codes")},
        ),
        "reindex_resume": w("SELECT chunk_id, CASE WHEN d.sync_status <> 'failed' THEN 64 END::BIGINT AS dim, d.sync_status <> 'failed' AND context IS NOT NULL AS context_embedded, CASE WHEN d.sync_status = 'failed' THEN 'failed' ELSE 'synced' END AS sync_status, CASE WHEN d.sync_status = 'failed' THEN 'rejected: failed -> dirty' END AS error FROM chunks c JOIN docs d ON d.document_id = c.document_id", "chunks docs"),
        "tag_prompt": w(f"SELECT document_id, {tag_parts} AS prompt FROM chunks, {known}", "chunks"),
        "parse_tags": w(f"SELECT query_id, coalesce({tags.format('v').replace(chr(39) + ',' + chr(39), chr(39) + '|' + chr(39))}, '') AS tags FROM arrays", "turns", PARSED),
        "context_prompt": w(f"SELECT chunk_id, md5('{CONTEXT_ROLE}' || chr(10) || '<document>' || chr(10) || text || chr(10) || '</document>' || chr(10) || '<chunk>' || chr(10) || content || chr(10) || '</chunk>' || chr(10) || '{CONTEXT_ASK}') AS prompt_md5 FROM chunks c JOIN docs d ON d.document_id = c.document_id", "chunks docs"),
        "rag_prompt": w("SELECT q.query_id, md5(CASE WHEN p.t IS NULL THEN q.text ELSE 'Context:' || chr(10) || p.t || chr(10) || chr(10) || 'Question: ' || q.text END) AS prompt_md5 FROM queries q LEFT JOIN (SELECT query_id, string_agg('[' || document_title || '] (score: ' || printf('%.2f', round(final_score, 2)) || ')' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY -round(final_score, 2), chunk_id) AS t FROM full_hits GROUP BY ALL) p ON p.query_id = q.query_id", BASE, LINEAR | {"full_hits": hydrated}),
        "answer_sources": w(f"SELECT query_id, {SOURCES} AS sources FROM linear l JOIN docs d ON d.document_id = l.chunk_id GROUP BY query_id", BASE, LINEAR),
        "synth_prompt": w(f"SELECT chunk_id, md5({quoted(SYNTH_TITLE)} || title || chr(10) || CASE WHEN context <> '' THEN {quoted(SYNTH_BACKGROUND)} || context || chr(10) ELSE '' END || {quoted(SYNTH_COUNT.format(n=2))} || content || chr(10) || chr(10) || {quoted(SYNTH_ASK)}) AS prompt_md5 FROM chunks c JOIN docs d ON d.document_id = c.document_id WHERE length(content) >= 100", "chunks docs"),
        "parse_synth": w("SELECT chunk_id, coalesce(trim(json_extract_string(item, '$.query')), '') AS query, coalesce(json_extract_string(item, '$.query_type'), 'factual') AS query_type FROM (SELECT chunk_id, unnest(json_extract(r, '$[*]')) AS item FROM cleaned WHERE json_valid(r)) WHERE trim(json_extract_string(item, '$.query')) <> '' UNION ALL SELECT chunk_id, substring(r, 1, 500), 'factual' FROM cleaned WHERE NOT json_valid(r) AND r <> ''", "chunks", {"given": synth, "cleaned": f"SELECT chunk_id, {UNFENCED} AS r FROM given"}),
        "sample_quota": w("SELECT * FROM quota", "chunks", QUOTA),
        "sample_stratified": w("SELECT chunk_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY md5(chunk_id || ':0'), chunk_id) AS no FROM gc) JOIN quota USING (document_id) WHERE no <= quota", "chunks", QUOTA),
        "auto_split": w("SELECT * FROM split", "docs", SPLIT),
        "split_manifest": w("SELECT 0.3::DOUBLE AS split_ratio, document_id, CASE WHEN included THEN 'included' ELSE 'excluded' END AS side FROM split", "docs", SPLIT),
        "eval_metrics": w("SELECT * FROM metrics", BASE, LINEAR | QRELS | metrics("queries", "linear", "qrels")),
        "eval_report": w(f"SELECT count(*) AS num_queries, {TOP}::BIGINT AS top_k, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg_at_k), 6) AS mean_ndcg_at_k, round(avg(found_at_k), 6) AS mean_found_at_k FROM metrics", BASE, LINEAR | QRELS | metrics("queries", "linear", "qrels")),
        "apply_transitions": w("SELECT id, old, new, o AS outcome, CASE WHEN o = 'applied' THEN new ELSE old END AS sync_status FROM (SELECT *, CASE WHEN old = new THEN 'noop' WHEN (old, new) IN (('pending', 'synced'), ('pending', 'failed'), ('synced', 'dirty'), ('dirty', 'synced'), ('dirty', 'failed'), ('failed', 'pending')) THEN 'applied' ELSE 'rejected' END AS o FROM (SELECT document_id AS id, sync_status AS old, ['synced', 'dirty', 'failed', 'pending', 'synced'][document_id % 5 + 1] AS new FROM docs))", "docs"),
        "health_fast": w("SELECT *, n_chunks = n_vectors AS ok FROM fast", "chunks broken", HEALTH),
        "health_full": w("SELECT * FROM full_check", "chunks broken", HEALTH),
        "health_mark": w("SELECT d.document_id, sync_status AS old_status, CASE WHEN b.document_id IS NULL THEN sync_status WHEN sync_status = 'synced' THEN 'dirty' WHEN sync_status = 'pending' THEN 'failed' ELSE sync_status END AS new_status FROM docs d LEFT JOIN (SELECT document_id FROM fast WHERE n_chunks <> n_vectors UNION SELECT document_id FROM full_check f JOIN chunks c ON c.chunk_id = f.chunk_id WHERE problem = 'missing') b ON b.document_id = d.document_id", "chunks broken", HEALTH),
        "delete_cascade": w("SELECT 'documents' AS tbl, count(*) AS n FROM docs WHERE document_id % 4 <> 3 UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id % 4 <> 3 UNION ALL SELECT 'vectors', count(*) FROM vecs WHERE document_id % 4 <> 3 UNION ALL SELECT 'accesses', count(*) FROM accesses WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE document_id % 4 = 3) UNION ALL SELECT 'postings', count(*) FROM p_tok WHERE chunk_id % 4 <> 3", "chunks accesses", {"p_corpus": "SELECT * FROM chunks", "p_tok": WORDS["tok"].replace("FROM corpus", "FROM p_corpus")}),
        "retag_chunks": w(f"SELECT chunk_id, CASE WHEN len(c.tags) = 0 THEN coalesce(n.tags, '') ELSE {tags.format('c.tags')} END AS tags FROM chunks c LEFT JOIN newly n ON n.document_id = c.document_id", "chunks", tagged),
        "retag_payload": w(f"SELECT chunk_id, CASE WHEN len(v.tags) = 0 THEN coalesce(n.tags, '') ELSE {tags.format('v.tags')} END AS tags FROM vecs v LEFT JOIN newly n ON n.document_id = v.document_id", "chunks", tagged),
        "reindex_vectors": w("SELECT chunk_id, 64::BIGINT AS dim FROM broken UNION SELECT chunk_id, 64 FROM chunks c JOIN docs d ON d.document_id = c.document_id WHERE d.sync_status = 'dirty'", "docs chunks broken"),
        "reindex_errors": w("SELECT document_id, 'rejected: failed -> dirty' AS error FROM docs WHERE sync_status = 'failed'", "docs"),
        "reindex_report": w("SELECT document_id, total, succeeded, total - succeeded AS failed, CASE WHEN was = 'failed' THEN 'failed' WHEN total = succeeded THEN 'synced' ELSE 'failed' END AS sync_status, CASE WHEN was = 'failed' THEN 'rejected: failed -> dirty' END AS error FROM report", "docs chunks broken", REINDEX),
        "reindex_rollup": w("SELECT count(*) FILTER (total = succeeded) AS succeeded, count(*) FILTER (total > succeeded) AS failed, count(*) FILTER (was = 'failed') AS errors FROM report", "docs chunks broken", REINDEX),
        "write_violations": w("SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 AND context IS NULL THEN 'no_context' ELSE 'bad_status' END AS violation FROM chunks WHERE (chunk_id % 3 = 0 AND context IS NULL) OR sync_status NOT IN ('pending', 'dirty')", "chunks"),
        "document_summary": w(f"SELECT d.document_id, d.document_id || '.txt' AS file_name, 'txt' AS file_type, count(c.chunk_id) AS chunk_count, count(*) FILTER (c.sync_status = 'synced') AS synced_count, coalesce({tags.format('list_sort(any_value(c.tags))')}, '') AS tags, any_value(weight) AS weight, any_value(d.sync_status) AS sync_status FROM docs d LEFT JOIN chunks c ON c.document_id = d.document_id GROUP BY d.document_id", "docs chunks"),
        "set_chunk_status": w("SELECT chunk_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM vecs) THEN 'synced' ELSE sync_status END AS sync_status FROM chunks", "chunks"),
    }


#: The given responses, kept here so that a change of either side is seen.
assert len(RESPONSES) == len(SYNTH_RESPONSES) == 6
