"""Retrieval for a whole table of queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions.text import tokens
from rillwork.functions.vectors import norm
from rillwork.operators.index import TextIndex
from rillwork.operators.phrase_index import TOKENS, StoredIndex
from rillwork.operators.score import top_hits
from rillwork.tables import BROADCAST_ROWS, small, spread, written

VECTOR_THRESHOLD = 0.35
#: Rows of a block of queries and of vectors that meet in one multiplication.
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096
#: Numbers of a matrix of queries that is sent to every task, at most (32 MB).
MATRIX = 1 << 22
#: Vectors that the centres of cells are fitted on, at most about.
FIT_VECTORS = 20_000
#: Cosines are compared to so many digits, so that equal vectors tie in any order of summation.
COSINE_DIGITS = 9
#: Different phrases that are found from entries, at most; phrases that are sent to the tasks at a time.
FEW_PHRASES, ASKED = 200, 500_000
# BM25 as the full-text engine's defaults have it.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _unit(values: np.ndarray, rows: int) -> np.ndarray:
    m = values.astype(np.float64).reshape(rows, -1)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


class _Best:
    """The best `keep` of each query at the threshold or above, ties by id, while vectors stream past. A query's worst hit so far
    bounds what is looked at, so few of the later cosines are; a task passes on its last lists only."""

    def __init__(self, n: int, keep: int, threshold: float) -> None:
        self.keep = keep
        self.score, self.id = np.full((n, keep), -np.inf), np.zeros((n, keep), np.int64)
        self.least = np.full(n, threshold)

    def see(self, query: np.ndarray, sim: np.ndarray, vid: np.ndarray) -> None:
        """Cosines of some queries (their rows, each once) with some vectors, not yet rounded."""
        near = np.nextafter(self.least[query] - 10.0**-COSINE_DIGITS, -np.inf)[:, None]
        if sim.shape[1] > self.keep and np.isneginf(self.score[query, -1]).any():  # at first the block's own best bound it
            near = np.maximum(near, np.partition(sim, sim.shape[1] - self.keep, axis=1)[:, [-self.keep]] - 10.0**-COSINE_DIGITS)
        row, col = np.nonzero(sim >= near)
        score = np.round(sim[row, col], COSINE_DIGITS)
        ok = score >= self.least[query[row]]
        row, score, ids = row[ok], score[ok], vid[col[ok]]
        if not len(row):
            return
        own = np.unique(row)
        row = np.concatenate([row, np.repeat(own, self.keep)])
        score = np.concatenate([score, self.score[query[own]].ravel()])
        ids = np.concatenate([ids, self.id[query[own]].ravel()])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < self.keep
        self.score[query[own]], self.id[query[own]] = score[first].reshape(-1, self.keep), ids[first].reshape(-1, self.keep)
        self.least[query[own]] = np.maximum(self.least[query[own]], self.score[query[own], -1])

    def rows(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """Hits, as batches, of the queries with these ids."""
        for at in range(0, len(ids), 4096):
            score = self.score[at : at + 4096]
            row, place = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + at)), pa.array(self.id[row + at, place]), pa.array(score[row, place])], ["query_id", "chunk_id", "score"])


def _whole(embedding: Column) -> Column:
    """Whether a vector has components and all of them are there."""
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull()), F.lit(False))


def vector_topk(queries: DataFrame, vectors: DataFrame, top_k: int, threshold: float = VECTOR_THRESHOLD, over: int = 2) -> DataFrame:
    """Exact cosine search: the best over * top_k of each query at the threshold or above.

    The queries' matrix goes to every task and the vectors stream through without a shuffle; a task passes on the best of
    each query only. Queries of more than MATRIX numbers go in groups, one after the other, and the vectors stream past each
    group. queries: query_id, embedding; vectors: chunk_id, embedding.

    A query meets vectors of its own dimension only; null and empty vectors, and those with a null in them, meet none.
    """
    q = queries.where(_whole(F.col("embedding"))).select("query_id", "embedding")
    v = vectors.where(_whole(F.col("embedding"))).select("chunk_id", "embedding")
    sizes = q.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()  # one row for each dimension
    found = [_of_dimension(q, v, dim, n, over * top_k, threshold) for dim, n in sorted(tuple(r) for r in sizes)]
    if not found:
        return q.select("query_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(0.0).alias("score")).where(F.lit(False))
    return reduce(DataFrame.unionByName, found)


def _of_dimension(q: DataFrame, v: DataFrame, dim: int, n: int, keep: int, threshold: float) -> DataFrame:
    """Hits among vectors of one dimension, which n queries have."""
    q, v = (x.where(F.size("embedding") == dim) for x in (q, v))
    groups = max(1, -(-n // max(QUERY_BLOCK, MATRIX // dim)))
    if groups == 1:
        return _of_group(q, spread(v), keep, threshold)
    q, v = written(q, "query-vectors"), written(v, "searched-vectors")
    found = None
    for g in range(groups):
        hits = written(_of_group(q.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g), spread(v), keep, threshold), "vector-hits")
        found = hits if found is None else found.unionByName(hits)
    return found


def _of_group(q: DataFrame, v: DataFrame, keep: int, threshold: float) -> DataFrame:
    """Hits of so many queries as one matrix holds."""
    table = q.toArrow()
    ids = table.column("query_id").combine_chunks()
    matrix = _unit(table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), len(ids))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(ids), keep, threshold)
        for batch in batches:
            for at in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(at, VECTOR_BLOCK)
                vid = part.column(0).to_numpy()
                b = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False), len(vid))
                for k in range(0, len(ids), QUERY_BLOCK):
                    some = np.arange(k, min(k + QUERY_BLOCK, len(ids)))
                    best.see(some, matrix[some] @ b.T, vid)
        yield from best.rows(ids)

    return top_hits(v.mapInArrow(stream, f"query_id {q.schema['query_id'].dataType.simpleString()}, chunk_id long, score double"), keep, "query_id")


def vector_topk_ann(queries: DataFrame, vectors: DataFrame, top_k: int, threshold: float = VECTOR_THRESHOLD, over: int = 2, cells: int = 64, probes: int = 40, seed: int = 5) -> DataFrame:
    """Approximate search: every vector stands in its nearest of `cells` cells, a query looks into its `probes` nearest
    ones, and what it finds there is scored exactly.

    The cells' centres are fitted by k-means on a sample of FIT_VECTORS at most; all vectors are indexed. What is found and
    the share of pairs that are scored follow from probes / cells; the README has both, measured.
    """
    dim = queries.where(_whole(F.col("embedding"))).select(F.size("embedding").alias("dim")).groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(2).collect()
    if len(dim) != 1:  # none, or several: each by itself
        return vector_topk(queries, vectors, top_k, threshold, over)
    dim = dim[0]["dim"]

    def unit(df: DataFrame) -> DataFrame:
        df = df.where(_whole(F.col("embedding")) & (F.size("embedding") == dim))
        u = F.transform(F.col("embedding").cast("array<double>"), lambda x: x / norm(F.col("embedding")))
        return df.where(F.col("embedding").isNotNull() & (norm(F.col("embedding")) > 0)).withColumn("features", array_to_vector(u))

    v = unit(vectors.select("chunk_id", "embedding"))
    n = v.count()
    if not n:
        return vector_topk(queries, vectors, top_k, threshold, over)
    sample = v if n <= FIT_VECTORS else v.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(FIT_VECTORS / n * (1 << 20)))
    centres = np.array(KMeans(k=min(cells, n), seed=seed, maxIter=10).fit(sample).clusterCenters())

    def near(a: np.ndarray, most: int) -> np.ndarray:
        return np.argsort((centres * centres).sum(axis=1) - 2 * a @ centres.T, axis=1)[:, :most]

    def group(q: DataFrame) -> DataFrame:
        """Hits of so many queries as one matrix holds: the vectors stream past, those of a batch by their cells."""
        table = q.toArrow()
        ids = table.column("query_id").combine_chunks()
        matrix = _unit(table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), len(ids))

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(ids), over * top_k, threshold)
            looks = np.zeros((len(ids), len(centres)), bool)
            np.put_along_axis(looks, near(matrix, probes), True, axis=1)
            asking = [np.flatnonzero(looks[:, c]) for c in range(len(centres))]
            for batch in batches:
                for at in range(0, batch.num_rows, VECTOR_BLOCK):
                    part = batch.slice(at, VECTOR_BLOCK)
                    vid = part.column(0).to_numpy()
                    b = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False), len(vid))
                    cell = near(b, 1)[:, 0]
                    for c in np.unique(cell):
                        own = np.flatnonzero(cell == c)
                        for k in range(0, len(asking[c]), VECTOR_BLOCK):
                            some = asking[c][k : k + VECTOR_BLOCK]
                            best.see(some, matrix[some] @ b[own].T, vid[own])
            yield from best.rows(ids)

        rows = spread(v.select("chunk_id", "embedding"))
        return top_hits(rows.mapInArrow(stream, f"query_id {q.schema['query_id'].dataType.simpleString()}, chunk_id long, score double"), over * top_k, "query_id")

    q = written(unit(queries.select("query_id", "embedding")).select("query_id", "embedding"), "query-vectors")
    groups = max(1, -(-q.count() // max(QUERY_BLOCK, MATRIX // dim)))
    if groups == 1:
        return group(q)
    v = written(v.select("chunk_id", "embedding"), "searched-vectors")
    found = None
    for g in range(groups):
        hits = written(group(q.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)), "vector-hits")
        found = hits if found is None else found.unionByName(hits)
    return found


def _words(queries: DataFrame) -> Column:
    return tokens(F.replace(F.col("text"), F.lit('"'), F.lit(" ")))


def phrase_counts(queries: DataFrame, index: TextIndex | StoredIndex) -> DataFrame:
    """query_id, chunk_id and f, how often the query's tokens stand in the chunk one after the other.

    The entries of the tokens that are asked for are read once and written. Each phrase is found from its rarest token; the
    other tokens must then stand at their offsets from it, which is an intersection of arrays of places. Queries are few
    against entries, so they are broadcast up to a bound.
    """
    need = written(queries.select("query_id", F.posexplode(_words(queries)).alias("off", "token")), "phrases")  # the tokeniser once, inside the generator
    return _counts_by_entries(need, index)


def _counts_by_entries(need: DataFrame, index: TextIndex | StoredIndex) -> DataFrame:
    """The counts of phrases, given by query_id, off and token."""
    few = F.broadcast if need.count() <= BROADCAST_ROWS else lambda df: df
    need = need.join(few(need.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))), "query_id")
    relevant = written(index.holding(need.select("token").distinct()), "asked-entries")
    rarity = relevant.groupBy("token").agg(F.count("*").alias("df"))
    anchor = need.join(few(rarity), "token", "left").groupBy("query_id", "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "off", "token")).alias("a"))
    anchor = few(anchor.select("query_id", "n", F.col("a.off").alias("first"), F.col("a.token").alias("token")))
    shifted = F.transform("positions", lambda p: p - F.col("off"))
    starts = relevant.join(anchor, "token").select("query_id", "n", "chunk_id", "first", F.transform("positions", lambda p: p - F.col("first")).alias("starts"))
    lone = starts.where("n = 1").select("query_id", "chunk_id", F.size("starts").cast("long").alias("f"))
    starts = starts.where("n > 1")
    others = starts.join(few(need.select("query_id", "off", "token")), "query_id").where("off <> first").select("query_id", "n", "chunk_id", "starts", "off", "token")
    met = others.join(relevant, ["chunk_id", "token"]).select("query_id", "n", "chunk_id", F.array_intersect("starts", shifted).alias("starts")).where(F.size("starts") > 0)
    both = met.groupBy("query_id", "n", "chunk_id").agg(F.collect_list("starts").alias("s")).where(F.size("s") == F.col("n") - 1)
    same = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.element_at("s", 1), F.array_intersect)
    return lone.unionByName(both.select("query_id", "chunk_id", F.size(same).cast("long").alias("f")).where("f > 0"))


class _Trie:
    """Phrases as a trie over numbered tokens: level j takes a state and the j-th token to the next state."""

    def __init__(self, words: pa.ListArray) -> None:
        code = words.flatten().dictionary_encode()
        self.vocabulary, code = code.dictionary, code.indices.to_numpy().astype(np.int64)
        length = pc.list_value_length(words).to_numpy()
        start = np.cumsum(length) - length
        state, states, self.levels = np.zeros(len(length), np.int64), 1, []
        for j in range(int(length.max(initial=0))):
            on = np.flatnonzero(length > j)
            keys, inverse = np.unique(state[on] * len(self.vocabulary) + code[start[on] + j], return_inverse=True)
            state[on] = states + inverse
            self.levels.append((keys, states))
            states += len(keys)
        self.phrase = np.full(states, -1)
        self.phrase[state] = np.arange(len(length))

    def found(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, phrases and how often a row has the phrase."""
        length = pc.list_value_length(words).to_numpy()
        row = np.repeat(np.arange(len(length)), length)
        end = np.cumsum(length)
        token = pc.fill_null(pc.index_in(words.flatten(), value_set=self.vocabulary), -1).to_numpy().astype(np.int64)
        at, state, out = np.arange(len(token)), np.zeros(len(token), np.int64), []
        for j, (keys, first) in enumerate(self.levels):
            on = at + j < end[row[at]]
            at, state = at[on], state[on]
            now = token[at + j]
            at, state, now = (x[now >= 0] for x in (at, state, now))
            key = state * len(self.vocabulary) + now
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            on = keys[place] == key
            at, state = at[on], first + place[on]
            ended = self.phrase[state] >= 0
            out.append(row[at[ended]] * len(self.phrase) + self.phrase[state[ended]])
        pairs, f = np.unique(np.concatenate([np.zeros(0, np.int64), *out]), return_counts=True)
        return pairs // len(self.phrase), pairs % len(self.phrase), f


def _counts_by_chunks(phrases: DataFrame, index: TextIndex | StoredIndex) -> DataFrame:
    """no, chunk_id, f and dl: the phrases (no, words) go to every task as a trie, and the chunks' words stream through."""
    table = phrases.toArrow()
    no, trie = table.column("no").combine_chunks(), _Trie(table.column("words").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = pc.list_value_length(batch.column(1)).to_numpy()
            upto, at = np.cumsum(many), 0
            while at < batch.num_rows:  # so many chunks as have TOKENS tokens, or one
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOKENS, "right")))
                row, phrase, f = trie.found(batch.column(1).slice(at, end - at))
                row = row + at
                at = end
                yield pa.RecordBatch.from_arrays([no.take(pa.array(phrase)), batch.column(0).take(pa.array(row)), pa.array(f.astype(np.int64)), pa.array(many[row].astype(np.int64))], ["no", "chunk_id", "f", "dl"])

    return index.by_chunk().mapInArrow(run, "no long, chunk_id long, f long, dl long")


def _phrase_hits(phrases: DataFrame, n: int, chunks: DataFrame, document_id: int | None, keep: int, stored: TextIndex | StoredIndex) -> DataFrame:
    """no, chunk_id and score: the best of each of n phrases (no, words)."""
    n_all, total = stored.totals()
    if n <= FEW_PHRASES:
        need = written(phrases.select(F.col("no").alias("query_id"), F.posexplode("words").alias("off", "token")), "asked-words")
        counts = stored.lengths.join(small(_counts_by_entries(need, stored).withColumnRenamed("query_id", "no"), "phrase-counts"), "chunk_id")
    else:
        counts = _counts_by_chunks(phrases, stored)
    counts = written(counts.select("no", "chunk_id", "f", "dl"), "phrase-lengths")
    holders = small(counts.groupBy("no").agg(F.count("*").alias("n")), "holders")
    idf = F.log((n_all - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    if document_id is not None:
        counts = counts.join(small(chunks.where(F.col("document_id") == document_id).select("chunk_id"), "one-document"), "chunk_id", "left_semi")
    f, dl = F.col("f"), F.col("dl")
    hits = counts.join(holders, "no").select("no", "chunk_id", (idf * (f * (K1 + 1) / (f + K1 * (1 - B + B * dl / (total / max(n_all, 1)))))).alias("score"))
    return top_hits(hits, keep, "no")


def phrase_topk(queries: DataFrame, chunks: DataFrame, top_k: int, document_id: int | None = None, over: int = 4, text: str = "content", stored: TextIndex | StoredIndex | None = None) -> DataFrame:
    """Phrase BM25: the whole query is one phrase. Statistics are of all chunks; the filter comes after them.

    queries: query_id, text; blank queries find nothing. The best over * top_k of each query. A stored index is only
    read; without one, chunks are tokenised once into a table of words.

    Queries with equal tokens are one phrase, which is searched once. A few phrases are found from the entries of their
    rarest tokens; more are looked up where the chunks' words stream past, ASKED phrases at a time.
    """
    stored = TextIndex.passing(chunks, text) if stored is None else stored
    need = written(queries.select("query_id", _words(queries).alias("words")), "asked").where(F.size("words") > 0)
    phrases = written(need.select("words").distinct().withColumn("no", F.monotonically_increasing_id()), "phrases")
    n = phrases.count()
    groups = max(1, -(-n // ASKED))
    hits = None
    for g in range(groups):
        own = phrases if groups == 1 else phrases.where(F.pmod(F.xxhash64("words"), F.lit(groups)) == g)
        found = small(_phrase_hits(own, n, chunks, document_id, over * top_k, stored), "phrase-hits")
        found = found.join(phrases, "no").join(need, "words").select("query_id", "chunk_id", "score")
        hits = found if hits is None else hits.unionByName(found)
    return hits
