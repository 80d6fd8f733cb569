"""Ranked terms search: BM25 over a query's distinct terms, with early termination.

Chunks are dealt to parts by a hash; a task has the entries of the asked terms for the chunks of a part. Fewer parts read less of
the entries, as each has k best chunks of its own. A term's entries
stand in order of impact, in blocks of which the first entry is the maximum, and in order of chunks. A query takes its terms
by their highest possible contribution. Once k chunks have partial scores, a block is read only if its maximum and all that
later terms can add may still reach the k-th best; what isn't read can't be among the best. Chunks that are candidates
already are looked up in the rest of a term's entries, and leave when they can't reach it any more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.functions.text import tokens
from rillwork.operators.index import TextIndex
from rillwork.operators.phrase_index import StoredIndex
from rillwork.operators.score import top_hits
from rillwork.tables import small, written

# BM25 as in the phrase search.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Entries of a block; entries of a part, at most and, where all cores have one, at least, about; pairs of query and term that
#: are sent to the tasks at a time.
BLOCK, PART, LEAST_PART, ASKED = 128, 4_000_000, 250_000, 200_000
#: Scores are summed in another order here and there; bounds are wider by so much.
SLACK = 1e-9


class Entries:
    """The entries of one term in a part. Chunks are numbered from 0 there."""

    def __init__(self, chunk: np.ndarray, impact: np.ndarray) -> None:
        order = np.lexsort((chunk, -impact))
        self.chunk, self.impact = chunk[order], impact[order]
        self.at = np.argsort(self.chunk).astype(np.int32)
        self.sorted = self.chunk[self.at]
        self.maxima = self.impact[::BLOCK]

    def blocks(self, least: float) -> int:
        """Entries of the blocks whose maximum is at least so high."""
        return min(BLOCK * int(np.searchsorted(-self.maxima, -least, "right")), len(self.chunk))

    def of(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Impacts of chunks, 0 where the term isn't, and which are there."""
        where = np.minimum(np.searchsorted(self.sorted, chunks), len(self.sorted) - 1)
        there = self.sorted[where] == chunks
        return np.where(there, self.impact[self.at[where]], 0.0), there


class Sums:
    """A part's partial scores, a number for each chunk, and which chunks are candidates: room that its queries use in turn."""

    def __init__(self, n: int) -> None:
        self.total, self.candidate = np.zeros(n), np.zeros(n, bool)


def best(lists: list[tuple[float, Entries]], k: int, sums: Sums | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Chunks, scores and entries read: the k best, and those that tie with the last. lists: idf and entries of each term.

    Scores are added where they stand, so a term costs in proportion to what is read of it, and nothing is sorted. A chunk that
    left and comes again has a lower score than it should have, or its own; either way it can't be among the best.
    """
    lists = sorted(lists, key=lambda x: -x[0] * x[1].impact[0])
    rest = np.append(np.cumsum([idf * e.impact[0] for idf, e in lists][::-1])[::-1][1:], 0.0)
    sums = Sums(1 + max(int(e.sorted[-1]) for _, e in lists)) if sums is None else sums
    total, candidate = sums.total, sums.candidate
    total.fill(0.0)
    candidate.fill(False)
    chunks, floor, read = np.zeros(0, lists[0][1].chunk.dtype), -np.inf, 0
    for (idf, e), later in zip(lists, rest, strict=True):
        n = e.blocks((floor - later - SLACK) / idf) if np.isfinite(floor) else len(e.chunk)
        read += n
        first = e.chunk[:n]
        new = ~candidate[first]
        if n < len(e.chunk):
            more, there = e.of(chunks)
            total[first[new]] = 0.0
            total[first] += idf * e.impact[:n]
            candidate[first] = False  # those that the blocks brought already
            seen = candidate[chunks]
            total[chunks[seen]] += idf * more[seen]
            read += int((there & seen).sum())
        else:
            total[first] += idf * e.impact
        chunks = np.concatenate([chunks, first[new]])
        candidate[chunks] = True
        if len(chunks) >= k:
            scores = total[chunks]
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores + later >= floor - SLACK
            if not keep.all():
                candidate[chunks[~keep]] = False
                chunks = chunks[keep]
    return chunks, total[chunks], read


def terms_topk(queries: DataFrame, chunks: DataFrame, top_k: int, over: int = 4, stored: TextIndex | StoredIndex | None = None, counts: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """query_id, chunk_id and score: the best over * top_k of each query; exact. queries: query_id, text.

    counts, if given, are added to: entries of the queries' terms, and those of them that were read. Queries beyond ASKED
    pairs of query and term go in blocks, one after the other.
    """
    stored = TextIndex.passing(chunks) if stored is None else stored
    keep = over * top_k
    need = written(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")), "query-terms")
    n_all, total = stored.totals()
    relevant = written(stored.holding(need.select("token").distinct()).select("token", "chunk_id", F.size("positions").alias("f")), "term-entries")
    lengths = stored.lengths.join(small(relevant.select("chunk_id").distinct(), "term-chunks"), "chunk_id", "left_semi")
    n_entries = relevant.count()
    n_parts = max(1, -(-n_entries // PART), min(relevant.sparkSession.sparkContext.defaultParallelism, n_entries // LEAST_PART))
    f = F.col("f")
    impact = f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") * max(n_all, 1) / max(total, 1)))
    dealt = relevant.join(lengths, "chunk_id").select(F.pmod(F.xxhash64("chunk_id"), F.lit(n_parts)).alias("part"), "token", "chunk_id", impact.alias("impact"))
    dealt = written(dealt, "impacts")
    df = relevant.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((n_all - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = written(need.join(small(df.select("token", F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf).alias("idf")), "idf"), "token"), "weighted")
    n_blocks = max(1, -(-weighted.count() // ASKED))
    kind = need.schema["query_id"].dataType.simpleString()
    out = None
    for b in range(n_blocks):
        own = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b) if n_blocks > 1 else weighted
        asked = own.groupBy("query_id").agg(F.collect_list(F.struct("token", "idf")).alias("terms")).toArrow()  # about ASKED pairs
        ids, lists = asked.column("query_id").combine_chunks(), asked.column("terms").combine_chunks()
        off, words, weight = lists.offsets.to_numpy(), lists.values.field("token"), lists.values.field("idf").to_numpy()

        def run(table: pa.Table) -> pa.Table:  # pickled by written(), before the next block
            token = table.column("token").combine_chunks().dictionary_encode()
            names, code = np.unique(table.column("chunk_id").to_numpy(), return_inverse=True)
            impact, of = table.column("impact").to_numpy(), token.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[order], np.arange(len(token.dictionary) + 1))
            code, impact = code[order].astype(np.int32), impact[order]
            known = [Entries(code[x:y], impact[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
            place = pc.fill_null(pc.index_in(words, value_set=token.dictionary), -1).to_numpy()
            rows, found, scores, sums = [], [], [], Sums(len(names))
            for q in range(len(ids)):
                held = [(weight[i], known[place[i]]) for i in range(off[q], off[q + 1]) if place[i] >= 0]
                if held:
                    c, s, read = best(held, keep, sums)
                    rows.append(np.full(len(c), q))
                    found.append(names[c])
                    scores.append(s)
                    if counts is not None:
                        counts[0].add(sum(len(e.chunk) for _, e in held))
                        counts[1].add(read)
            join = lambda x, kind: pa.array(np.concatenate([np.zeros(0, kind), *x]))
            return pa.table({"query_id": ids.take(join(rows, np.int64)), "chunk_id": join(found, np.int64), "score": join(scores, np.float64)})

        hits = written(top_hits(dealt.groupBy("part").applyInArrow(run, f"query_id {kind}, chunk_id long, score double").withColumn("score", F.round("score", 12)), keep, "query_id"), "terms-hits")
        out = hits if out is None else out.unionByName(hits)
    return out
