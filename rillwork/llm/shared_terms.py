"""Ranked lexical search of many queries at once, with what they have in common computed once.

The terms of a block of queries are mined for shared sets: terms that stand in the same queries become one set, then the
pair of sets that most queries hold together becomes a new one, as long as two queries share it. This gives a graph: a set is
a sum of two others, a query a sum of few sets. Over a block of documents each term's scores are one row of an array;
each shared set adds two rows once, for all queries that use it, and each query adds the rows that are left to it.

A first pass over the texts counts terms and writes, for each document, its length and how often it has the queries' terms.
The second reads these narrow rows. A task keeps the best of each query only, so what is shuffled doesn't grow with pairs.
Queries whose terms are more than BLOCK_TERMS together go in blocks, one after the other, each over all documents.

Score of a document: the sum over the query's distinct terms of w * ((1000000000 tf) div (1000 tf + 8 m)), where w is
floor(1000 ln((2N + 2) / (2df + 1))) and m is 10 + (90 n N) div L; N documents have a term, L terms together, n this one.

Cases: null and empty texts have no terms; such documents don't count in N, such queries find nothing. Rows that repeat a
query's id are one query with the terms of all, also for a null id. Documents with a null id count in N, L and df and
can't be found. Documents that repeat an id are found as often as they stand. Ties go by id. Very long texts are counted
whole. Extra columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.shared import map_texts, written

#: Terms of the queries of a block together, at most about: what goes to every task is bounded by it.
BLOCK_TERMS = 200_000
#: Sets of a query that are looked at as pairs: each with so many that follow it. It changes the cost, not the result.
REACH = 24
#: Documents whose scores are in memory at a time, and numbers of an array of them.
DOCS, NUMBERS = 1024, 1 << 23
#: ASCII characters that aren't letters or digits separate terms; only A-Z are lowered.
SEPARATED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The text's terms in order, in UTF-8."""
    return text.encode().translate(SEPARATED).split() if text else []


@dataclass(frozen=True)
class Sharing:
    """How queries are summed up: row k is a term for k < len(terms), then the sum of rows left[j] and right[j]. Level after
    level, as bounds in `levels`; uses and use_ends have the rows of each query."""

    terms: list[bytes]
    left: np.ndarray
    right: np.ndarray
    levels: np.ndarray
    uses: np.ndarray
    use_ends: np.ndarray

    def additions(self) -> int:
        """Additions of rows for each document."""
        return len(self.left) + len(self.uses) - len(self.use_ends)


def mined(queries: list[list[bytes]]) -> Sharing:
    """The sharing of queries, each a list of distinct terms."""
    holders: dict[bytes, list[int]] = defaultdict(list)
    for q, ts in enumerate(queries):
        for t in ts:
            holders[t].append(q)
    known = sorted(holders)
    left: list[int] = []
    right: list[int] = []
    level = [0] * len(known)
    now: list[list[int]] = [[] for _ in queries]

    def joined(a: int, b: int) -> int:
        left.append(a)
        right.append(b)
        level.append(1 + max(level[a], level[b]))
        return len(level) - 1

    same: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for i, t in enumerate(known):
        same[tuple(holders[t])].append(i)
    for held, ids in same.items():
        while len(held) > 1 and len(ids) > 1:  # one set of all, as a tree
            ids = [joined(a, b) for a, b in zip(ids[::2], ids[1::2], strict=False)] + ids[len(ids) & ~1 :]
        for q in held:
            now[q] += ids
    while True:
        often = Counter(s for q in now for s in q)
        for q in now:
            q.sort(key=lambda s: (-often[s], s))
        pairs: dict[tuple[int, int], int] = Counter((min(a, b), max(a, b)) for q in now for i, a in enumerate(q) if often[a] > 1 for b in q[i + 1 : i + 1 + REACH] if often[b] > 1)
        best = sorted((p for p in pairs if pairs[p] > 1), key=lambda p: (-pairs[p], p))
        if not best:
            break
        taken: set[int] = set()
        new: dict[tuple[int, int], int] = {}
        for a, b in best:  # pairs that don't get in each other's way
            if a not in taken and b not in taken:
                taken |= {a, b}
                new[a, b] = joined(a, b)
        partner = {a: (b, n) for (a, b), n in new.items()}
        for k, q in enumerate(now):
            held = set(q)
            swap = {a: (b, n) for a, (b, n) in partner.items() if a in held and b in held} if len(partner) < len(held) else {a: partner[a] for a in held if a in partner and partner[a][0] in held}
            if swap:
                gone = {*swap, *(b for b, _ in swap.values())}
                now[k] = [s for s in q if s not in gone] + [n for _, n in swap.values()]
    used = Counter(s for q in now for s in q) + Counter(left + right)
    order = [k for k in range(len(known), len(level)) if used[k]]
    order.sort(key=lambda k: (level[k], k))
    row = {k: len(known) + j for j, k in enumerate(order)} | {k: k for k in range(len(known))}
    base = len(known)
    levels = np.array([level[k] for k in order], np.int64)
    bounds = np.flatnonzero(np.diff(levels, prepend=0, append=0)) if len(order) else np.zeros(0, np.int64)
    return Sharing(
        known, np.array([row[left[k - base]] for k in order], np.int64), np.array([row[right[k - base]] for k in order], np.int64), bounds,
        np.array([row[s] for q in now for s in q], np.int64), np.cumsum([len(q) for q in now], dtype=np.int64),
    )


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id and term, distinct."""
    kind = items.schema[id_col].dataType.simpleString()

    def each():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [sorted(set(terms(x.as_py()))) for x in part.column(1)]
            n = np.repeat(np.arange(len(found)), list(map(len, found)))
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(n)), pa.array([t for x in found for t in x], pa.binary())], ["item_id", "term"])

        return work

    return map_texts(items.select(id_col, F.col(text_col).cast("string").alias("text")), each, f"item_id {kind}, term binary").distinct()


def term_counts(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms), and of those of the sorted vocabulary the places and how often each stands."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def each():
        place = {t: i for i, t in enumerate(vocabulary)}

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            n, size, at, tf = [], [0], [], []
            for x in part.column(1):
                found = terms(x.as_py())
                counts = Counter(found)
                n.append(len(found))
                held = place.keys() & counts.keys()
                at += [place[t] for t in held]
                tf += [counts[t] for t in held]
                size.append(len(at))
            ends = pa.array(size, pa.int32())
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], ["doc_id", "n", "at", "tf"])

        return work

    return map_texts(docs, each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, at array<int>, tf array<long>")


def _kept(items: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each item, equal scores by id."""
    order = np.lexsort((ids, -score, items))
    items, score, ids = items[order], score[order], ids[order]
    keep = np.arange(len(items)) - np.searchsorted(items, items) < k
    return items[keep], score[keep], ids[keep]


def _ranked(rows: DataFrame, sharing: Sharing, weight: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """item (its number in the block), doc_id and score: the k best of each item in each task."""
    n_items, n_rows = len(sharing.use_ends), len(sharing.terms) + len(sharing.left)
    width = max(16, min(DOCS, NUMBERS // max(n_rows, 1)))

    def scored(n: np.ndarray, ends: np.ndarray, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Scores of the block's items (rows) for the documents."""
        m = 10 + 90 * n * total // length
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        held = np.zeros((n_rows, len(n)), np.int64)
        held[at, doc] = weight[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        base = len(sharing.terms)
        for lo, hi in pairwise(sharing.levels.tolist()):
            held[base + lo : base + hi] = held[sharing.left[lo:hi]] + held[sharing.right[lo:hi]]
        out = np.zeros((n_items, len(n)), np.int64)
        begin = 0
        for i, end in enumerate(sharing.use_ends.tolist()):
            if end > begin:
                np.sum(held[sharing.uses[begin:end]], axis=0, out=out[i])
            begin = end
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = np.ones(n_items, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, width):
                part = batch.slice(lo, width)
                ids, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                ends = np.append(0, np.cumsum(part.column(2).value_lengths().to_numpy()))
                score = scored(n, ends, part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy())
                item, doc = np.nonzero(score >= least[:, None])
                if not len(item):
                    continue
                best = _kept(np.append(best[0], item), np.append(best[1], score[item, doc]), np.append(best[2], ids[doc]), k)
                full = np.flatnonzero(np.bincount(best[0], minlength=n_items) >= k)
                least[full] = best[1][np.searchsorted(best[0], full, "right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[2]), pa.array(best[1])], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def shared_search(docs: DataFrame, items: DataFrame, top_k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id (a long) and score: the top_k documents with a score above 0 for each item."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType
    asked = written(query_terms(items, item_id, item_text), "query-terms")
    n_blocks = max(1, -(-asked.count() // block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    found = []
    for b in range(n_blocks):
        own = asked.where(block == b) if n_blocks > 1 else asked
        table = own.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).sort("item_id").toPandas()  # a block's, so bounded
        if not len(table):
            continue
        sharing = mined([[bytes(t) for t in ts] for ts in table["terms"]])
        counts = written(term_counts(docs, sharing.terms, doc_id, doc_text), "term-counts")
        total, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            continue
        df = counts.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df"))
        w = df.select("at", F.floor(1000 * F.log((2.0 * total + 2) / (2.0 * F.col("df") + 1))).alias("w")).toPandas()  # of a block's terms
        weight = np.zeros(len(sharing.terms), np.int64)
        weight[w["at"].to_numpy(np.int64)] = w["w"].to_numpy(np.int64)
        rows = _ranked(counts.where("doc_id is not null and size(at) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "n", "at", "tf"), sharing, weight, total, length, top_k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(table)), pa.int64()), "item_id": pa.Array.from_pandas(table["item_id"])}))
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
        found.append(written(ranked.join(F.broadcast(names), "item").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score"), "ranked"))
    if not found:
        return spark.createDataFrame(pd.DataFrame({"item_id": [], "rank": [], "doc_id": [], "score": []}), f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
