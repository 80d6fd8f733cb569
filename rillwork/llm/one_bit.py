"""Nearest neighbours by inner product, with randomly rotated one-bit codes.

A vector less the centre is rotated by a random orthogonal matrix, and the signs of its coordinates, packed in 64-bit words,
are its code. With it are kept the length of the difference and how well the code's direction fits it: from these and
the counts of common bits with a query's coordinates, taken in 4-bit steps, comes an estimate of the inner product with
an error bound that holds with high probability. While a task passes over the index it knows the k-th best product
of each query so far; a vector whose estimate plus bound stays below it is left out, the others are multiplied out in
double precision. The width of the bound, SURE, sets what is found against work; README has both, measured.

Queries go to the tasks in blocks of MATRIX numbers at most, one block after the other, each against all rows of the
written index. Of equal vectors that lie together only 2k with the least ids are looked at, of each id k: no other can be found.

Cases: vectors that are null, zero, or hold a null, NaN or infinite component take no part, nor do rows without an id. An
inner product exists between vectors of one dimension, so each dimension that a query has is searched by itself. A query's
own id is no candidate. Rows that repeat an id are all candidates; as a query the least vector stands. Ties go by id. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.shared import written

#: Deviations of the estimate that its error bound allows for.
SURE = 1.9
#: Rows whose mean is the centre, about; the index has all rows.
CENTRE_ROWS = 10_000
#: Numbers of a block of queries, sent to every task (32 MB of doubles).
MATRIX = 1 << 22
#: Vectors and queries that are compared at a time, pairs that are ranked at a time, and of them those that are multiplied out
#: at a time. Arrays of these sizes stay in a core's cache.
VECTORS, QUERIES, PAIRS, PRODUCTS = 4096, 64, 1 << 16, 2048
#: Bits of a query's coordinates.
STEPS = 4


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the code as words of 64 bits, the length of its difference to the centre, and the fit of the code."""
    x = (vectors - centre) @ turn
    length = np.sqrt((x * x).sum(axis=1))
    bits = x > 0
    dim = x.shape[1]
    fit = np.divide(np.abs(x).sum(axis=1), length * np.sqrt(dim), out=np.ones(len(x)), where=length > 0)
    words = np.zeros((len(x), -(-dim // 64) * 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    words[:, : packed.shape[1]] = packed
    return words.view(np.uint64), length, fit


@dataclass(frozen=True)
class Queries:
    """Queries' rotated coordinates in steps: bit planes (query, plane, word), the least, the step, the sum; and lengths."""

    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, queries: np.ndarray, turn: np.ndarray) -> Queries:
        x = queries @ turn
        low = x.min(axis=1)
        step = (x.max(axis=1) - low) / ((1 << STEPS) - 1)
        at = np.rint((x - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.int64)
        planes = np.zeros((len(x), STEPS, -(-x.shape[1] // 64) * 8), np.uint8)
        for b in range(STEPS):
            packed = np.packbits((at >> b) & 1, axis=1, bitorder="little")
            planes[:, b, : packed.shape[1]] = packed
        return cls(planes.view(np.uint64), low, step, x.sum(axis=1), np.sqrt((x * x).sum(axis=1)))


def _common(queries: Queries, code: np.ndarray) -> np.ndarray:
    """Sums of the queries' steps over the bits of the codes (queries by vectors)."""
    common = np.zeros((len(queries.low), len(code)), np.uint16 if code.shape[1] <= 64 else np.uint32)
    for w in range(code.shape[1]):
        for b in range(STEPS):
            common += np.left_shift(np.bitwise_count(queries.planes[:, b, w, None] & code[None, :, w]), b, dtype=common.dtype)
    return common


def _terms(code: np.ndarray, length: np.ndarray, fit: np.ndarray, dim: int, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector: its bits, what a bit counts, and the error bounds of the code and of the steps of the queries."""
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int32)
    scale = length / (fit * np.sqrt(dim))
    apart = sure * length * np.sqrt(np.maximum(1 - fit * fit, 0) / max(dim - 1, 1)) / fit
    return ones, scale, apart, sure * scale * 2 * np.sqrt(ones / 12)


def estimated(queries: Queries, code: np.ndarray, length: np.ndarray, fit: np.ndarray, near: np.ndarray, dim: int, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products (queries by vectors), and their error bounds. near: the products with the centre."""
    ones, scale, apart, steps = _terms(code, length, fit, dim, sure)
    set_bits = queries.low[:, None] * ones[None, :] + queries.step[:, None] * _common(queries, code)  # the sum of the coordinates with a bit
    guess = near[:, None] + (2 * set_bits - queries.total[:, None]) * scale[None, :]
    return guess, queries.norm[:, None] * apart[None, :] + queries.step[:, None] * steps[None, :]


def may_reach(queries: Queries, code: np.ndarray, length: np.ndarray, fit: np.ndarray, near: np.ndarray, floor: np.ndarray, dim: int, sure: float = SURE) -> np.ndarray:
    """Whether the estimate plus its error bound reaches the query's floor (queries by vectors). The same as by estimated(), but
    solved for the common bits: what they must come to is a product of two narrow matrices."""
    ones, scale, apart, steps = _terms(code, length, fit, dim, sure)
    some = scale > 0
    unit = np.where(some, scale, 1)
    of_query = np.stack([np.maximum(floor, -1e300) - near, -2 * queries.low, queries.total, -queries.norm, -queries.step], axis=1)
    least = of_query @ np.stack([1 / unit, ones, np.ones(len(unit)), apart / unit, steps / unit])
    out = _common(queries, code) * (2 * queries.step)[:, None] >= least
    if not some.all():  # vectors at the centre
        out[:, ~some] = (near >= floor)[:, None]
    return out


def valid(embedding: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def index(vectors: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """vec_id, embedding, code, length and fit of every valid vector of the dimension, and the centre."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null").where(valid(F.col("embedding")) & (F.size("embedding") == dim))
    n = rows.count()
    share = int(min(1.0, CENTRE_ROWS / max(n, 1)) * (1 << 20)) + 1
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).select(F.posexplode("embedding").alias("i", "x"))
    means = {r["i"]: r["m"] for r in some.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()}  # one row for each coordinate
    centre = np.array([means.get(i, 0.0) for i in range(dim)])
    centre = np.where(np.isfinite(centre), centre, 0.0)
    kind = rows.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS):
                part = batch.slice(at, VECTORS)
                words, length, fit = codes(_matrix(part.column(1), dim), centre, turn)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([w.tobytes() for w in words], pa.binary()), pa.array(length), pa.array(fit)], ["vec_id", "embedding", "code", "length", "fit"])

    return written(rows.mapInArrow(run, f"vec_id long, embedding {kind}, code binary, length double, fit double"), "one-bit-index"), centre


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _first_of_equal(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows to look at: of equal vectors the k with the least ids, and as many again for a query that has some of these ids."""
    _, which = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((ids, which))
    for columns, most in (((which, ids), k), ((which,), 2 * k)):  # rows that repeat an id, then all
        held = [c[order] for c in columns]
        first = np.flatnonzero(np.concatenate([[True], np.any([h[1:] != h[:-1] for h in held], axis=0)])[: len(order)])
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        order = order[place < most]
    return np.sort(order)


def products(a: np.ndarray, a_rows: np.ndarray, b: np.ndarray, b_rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows; equal rows give equal ones wherever they stand."""
    out = np.empty(len(a_rows))
    for i in range(0, len(out), PRODUCTS):
        x = b.take(b_rows[i : i + PRODUCTS], axis=0)
        x *= a.take(a_rows[i : i + PRODUCTS], axis=0)
        np.sum(x, axis=1, out=out[i : i + PRODUCTS])
    return out


class Best:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def least(self, rows: slice) -> np.ndarray:
        return self.score[rows, -1]

    def put(self, first: int, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """New pairs; query numbers are from `first` on."""
        rows = np.unique(query)
        row = np.concatenate([np.searchsorted(rows, query), np.repeat(np.arange(len(rows)), self.k)])
        s, i = np.append(score, self.score[rows + first]), np.append(ids, self.ids[rows + first])
        order = np.lexsort((i, -s, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.score[rows + first], self.ids[rows + first] = s[order].reshape(-1, self.k), i[order].reshape(-1, self.k)


def _searched(rows: DataFrame, ids: np.ndarray, matrix: np.ndarray, centre: np.ndarray, k: int, sure: float, seed: int) -> DataFrame:
    """query_id, vec_id and score: the k best of each query among the rows of each task."""
    dim = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        best, near = Best(len(ids), k), matrix @ centre
        tiles = [(at, Queries.of(matrix[at : at + QUERIES], turn)) for at in range(0, len(ids), QUERIES)]
        for batch in batches:
            for begin in range(0, batch.num_rows, VECTORS):
                part = batch.slice(begin, VECTORS)
                keep = _first_of_equal(_matrix(part.column(1), dim), part.column(0).to_numpy(), k)
                part = part.take(pa.array(keep))
                vec, v = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64).reshape(len(vec), -1)
                length, fit = part.column(3).to_numpy(), part.column(4).to_numpy()
                for at, tile in tiles:
                    own = slice(at, at + len(tile.low))
                    floor = best.least(own)
                    if len(vec) >= k and not np.isfinite(floor).all():  # what is sure of this block, without the query itself
                        guess, bound = estimated(tile, code, length, fit, near[own], dim, sure)
                        sure_of = np.where(ids[own][:, None] == vec[None, :], np.inf, bound - guess)
                        floor = np.maximum(floor, -np.partition(sure_of, k - 1, axis=1)[:, k - 1])
                    query, row = np.nonzero(may_reach(tile, code, length, fit, near[own], floor, dim, sure))
                    other = ids[query + at] != vec[row]
                    query, row = query[other], row[other]
                    for cut in range(0, len(query), PAIRS):
                        q, r = query[cut : cut + PAIRS], row[cut : cut + PAIRS]
                        score = products(matrix, q + at, v, r)
                        in_it = score >= best.least(own)[q]
                        if in_it.any():
                            best.put(at, q[in_it], score[in_it], vec[r[in_it]])
        query, place = np.nonzero(best.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(best.ids[query, place]), pa.array(best.score[query, place])], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sure: float = SURE, block: int = MATRIX, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of is_query the k other rows with the largest inner products."""
    spark = vectors.sparkSession
    asked = vectors.where(is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null").where(valid(F.col("embedding")))
    asked = written(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    sizes = asked.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()  # one row for each dimension
    found = []
    for dim, n in sorted(tuple(r) for r in sizes):
        rows, centre = index(vectors, dim, id_col, vector_col, seed)
        n_blocks = max(1, -(-n * dim // block))
        for b in range(n_blocks):
            own = asked.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b)).toArrow()  # about `block` numbers
            if not own.num_rows:
                continue
            ids, matrix = own.column("vec_id").to_numpy(), _matrix(own.column("embedding").combine_chunks(), dim)
            best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            ranked = _searched(rows, ids, matrix, centre, k, sure, seed).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            found.append(written(ranked.select("query_id", "rank", "vec_id", "score"), "nearest"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
