"""Near copies by the cosine of embeddings: every pair at the threshold or above is linked, and links reach classes.

For unit vectors a cosine of t is a distance of r = sqrt(2 - 2t). Vectors stand in the cell of their nearest centre. If x and
y lie within r of each other in the cells i and j, then x is no farther than r from the plane between their centres, so x
visits every cell j > i for which that holds, and each close pair meets in the cell of its higher number. Within a cell
distances to the centre differ by r at most (triangle inequality), which bounds the stripe of a sorted cell that a vector is
compared with; the comparison itself is exact. What the centres are changes the cost alone.

Equal vectors are one before all this. Cells of over BLOCK vectors are dealt out in pairs of blocks, so no task holds a whole
cell, and a pair of blocks gives a spanning forest of its links, not all of them. What is shuffled falls with the size of cells
and blocks, as a block meets others as a whole; products in floats pick the pairs that are then compared in doubles. Vectors that are null, zero, or have a
null in them have no near copies; those of different dimensions never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.functions.vectors import norm
from rillwork.tables import small, written

THRESHOLD = 0.95
#: Vectors of a cell, about; cells at most; vectors that the centres are fitted on; vectors of a block, of which a table has
#: BLOCKS where they can be that small; numbers of a product.
CELL, MOST_CELLS, FIT, BLOCK, LEAST_BLOCK, BLOCKS, TILE = 1 << 15, 1024, 20_000, 1 << 15, 2048, 16, (512, 8192)
#: Cosines are compared to so many digits.
DIGITS = 9


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def centres(distinct: DataFrame, n: int, seed: int = 5) -> np.ndarray:
    """Centres of cells, by k-means on a sample of unit vectors; the origin alone for few vectors."""
    k = min(n // CELL, MOST_CELLS)
    if k < 2:
        return np.zeros((1, distinct.select(F.size("embedding")).first()[0]))
    u = F.transform(F.col("embedding").cast("array<double>"), lambda x: x / norm(F.col("embedding")))
    rows = distinct.withColumn("features", array_to_vector(u))
    rows = rows if n <= FIT else rows.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(FIT / n * (1 << 20)) + 1)
    return np.array(KMeans(k=k, seed=seed, maxIter=8).fit(rows).clusterCenters())


def placed(distinct: DataFrame, dim: int, centre: np.ndarray, reach: float, units: bool = True) -> DataFrame:
    """cell, home (whether it is the vector's own), rep, far (its distance to the centre) and unit, for each cell that a vector
    stands in or visits; without units these are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.sqrt(np.maximum(((centre[:, None] - centre[None]) ** 2).sum(axis=2), 1e-30)) if len(centre) <= 4096 else None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _unit(part.column(1), dim)
                far = np.maximum((centre * centre).sum(axis=1) - 2 * x @ centre.T + 1, 0)  # squared
                own = far.argmin(axis=1)
                rows = np.arange(len(x))
                plane = (far - far[rows, own][:, None]) / (2 * apart[own])
                visits = (plane <= reach + 1e-9) & (np.arange(len(centre)) > own[:, None])
                visits[rows, own] = True
                row, cell = np.nonzero(visits)
                unit = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * dim, pa.int32()), pa.array(x[row].ravel())) if units else pa.nulls(len(row), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(own[row] == cell), part.column(0).take(pa.array(row)), pa.array(np.sqrt(far[row, cell])), unit], ["cell", "home", "rep", "far", "unit"])

    return distinct.select("rep", "embedding").mapInArrow(run, "cell int, home boolean, rep long, far double, unit array<double>")


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put the links a-b into label, the least member of each item's class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label[:] = label[label]


def links(dealt: DataFrame, dim: int, threshold: float, reach: float) -> DataFrame:
    """u and v of a spanning forest of the links in each pair of blocks (cell, lo, hi)."""
    sure = threshold - (dim + 4) * 2.0**-23  # a product in floats is off by less

    def run(table: pa.Table) -> pa.Table:
        far, rep, block = (table.column(c).to_numpy() for c in ("far", "rep", "block"))
        x = table.column("unit").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order = np.argsort(far, kind="stable")
        one = block[order] == block.min()
        two = not one.all()
        left, right = (order[one], order[~one]) if two else (order, order)
        a, b, to = x[left].astype(np.float32), x[right].astype(np.float32), far[right]
        label = np.arange(len(x))
        for lo in range(0, len(left), TILE[0]):
            hi = min(lo + TILE[0], len(left))
            first = int(np.searchsorted(to, far[left[lo]] - reach - 1e-9))
            last = int(np.searchsorted(to, far[left[hi - 1]] + reach + 1e-9, "right"))
            for at in range(first if two else max(first, lo), last, TILE[1]):
                end = min(at + TILE[1], last)
                row, col = np.nonzero(a[lo:hi] @ b[at:end].T >= sure)
                row, col = left[row + lo], right[col + at]
                new = label[row] != label[col]  # links within a class add nothing
                row, col = row[new], col[new]
                for k in range(0, len(row), 1 << 16):
                    u, v = row[k : k + (1 << 16)], col[k : k + (1 << 16)]
                    near = np.round(np.einsum("ij,ij->i", x[u], x[v]), DIGITS) >= threshold
                    _join(label, u[near], v[near])
        member = np.flatnonzero(label != np.arange(len(x)))
        return pa.table({"u": pa.array(rep[member]), "v": pa.array(rep[label[member]])})

    return dealt.groupBy("cell", "lo", "hi").applyInArrow(run, "u long, v long")


def deal(rows: DataFrame, block: int, counted: DataFrame | None = None) -> DataFrame:
    """Rows of each cell in pairs of blocks: blocks of its own vectors meet each other and the blocks of visitors. counted: the
    same rows, without units."""
    sizes = (rows if counted is None else counted).groupBy("cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    n = lambda c: F.ceil(F.col(c) / block).cast("int")
    rows = rows.join(F.broadcast(sizes), "cell")  # a row for each cell, MOST_CELLS at most
    rows = rows.withColumn("block", F.when(F.col("home"), F.pmod(F.xxhash64("rep"), n("homes"))).otherwise(n("homes") + F.pmod(F.xxhash64("rep"), F.greatest(n("guests"), F.lit(1)))).cast("int")).where("homes > 0")
    with_whom = F.when(F.col("home"), F.sequence(F.lit(0), n("homes") + n("guests") - 1)).otherwise(F.sequence(F.lit(0), n("homes") - 1))
    rows = rows.withColumn("other", F.explode(with_whom))
    return rows.select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "home", "rep", "far", "unit")


def classes(found: DataFrame, rounds: int = 100) -> DataFrame:
    """node and component, its least node, by passing on the least label and jumping to the label's label."""
    both = written(found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    now = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    for _ in range(rounds):
        seen = both.join(now.withColumnsRenamed({"node": "v", "label": "other"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("other").alias("least"))
        lower = now.join(seen, "node").select("node", "label", F.least("label", "least").alias("new"))
        jumped = lower.join(now.withColumnsRenamed({"node": "new", "label": "further"}), "new", "left").select("node", "label", F.least("new", F.coalesce("further", "new")).alias("new"))
        after = written(jumped, "labels")
        changed = after.where("new <> label").limit(1).count()
        now = after.select("node", F.col("new").alias("label"))
        if not changed:
            return now.withColumnRenamed("label", "component")
    raise RuntimeError(f"classes didn't settle in {rounds} rounds")


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "chunk_id", vector_col: str = "embedding", block: int | None = None) -> DataFrame:
    """id and class_id, the least id that links reach, for each row; a row without a usable vector is a class of its own."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and 1 at most")
    reach = math.sqrt(2 - 2 * threshold)
    rows = written(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding")), "all-vectors")
    usable = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where("id is not null").where(usable)
    distinct = written(good.groupBy("embedding").agg(F.min("id").alias("rep")), "distinct-vectors")
    sizes = distinct.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()  # a row for each dimension
    found = None
    for dim, n in sorted(tuple(r) for r in sizes):
        own = distinct.where(F.size("embedding") == dim)
        c = centres(own, n)
        sizes = written(placed(own, dim, c, reach, units=False).select("cell", "home"), "visits")
        met = deal(placed(own, dim, c, reach), min(BLOCK, max(LEAST_BLOCK, n // BLOCKS)) if block is None else block, sizes)
        part = written(links(met, dim, threshold, reach), "semantic-links")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("id", F.col("id").alias("class_id"))
    named = distinct.join(small(classes(found).withColumnRenamed("node", "rep"), "classes"), "rep", "left").select("embedding", F.coalesce("component", "rep").alias("class_id"))
    copies = good.join(named, "embedding").select("id", "class_id")
    return copies.unionByName(rows.where(F.col("id").isNull() | ~usable).select("id", F.col("id").alias("class_id")))
