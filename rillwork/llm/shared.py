"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.tables import forget, scratch_path, settled, shared_dir, short_shuffles, written

__all__ = ["forget", "fresh", "map_texts", "numbered", "pieces", "scratch_path", "settled", "shared_dir", "short_shuffles", "with_answers", "written"]

#: Texts go to Python in pieces of about so many bytes, whatever the size of an Arrow batch.
CHUNK_BYTES = 4 << 20
#: Keys with more rows than this are hot, unless more than HOT_KEYS could be.
HOT_ROWS, HOT_KEYS = 1024, 100_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_answers(rows: DataFrame, answers: DataFrame, on: list[str], how: str = "inner", n: str = "n__", total: int | None = None) -> DataFrame:
    """Join rows with answers, a table with a row for each key and `n`, how many of the rows have the key.

    An aggregate of a table joined back to it on the same key can't be split by the optimiser where a key is hot. So
    the answers of keys with many rows, of which there can be HOT_KEYS at most, are broadcast, and only rows of the
    other keys are shuffled. Keys aren't null. total, the number of rows, saves counting them.
    """
    total = rows.count() if total is None else total
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = answers.where(F.col(n) > least)
    some = F.broadcast(hot.select(*on).withColumn("hot__", F.lit(True)))
    marked = rows.join(some, on, "left")
    names = [c for c in answers.columns if c not in on and c != n]
    in_hot = marked.where("hot__").drop("hot__").join(F.broadcast(hot.drop(n)), on)
    rest = marked.where("hot__ is null").drop("hot__").join(answers.where(F.col(n) <= least).drop(n), on, how)
    out = [*rows.columns, *names]
    return in_hot.select(*out).unionByName(rest.select(*out))


def pieces(batch: pa.RecordBatch, text: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `most` bytes together; every slice has a row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def map_texts(df: DataFrame, each: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text: int = 1, most: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow in slices of bounded size, about `most` bytes of text. `each` runs once in a task and returns the function for a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = each()
        for batch in batches:
            for part in pieces(batch, text, most):
                yield work(part)

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str, ordered_buckets: bool = True) -> DataFrame:
    """Gapless row numbers from 0 in each group, without one task for a whole group.

    Rows are numbered inside (group, bucket); a table with a row for each bucket gives the offsets. Choose
    buckets of bounded size. The numbers follow the order of the buckets, then `order`.
    """
    b = fresh(df, "bucket__")
    inside, n, off = fresh(df, "inside__"), fresh(df, "n__"), fresh(df, "off__")
    df = df.withColumn(b, bucket)
    sizes = df.groupBy(*group, b).agg(F.count("*").alias(n))
    offsets = sizes.withColumn(off, F.sum(n).over(Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1))).select(
        *(F.col(c).alias(f"{c}__k") for c in group), F.col(b).alias(f"{b}k"), F.coalesce(off, F.lit(0)).alias(off)
    )
    local = df.withColumn(inside, F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)) - 1)
    on = reduce(lambda x, y: x & y, [local[c].eqNullSafe(offsets[f"{c}__k"]) for c in group] + [local[b].eqNullSafe(offsets[f"{b}k"])])
    return local.join(offsets, on, "left").withColumn(name, (F.col(inside) + F.col(off)).cast("long")).drop(inside, off, b, f"{b}k", *(f"{c}__k" for c in group))
