"""Vector expressions in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, from the first element on."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


#: Tokens whose codes are kept, about.
KEPT = 1 << 17


def code_of(tokens: pa.Array, kept: dict[bytes, int] | None = None) -> np.ndarray:
    """A number of each token for hashed embeddings, a deterministic stand-in for a model: the place is its remainder by
    the dimension and the sign that of the quotient's parity. It comes from the MD5, so any engine can repeat it. kept: codes
    of tokens seen before."""
    kept = {} if kept is None else kept
    if len(kept) > KEPT:
        kept.clear()
    names = tokens.cast(pa.binary()).to_pylist()
    kept.update((t, int.from_bytes(hashlib.md5(t).digest()[:3], "big")) for t in names if t not in kept)
    return np.fromiter(map(kept.__getitem__, names), np.int64, len(names))
