"""The seam for models: a provider is a callable that turns a list of texts into a list of results.

It runs on the executors, a batch at a time; retries and rate limits are its own matter. A failing row never fails
the job. The defaults are deterministic and need no network.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.functions.text import token_lists, with_tokens
from rillwork.functions.vectors import code_of
from rillwork.tables import lean

#: Texts in a request to an embedding provider.
EMBED_BATCH = 25
#: Texts go to Python in slices of about so many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 4 << 20

Completion = Callable[[list[str]], list[str]]
Embedding = Callable[[list[str]], list[list[float]]]


def echo(prompts: list[str]) -> list[str]:
    """The offline model: the last line of the prompt and a mark that follows from the whole. What a prompt shares with the one
    before is hashed once, as a provider's prefix cache would."""

    def last(p: str) -> str:
        lines = p[-1000:].rstrip().splitlines()  # of two lines or more the last is whole
        return lines[-1] if len(lines) > 1 else (p.strip().splitlines() or [""])[-1]

    before, head, state, out = b"", b"", hashlib.md5(), []
    for p in prompts:
        whole = p.encode()
        if 2 * len(head) < len(whole) or not whole.startswith(head):
            head = whole[: _shared(whole, before)]
            state = hashlib.md5(head)
        mark = state.copy()
        mark.update(memoryview(whole)[len(head) :])
        out.append(f"{last(p)} #{mark.hexdigest()[:8]}")
        before = whole
    return out


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes both begin with."""
    n = min(len(a), len(b))
    differ = np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8) if n else np.zeros(0, bool)
    return int(differ.argmax()) if differ.any() else n


#: ASCII letters in lower case; all else is a space.
_LETTERS = bytes(c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def keywords(prompts: list[str]) -> list[str]:
    """The offline tagger: a JSON array of the three most frequent long words, of equal ones the first in order."""
    out = []
    for p in prompts:
        words = (w for w in p.encode().translate(_LETTERS).decode().split() if len(w) >= 6) if p.isascii() else re.findall(r"[^\W\d_]{6,}", p.lower())
        count = Counter(words)
        least = min(heapq.nlargest(3, count.values()), default=0)
        most = [(w, n) for w, n in count.items() if n >= least]
        out.append(json.dumps([w for w, _ in sorted(most, key=lambda x: (-x[1], x[0]))[:3]], ensure_ascii=False))
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `most` bytes together; every slice has a row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def answers(provider: Completion, texts: list[str | None]) -> list[tuple[str | None, str | None]]:
    """Answer and error to each text; a null text is not asked."""

    def ask(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            return provider([text])[0], None
        except Exception as e:  # any failure of a provider is a row's error
            return None, f"{type(e).__name__}: {e}"

    try:
        asked = [t for t in texts if t is not None]
        got = iter(zip(provider(asked), [None] * len(asked), strict=True))
        return [(None, None) if t is None else next(got) for t in texts]
    except Exception:  # find the row that failed
        return [ask(t) for t in texts]


def complete(prompts: DataFrame, provider: Completion = echo, keep: tuple[str, ...] = ("id",), prompt: str = "prompt") -> DataFrame:
    """The columns of keep, response, usage (characters in and out) and error; a null prompt is not asked."""
    rows = prompts.select(*keep, F.col(prompt).alias("prompt"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, n)):
            texts = batch.column(n).to_pylist()
            got = answers(provider, texts)
            answer, error = zip(*got, strict=True) if got else ((), ())
            used = [None if a is None else len(t) + len(a) for t, a in zip(texts, answer, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(answer, pa.string()), pa.array(used, pa.int64()), pa.array(error, pa.string())], [*batch.schema.names[:n], "response", "usage", "error"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(lean(run), f"{schema}, response string, usage long, error string")


def embed(rows: DataFrame, provider: Embedding | None = None, dim: int = 64, text: str = "text") -> DataFrame:
    """Add `embedding`, or replace it. Without a provider, hashed tokens; else requests of EMBED_BATCH texts."""
    if provider is None:
        return hashed(rows, dim, text)
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts = batch.column(at).to_pylist()
            got = [v for i in range(0, len(texts), EMBED_BATCH) for v in provider([t or "" for t in texts[i : i + EMBED_BATCH]])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.float32()))], [*batch.schema.names, "embedding"])

    return rows.mapInArrow(lean(run), _with_embedding(rows, T.FloatType()))


def _with_embedding(rows: DataFrame, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in rows.schema.fields if f.name != "embedding"), T.StructField("embedding", T.ArrayType(kind))])


def hashed(rows: DataFrame, dim: int, text: str, kind: pa.DataType | None = None) -> DataFrame:
    """Hashed embeddings: a batch's different tokens are coded once, and each is added to its place in one walk."""
    kind = kind or pa.float32()
    rows = rows.drop("embedding") if "embedding" in rows.columns else rows
    names = rows.columns
    tokenised = with_tokens(rows, F.coalesce(F.col(text), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            words = token_lists(batch)
            many = np.asarray(pc.list_value_length(words), np.int64)
            word = words.flatten().dictionary_encode()
            flat = code_of(word.dictionary, kept)[word.indices.to_numpy()]
            place = np.repeat(np.arange(len(many)), many) * dim + flat % dim
            total = np.bincount(place, np.where(flat // dim % 2 == 0, 1.0, -1.0), len(many) * dim).reshape(len(many), dim)
            length = np.sqrt((total * total).sum(axis=1, keepdims=True))
            unit = np.divide(total, length, out=total, where=length > 0).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(many) + 1) * dim, pa.int32()), pa.array(unit).cast(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], lists], [*names, "embedding"])

    return tokenised.mapInArrow(lean(run), _with_embedding(rows, T.DoubleType() if kind == pa.float64() else T.FloatType()))
