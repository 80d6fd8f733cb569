"""Packing token pieces into sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are tokenised once. A document gives as many full pieces as it can, each a sequence by itself, and one
remainder. Remainders are dealt at random into groups of bounded size, and each group is packed by itself:
longest first, each into the first bin with room. The tree over the bins' free space finds that bin in
logarithmic time.

Cases: a null or empty text has one token, the end of text. Repeated rows are packed each. A null doc_id is kept.
An empty table gives no pieces. Only the id and text columns are used, so other names can't clash.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.shared import map_texts, written

SEQUENCE = 2048
END_OF_TEXT = 1
#: Remainders in a group, about. A group's arrays take a few hundred kB.
GROUP_ROWS = 4096
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


class BinTree:
    """Tournament tree: a leaf holds the free space of a bin, an inner node the larger of its two children."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1
        while self.leaves < max(bins, 1):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def first_with(self, need: int) -> int:
        """The first bin with `need` free; the winner's way down from the root, left where it can."""
        free, at = self.free, 1
        if free[1] < need:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if free[at] < need:
                at += 1
        return at - self.leaves

    def take(self, place: int, need: int) -> int:
        """Use space of a bin, replay its matches, and return the offset that was taken."""
        free, at = self.free, place + self.leaves
        left = free[at]
        free[at] = left - need
        while at > 1:
            at //= 2
            most = max(free[2 * at], free[2 * at + 1])
            if free[at] == most:
                break
            free[at] = most
        return left - need


def first_fit_decreasing(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """For each length its bin, numbered from 0, and its offset there. Ties keep the order of the input."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tree = BinTree(n, capacity)
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        place = tree.first_with(need)
        left = tree.take(place, need)
        bins[i], offsets[i] = place, capacity - left - need
    return bins, offsets


def added_tokens(tokenizer_file: str) -> dict[str, int]:
    """Strings with an id of their own in a tokenizer's JSON file."""
    with open(tokenizer_file, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


def byte_bpe(ranks_file: str, pattern: str, added: dict[str, int] | None = None) -> Callable[[], Callable[[str], list[int]]]:
    """An encoder made in each task from a file of byte-level BPE ranks. Added strings in a text get their id; text before
    and after them is encoded by itself."""
    added = added or {}

    def load() -> Callable[[str], list[int]]:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        return partial(encoding.encode, allowed_special="all") if added else encoding.encode_ordinary

    return load


def token_pieces(docs: DataFrame, load: Callable[[], Callable[[str], list[int]]], capacity: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of PIECES: full pieces of a document, then its remainder if there is one."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def each():
        encode = load()

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            at, rows = [], []
            for i, text in enumerate(part.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END_OF_TEXT], "<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    at.append(i)
                    rows.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *(pa.array(c) for c in cols)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        return work

    return map_texts(docs, each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def pack(pieces: DataFrame, capacity: int = SEQUENCE, group_rows: int = GROUP_ROWS, seed: int = 17) -> DataFrame:
    """Add sequence_id and offset, both long, to a table of pieces with a `length`.

    pieces must give equal rows each time it is read, as a written table does. A sequence_id holds the group in
    its upper bits and the bin in its lower 31; a piece that fills a sequence has a negative one of its own.
    """
    own = F.monotonically_increasing_id()
    table = pieces.withColumn("own", own)
    full = table.where(F.col("length") >= capacity).select(*pieces.columns, (-1 - F.col("own")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = table.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_rows))
    rest = rest.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "own"), F.lit(groups)).cast("long"))
    given = pieces.columns
    names = [*given, "sequence_id", "offset"]

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by("own")
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        ids = (table.column("grp").to_numpy() << 31) + bins
        kept = table.select(given)
        return kept.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    packed = rest.groupBy("grp").applyInArrow(each, schema)
    return packed.select(*names).unionByName(full.select(*names))


def packed_documents(docs: DataFrame, load: Callable[[], Callable[[str], list[int]]], capacity: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, write the pieces (narrow rows) to the shared folder, and pack them."""
    return pack(written(token_pieces(docs, load, capacity, id_col, text_col), "pieces"), capacity)


def padding(packed: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Sequences, tokens and the share of padding."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    return used.agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"), (1 - F.sum("used") / (F.count("*") * capacity)).alias("padding"))


