"""A phrase index that lives at a path: chunks are added and deleted, and any session searches it.

    manifests/0000000003.json    which segments and tombstones make up version 3; the newest one counts
    segments/000002-…/postings   bucket (a folder), token, chunk_id, positions
    segments/000002-…/words      chunk_id, words in order; dl, how many
    tombstones/000003-…          chunk_id of what was deleted

A segment's postings are sorted by bucket, token and chunk, so a reader sees the buckets of its tokens only and skips row
groups; positions are arrays of ints, which the files hold as differences. Words serve searches for many phrases. A tombstone takes away its chunks in segments
with a smaller number, so a chunk may come again later. Data are written first, then the manifest, under a name that
must be new: a run that dies leaves the version before it, and of two writers at once one fails. Chunks and tokens are
counted in the manifest, so a search reads no table for them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.text import token_lists, with_tokens
from rillwork.operators.index import few_tokens
from rillwork.tables import Folder, lean, put, short_shuffles, small, spread, written

#: Folders that tokens are dealt to by their hash.
BUCKETS = 64
#: Positions are stored as differences: Parquet's own coding for ints, in pages of its second version.
DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#positions.list.element": "false"}
FORMAT = 2
#: Tokens whose chunks are grouped at a time.
TOKENS = 1 << 18
#: Tokens of a bucket that one task sorts, about.
SHARE = 1 << 21


def words_of(rows: DataFrame, text: Column) -> DataFrame:
    """chunk_id and words, the text's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), token_lists(batch)], ["chunk_id", "words"])

    return with_tokens(rows, text).select("chunk_id", "plain__", "tokens__").mapInArrow(lean(run), "chunk_id long, words array<string>")


def _entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        many = pc.list_value_length(batch.column(1)).to_numpy()
        upto = np.cumsum(many)
        at = 0
        while at < batch.num_rows:  # so many rows as have TOKENS tokens, or one
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOKENS, "right")))
            part, n = batch.slice(at, end - at), many[at:end]
            at = end
            token = part.column(1).flatten().dictionary_encode()
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
            key = row * len(token.dictionary) + token.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            ends = pa.array(np.append(first, len(order)), pa.int32())
            positions = pa.ListArray.from_arrays(ends, pa.array(place[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([token.dictionary.take(token.indices.take(pa.array(order[first]))), part.column(0).take(pa.array(row[order[first]])), positions], ["token", "chunk_id", "positions"])


def entries_of(rows: DataFrame) -> DataFrame:
    """token, chunk_id and positions from 1, in order, of rows (chunk_id, words): a chunk's words are grouped where they lie."""
    return rows.select("chunk_id", "words").mapInArrow(lean(_entries_of), "token string, chunk_id long, positions array<int>")


GROUP = "token string, first long, ids binary, counts binary, more binary, places binary, far binary"
#: Entries that are grouped by token at a time before a shuffle.
ENTRIES = 1 << 20


def groups_of(rows: DataFrame) -> DataFrame:
    """The entries of rows (chunk_id, words), about ENTRIES at a time in a row for each token: first, its first chunk, and its
    chunks' ids, how often it is in each, and its places, each as bytes; what passes a count's byte or a place's two is in more
    and far, null where nothing does. A shuffle takes these instead of entries."""

    def grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
        token = batch.column(0).dictionary_encode()
        order = np.argsort(token.indices.to_numpy(), kind="stable")
        many = np.bincount(token.indices.to_numpy(), minlength=len(token.dictionary))
        sorted_ = batch.take(pa.array(order))
        ids = sorted_.column(1).to_numpy()
        counts = pc.list_value_length(sorted_.column(2)).to_numpy()
        places = sorted_.column(2).flatten().to_numpy()
        ends = np.append(0, np.cumsum(many))
        at = np.append(0, np.cumsum(counts))[ends]
        parts = (_bytes(ids, np.int64, ends), _bytes(counts % 256, np.uint8, ends), _bytes(counts // 256, np.int32, ends, True), _bytes(places % 65536, np.uint16, at), _bytes(places // 65536, np.uint16, at, True))
        return pa.RecordBatch.from_arrays([token.dictionary, pa.array(ids[ends[:-1]]), *parts], ["token", "first", "ids", "counts", "more", "places", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole() -> pa.RecordBatch:
            one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            return one

        for part in _entries_of(batches):
            held.append(part)
            if sum(p.num_rows for p in held) >= ENTRIES:
                del part
                yield grouped(whole())
        if sum(p.num_rows for p in held):
            yield grouped(whole())

    return rows.select("chunk_id", "words").mapInArrow(lean(run), GROUP)


def _bytes(values: np.ndarray, kind: type, ends: np.ndarray, rare: bool = False) -> pa.Array:
    """Runs of values as bytes, from their ends; if rare, null for a run of zeros."""
    values = np.ascontiguousarray(values, kind)
    if rare:
        upto = np.append(0, np.cumsum(values != 0))[ends]
        return pa.array([values[a:b].tobytes() if some else None for a, b, some in zip(ends[:-1].tolist(), ends[1:].tolist(), np.diff(upto).tolist(), strict=True)] if upto[-1] else [None] * (len(ends) - 1), pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _values(low: pa.Array, high: pa.Array, kind: type, rest: type) -> np.ndarray:
    """What _bytes() made of values in two parts."""
    values = np.frombuffer(b"".join(low.to_pylist()), kind).astype(np.int32)
    if high.null_count == len(high):
        return values
    sizes = np.asarray(pc.binary_length(low), np.int64).tolist()
    wide = np.dtype(rest).itemsize // np.dtype(kind).itemsize
    over = np.frombuffer(b"".join(bytes(n * wide) if h is None else h for n, h in zip(sizes, high.to_pylist(), strict=True)), rest)
    return values + over.astype(np.int32) * (1 << 8 * np.dtype(kind).itemsize)


def ungrouped(rows: DataFrame) -> DataFrame:
    """token, chunk_id, positions and bucket of groups_of() with a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            counts, places = _values(batch.column(2), batch.column(3), np.uint8, np.int32), _values(batch.column(4), batch.column(5), np.uint16, np.uint16)
            many = pa.array(np.repeat(np.arange(batch.num_rows), np.asarray(pc.binary_length(batch.column(1)), np.int64) // 8))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(places))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(many), pa.array(ids), lists, batch.column(6).take(many)], ["token", "chunk_id", "positions", "bucket"])

    return rows.select("token", "ids", "counts", "more", "places", "far", "bucket").mapInArrow(lean(run), "token string, chunk_id long, positions array<int>, bucket int")


@dataclass(frozen=True)
class Part:
    """A segment or a set of tombstones: its number, its folder, and the chunks and tokens that it adds or takes away."""

    number: int
    name: str
    chunks: int
    tokens: int


@dataclass(frozen=True)
class StoredIndex:
    """One version of the index at a path; changes give the next one."""

    spark: SparkSession = field(compare=False)
    path: str
    version: int = 0
    segments: tuple[Part, ...] = ()
    tombstones: tuple[Part, ...] = ()
    buckets: int = BUCKETS
    folder: Folder = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "folder", Folder(self.spark, self.path))

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> StoredIndex:
        """The newest version; an empty index where there is none."""
        folder = Folder(spark, path)
        names = sorted(n for n in folder.names("manifests") if n.endswith(".json"))
        if not names:
            return cls(spark, path, buckets=buckets)
        m = json.loads(folder.read(f"manifests/{names[-1]}"))
        if m["format"] != FORMAT:
            raise ValueError(f"the index at {path} has format {m['format']}, not {FORMAT}")
        return cls(spark, path, m["version"], *(tuple(Part(*p) for p in m[k]) for k in ("segments", "tombstones")), buckets=m["buckets"])

    def _next(self, segments: tuple[Part, ...], tombstones: tuple[Part, ...]) -> StoredIndex:
        new = replace(self, version=self.version + 1, segments=segments, tombstones=tombstones)
        parts = {k: [[p.number, p.name, p.chunks, p.tokens] for p in getattr(new, k)] for k in ("segments", "tombstones")}
        self.folder.create(f"manifests/{new.version:010d}.json", json.dumps({"format": FORMAT, "version": new.version, "buckets": self.buckets} | parts))
        return new

    def _new(self) -> tuple[int, str]:
        """Number and folder of the next part. No other run writes to the folder, so none can spoil what another one has
        published; what a run that died left in its folder is never read, and goes with vacuum()."""
        number = max((p.number for p in self.segments + self.tombstones), default=0) + 1
        return number, f"{number:06d}-{uuid.uuid4().hex[:12]}"

    def totals(self) -> tuple[int, int]:
        """Live chunks, and their tokens."""
        return tuple(sum(getattr(p, c) for p in self.segments) - sum(getattr(p, c) for p in self.tombstones) for c in ("chunks", "tokens"))

    def _rows(self, kind: str, schema: str) -> DataFrame | None:
        """Live rows of all segments."""
        gone = None
        if self.tombstones:
            dead = [self.spark.read.schema("chunk_id long").parquet(f"{self.path}/tombstones/{p.name}").withColumn("t", F.lit(p.number)) for p in self.tombstones]
            union = dead[0]
            for d in dead[1:]:
                union = union.unionByName(d)
            gone = small(union.groupBy("chunk_id").agg(F.max("t").alias("t")), "tombstones")
        out = None
        for p in self.segments:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/segments/{p.name}/{kind}")
            if gone is not None and any(t.number > p.number for t in self.tombstones):
                rows = rows.join(gone.where(F.col("t") > p.number).select("chunk_id"), "chunk_id", "left_anti").select(*rows.columns)
            out = rows if out is None else out.unionByName(rows)
        return out

    @property
    def lengths(self) -> DataFrame:
        """chunk_id and dl, its tokens."""
        found = self._rows("words", "chunk_id long, dl long")
        return self.spark.createDataFrame([], "chunk_id long, dl long") if found is None else found

    def by_chunk(self) -> DataFrame:
        """chunk_id and words, its tokens in order."""
        found = self._rows("words", "chunk_id long, words array<string>")
        return self.spark.createDataFrame([], "chunk_id long, words array<string>") if found is None else found

    def _entries(self) -> DataFrame:
        schema = "token string, chunk_id long, positions array<int>, bucket int"
        found = self._rows("postings", schema)
        return self.spark.createDataFrame([], schema) if found is None else found

    @property
    def entries(self) -> DataFrame:
        """token, chunk_id and positions, in order: one row for a chunk's token."""
        return self._entries().select("token", "chunk_id", "positions")

    @property
    def postings(self) -> DataFrame:
        """chunk_id, token and pos from 1."""
        return self._entries().select("chunk_id", "token", F.explode("positions").alias("pos")).withColumn("pos", F.col("pos").cast("long"))

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.hash(token), F.lit(self.buckets)).cast("int")

    def holding(self, wanted: DataFrame) -> DataFrame:
        """token, chunk_id and positions of the wanted tokens: of their buckets alone are files read."""
        buckets = [r["b"] for r in wanted.select(self._bucket(F.col("token")).alias("b")).distinct().collect()]
        return self._entries().where(F.col("bucket").isin(buckets)).join(few_tokens(wanted), "token", "left_semi").select("token", "chunk_id", "positions")

    def add(self, chunks: DataFrame, text: str = "content") -> StoredIndex:
        """The index with the chunks that it doesn't have. A run that comes again adds nothing. Ids must be unique."""
        rows = chunks.where("chunk_id is not null").select("chunk_id", F.col(text).alias("text__"))
        if self.segments:
            known = self.lengths.select("chunk_id")
            if rows.join(known, "chunk_id", "left_semi").limit(1).count():  # else all are new, and no text needs a join
                rows = rows.join(small(rows.select("chunk_id").join(known, "chunk_id", "left_anti"), "new-chunks"), "chunk_id", "left_semi")
        number, name = self._new()
        at = f"{self.path}/segments/{name}"
        self._put_words(words_of(spread(rows), F.coalesce("text__", F.lit(""))), at)
        lengths = self.spark.read.schema("chunk_id long, dl long").parquet(f"{at}/words")
        n, distinct, total = lengths.agg(F.count("*"), F.count_distinct("chunk_id"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if distinct < n or not n:
            self.folder.delete(f"segments/{name}")
        if distinct < n:
            raise ValueError(f"{n - distinct} chunks repeat an id")
        if not n:
            return self
        return self._written(groups_of(self.spark.read.schema("chunk_id long, words array<string>").parquet(f"{at}/words")), number, name, n, total, self.segments, self.tombstones)

    def _put_words(self, rows: DataFrame, at: str) -> None:
        put(rows.select("chunk_id", "words", F.size("words").cast("long").alias("dl")), f"{at}/words")

    def _written(self, groups: DataFrame, number: int, name: str, n: int, total: int, segments: tuple[Part, ...], tombstones: tuple[Part, ...]) -> StoredIndex:
        """The next version with the segment `name`, whose words are written. Groups are dealt by bucket and, so that no task
        gets all of a frequent token, by a share that follows from the group; they become entries where they arrive."""
        shares = 1 + total // (self.buckets * SHARE)
        share = F.pmod(F.xxhash64("first"), F.lit(shares))
        dealt = groups.select("token", "ids", "counts", "more", "places", "far", self._bucket(F.col("token")).alias("bucket"), share.alias("share")).repartition("bucket", "share")
        entries = ungrouped(dealt).sortWithinPartitions("bucket", "token", "chunk_id")
        with short_shuffles(self.spark):
            entries.write.options(**DELTAS, compression="zstd").partitionBy("bucket").parquet(f"{self.path}/segments/{name}/postings")
        return self._next((*segments, Part(number, name, n, total)), tombstones)

    def backfill(self, chunks: DataFrame, text: str = "content", n: int | None = None) -> StoredIndex:
        """add(), where the index has not as many chunks as there are; n, if that is known."""
        n = chunks.where("chunk_id is not null").count() if n is None else n
        return self if self.totals()[0] == n else self.add(chunks, text)

    def delete(self, ids: DataFrame) -> StoredIndex:
        """The index without the chunks (chunk_id); ids that it doesn't have change nothing."""
        gone = written(self.lengths.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi"), "gone")
        n, total = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not n:
            return self
        number, name = self._new()
        gone.select("chunk_id").write.parquet(f"{self.path}/tombstones/{name}")
        return self._next(self.segments, (*self.tombstones, Part(number, name, n, total)))

    def merge(self) -> StoredIndex:
        """The same rows in one segment, without tombstones. Files of older versions stay until vacuum()."""
        if len(self.segments) + len(self.tombstones) < 2:
            return self
        number, name = self._new()
        at = f"{self.path}/segments/{name}"
        self._put_words(self.by_chunk(), at)
        return self._written(groups_of(self.spark.read.schema("chunk_id long, words array<string>").parquet(f"{at}/words")), number, name, *self.totals(), (), ())

    def vacuum(self) -> None:
        """Remove versions before this one and what only they hold. Nobody may read them any more."""
        for name in self.folder.names("manifests"):
            if name < f"{self.version:010d}.json":
                self.folder.delete(f"manifests/{name}")
        for kind in ("segments", "tombstones"):
            live = {p.name for p in getattr(self, kind)}
            for name in self.folder.names(kind):
                if name not in live:
                    self.folder.delete(f"{kind}/{name}")
