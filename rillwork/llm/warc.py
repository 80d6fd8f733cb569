"""WARC archives as a PySpark Python data source, to write and to read.

Writing: each task writes .warc.gz files, a gzip member for each record, and begins a new file at ROLL_BYTES. A
member carries the `sl` extra field with its compressed and plain length, so a reader may step over it unread.

Reading: files are planned into partitions by size. Predicates on the record type and on headers are pushed down;
for each record the headers are inflated and parsed first, and the payload of a record that a predicate refuses
is neither inflated nor decoded. With the option payload=false no payload is.

Cases: an empty table writes archives without records, or none, and reads as an empty table. A missing header is
null. A damaged record ends its file with an error, not with a silent end. Folders are reached through pyarrow's
file systems: local paths, file:, hdfs:, s3: and gs:.
"""

from __future__ import annotations

import datetime as dt
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from rillwork.llm.shared import with_answers, written

ROLL_BYTES = 64 << 20
PARTITION_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
HEAD_BYTES = 4096
#: Blocks of 4 KB of the filter that tells pages from revisits (32 MB), and bits for a page.
FILTER_BLOCKS, FILTER_BITS = 8192, 4
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The columns of a record. `headers` has all named fields; the others repeat the usual ones.
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
#: Columns of what is written: a null payload makes a revisit, which needs refers_to.
WRITE_SCHEMA = "record_id string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, payload binary"
#: Header of each column that a predicate may be pushed down on.
FIELD_OF = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "X-Payload-Length"}


def file_system(path: str):
    """pyarrow's file system and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field `sl` holds its own length and the record's."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\x00\xff"
    extra = 12
    total = len(head) + 2 + extra + len(body) + 8
    return head + struct.pack("<H2sHII", extra, b"sl", 8, total, len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def page_record(row: dict) -> bytes:
    """A response with its payload, or a revisit, which has HTTP headers alone."""
    payload = row["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    uri = row["target_uri"]
    fields = {
        "WARC-Type": "response" if payload is not None else "revisit",
        "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Target-URI": None if uri is None else " ".join(uri.split()),
        "WARC-Date": row["date"],
        "WARC-Payload-Digest": row["payload_digest"],
        "WARC-Profile": None if payload is not None else REVISIT_PROFILE,
        "WARC-Refers-To": None if row["refers_to"] is None else f"<{row['refers_to']}>",
        "X-Payload-Length": str(row["payload_length"]),
        "Content-Type": "application/http; msgtype=response",
    }
    return record(fields, http + (payload or b""))


class Written(WriterCommitMessage):
    """The files of a task."""

    def __init__(self, files: list[str]) -> None:
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Writes under temporary names; commit gives the files of tasks that ended their own names, abort removes them."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            payloads = batch.column("payload")
            for i, row in enumerate(batch.drop_columns(["payload"]).to_pylist()):
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{path}/_{files[-1]}", compression=None), 0
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "Content-Type": "application/warc-fields"}
                    out.write(member(record(info, b"format: WARC File Format 1.1\r\n")))
                data = member(page_record(row | {"payload": payloads[i].as_py()}))
                out.write(data)
                size += len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        for m in messages:
            for f in m.files if m else []:
                fs.move(f"{path}/_{f}", f"{path}/{f}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f"{path}/_{f}")


def parse_head(data: bytes) -> dict[str, str]:
    """Named fields of a record's header, by lower-case name."""
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


class Files(InputPartition):
    """Files that one task reads."""

    def __init__(self, files: list[str]) -> None:
        self.files = files


def _value(fields: dict[str, str], column: str):
    value = fields.get(FIELD_OF[column].lower())
    if value is None:
        return None
    if column == "payload_length":
        return int(value) if value.isdigit() else None
    return value[1:-1] if column in ("record_id", "refers_to") and value.startswith("<") and value.endswith(">") else value


def wanted(fields: dict[str, str], tests: list[tuple[str, str, object]]) -> bool:
    """Whether a header passes all pushed predicates; null passes none."""
    for column, kind, against in tests:
        value = _value(fields, column)
        if value is None:
            return False
        ok = {"eq": lambda v, a: v == a, "in": lambda v, a: v in a, "prefix": lambda v, a: v.startswith(a), "some": lambda *_: True, "gt": lambda v, a: v > a, "ge": lambda v, a: v >= a, "lt": lambda v, a: v < a, "le": lambda v, a: v <= a}[kind]
        if not ok(value, against):
            return False
    return True


class Members:
    """Steps through the gzip members of a file: the head of a record first, the rest only on demand."""

    def __init__(self, source) -> None:
        self.source, self.held, self.base = source, b"", 0

    def _need(self, n: int) -> bool:
        """Hold n bytes from the base on, if the file has them."""
        while len(self.held) - self.base < n:
            more = self.source.read(max(1 << 20, n))
            if not more:
                return False
            self.held, self.base = self.held[self.base :] + more, 0
        return True

    def records(self, tests: list[tuple[str, str, object]], payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """(fields, block) of the wanted records; the block is None without payload."""
        while self._need(18):
            self.at, skip = 0, None
            if self.held[self.base : self.base + 2] != b"\x1f\x8b":
                raise ValueError("not a gzip member")
            if self.held[self.base + 3] & 4 and self.held[self.base + 12 : self.base + 14] == b"sl":
                if not self._need(24):
                    raise ValueError("a gzip member is cut off")
                (skip,) = struct.unpack_from("<I", self.held, self.base + 16)
            self.z = zlib.decompressobj(31)
            plain = b""
            while b"\r\n\r\n" not in plain:
                more = self._inflate(HEAD_BYTES)
                if not more:
                    raise ValueError("a record ends within its header")
                plain += more
            head, _, rest = plain.partition(b"\r\n\r\n")
            fields = parse_head(head)
            take = wanted(fields, tests)
            length = int(fields.get("content-length", 0))
            block = None
            if take and payload:
                parts, got = [rest], len(rest)
                while got < length and (more := self._inflate(1 << 20)):
                    parts.append(more)
                    got += len(more)
                block = b"".join(parts)[:length]
                if len(block) < length:
                    raise ValueError("a record is cut off")
            self._leave(skip)
            if take:
                yield fields, block

    def _inflate(self, most: int) -> bytes:
        """The next plain bytes of the member, at most so many; none at its end."""
        while not self.z.eof:
            data = self.z.unconsumed_tail
            if not data:
                if not self._need(self.at + 1):
                    raise ValueError("a gzip member is cut off")
                data = self.held[self.base + self.at : self.base + self.at + (1 << 14)]
                self.at += len(data)
            if out := self.z.decompress(data, most):
                return out
        return b""

    def _leave(self, skip: int | None) -> None:
        """Go to the next member: by the stored length, or by inflating what is left."""
        if skip is not None:
            if not self._need(skip):
                raise ValueError("a gzip member is cut off")
            self.base += skip
            return
        while self._inflate(1 << 20):
            pass
        self.base += self.at - len(self.z.unused_data)


class WarcReader(DataSourceReader):
    """Plans files into partitions and keeps the pushed predicates."""

    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "prefix", IsNotNull: "some", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in kinds and column in FIELD_OF:
                self.tests.append((column, kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs as pafs

        fs, path = file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(".warc.gz") and f.base_name[0] not in "._")
        out, held = [Files([])], 0
        for name, size in files:
            if out[-1].files and held + size > PARTITION_BYTES:
                out.append(Files([]))
                held = 0
            out[-1].files.append(name)
            held += size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        names = ["record_type", "record_id", "target_uri", "date", "payload_digest", "payload_length", "refers_to"]
        schema = pa.schema([*((n, pa.int64() if n == "payload_length" else pa.string()) for n in names), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for name in partition.files:
            with fs.open_input_stream(name, compression=None) as source:
                for fields, block in Members(source).records(self.tests, self.payload):
                    body = None
                    if block is not None and fields.get("warc-type") != "revisit":
                        http = fields.get("content-type", "").startswith("application/http")
                        body = block.partition(b"\r\n\r\n")[2] if http else block
                    rows.append((*(_value(fields, n) for n in names), list(fields.items()), body))
                    held += len(body or b"") + 500
                    if held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class Warc(DataSource):
    """format("rillwork_warc"): options path, and payload=false to read headers alone."""

    @classmethod
    def name(cls) -> str:
        return "rillwork_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are written to a new folder, with mode append")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let Spark push predicates to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below a folder."""
    register(spark)
    return spark.read.format("rillwork_warc").option("payload", str(payload).lower()).load(path)


def write_warc(rows: DataFrame, path: str) -> None:
    """Write rows of WRITE_SCHEMA to a folder."""
    register(rows.sparkSession)
    rows.select(*(x.split()[0] for x in WRITE_SCHEMA.split(", "))).write.format("rillwork_warc").mode("append").save(path)


def record_id(key: Column) -> Column:
    """A record id that holds the page's key."""
    return F.concat(F.lit("urn:page:"), key.cast("string"))


def _place(blocks: int) -> Column:
    """The block of a page's key in a filter."""
    return F.pmod(F.xxhash64("digest", "k"), F.lit(blocks))


def _bits() -> list[Column]:
    """The bits of a page's key in its block."""
    h = F.xxhash64("k", "digest")
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND((1 << 15) - 1) for i in range(FILTER_BITS)]


def marks(keys: DataFrame, blocks: int) -> DataFrame:
    """A filter that has all of some keys (k, digest), and few others: a row `block`, `bits` of 4 KB for each block."""
    return keys.select(_place(blocks).alias("block"), F.explode(F.array(*_bits())).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def with_marks(rows: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """rows (with k and digest) and whether the filter has their key: `marked`. The table is broadcast, as its size is bounded."""
    some = table.select(F.col("block").alias("block__"), F.col("bits").alias("bits__"))
    byte = lambda bit: F.conv(F.hex(F.substring("bits__", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hits = [F.getbit(byte(bit), bit.bitwiseAND(7).cast("int")) == 1 for bit in _bits()]
    found = rows.join(F.broadcast(some), F.col("block__") == _place(blocks), "left")
    return found.withColumn("marked", F.coalesce(reduce(and_, hits), F.lit(False))).drop("block__", "bits__")


def page_records(pages: DataFrame, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = 200_000, filter_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """Rows to write for pages. Of equal payloads of at least least_bytes, that with the largest id is the response
    and the others are revisits of it; rows that repeat the id and payload of a response are responses too. A page with a
    null id is a revisit where one with an id has its payload, and pages with null ids alone are all responses.

    Groups of copies are found by an aggregation of digests; its result has a row for each group of two or more. A small one
    is broadcast to the pages. Of a larger one, pages and groups meet without the payloads: this gives the revisits, whose
    records have none. A filter of fixed size then tells most responses from them where the pages are read, and the pages
    that it takes for revisits, although they aren't, are found without payloads again. So payloads aren't shuffled but for
    these, if they are too many to be broadcast.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("k"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.select("k", "target_uri", "payload", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("payload_length"))
    copies = rows.where(F.col("payload_length") >= least_bytes).groupBy("digest").agg(F.max("k").alias("response"), F.count("*").alias("n")).where("n > 1")
    copies = written(copies, "copies")
    revisit = F.col("response").isNotNull() & ~F.col("k").eqNullSafe(F.col("response"))
    if copies.count() <= broadcast_rows:
        records = rows.join(F.broadcast(copies.drop("n")), "digest", "left").withColumn("payload", F.when(~revisit, F.col("payload"))).withColumn("response", F.when(revisit, F.col("response")))
    else:
        narrow = written(rows.where(F.col("payload_length") >= least_bytes).drop("payload"), "payload-digests")
        again = written(with_answers(narrow, copies, ["digest"], n="n").where(revisit), "revisits")
        table = written(marks(again.select("k", "digest").distinct(), filter_blocks), "revisit-marks")
        is_key = lambda other: F.col("k").eqNullSafe(other["k_"]) & (F.col("digest") == other["digest_"])
        gone = again.select(F.col("k").alias("k_"), F.col("digest").alias("digest_")).distinct()
        doubtful = with_marks(narrow.select("k", "digest").distinct(), table, filter_blocks).where("marked")
        kept = written(doubtful.join(gone, is_key(gone), "left_anti").select(F.col("k").alias("k_"), F.col("digest").alias("digest_")), "kept")
        kept = F.broadcast(kept) if kept.count() <= broadcast_rows else kept
        large = with_marks(rows.where(F.col("payload_length") >= least_bytes), table, filter_blocks)
        first = rows.where(F.col("payload_length") < least_bytes).unionByName(large.where("not marked").drop("marked"))
        first = first.unionByName(large.where("marked").drop("marked").join(kept, is_key(kept), "left_semi"))
        none = F.lit(None).cast(again.schema["response"].dataType)
        records = first.withColumn("response", none).unionByName(again.withColumn("payload", F.lit(None).cast("binary")))
    return records.select(
        record_id(F.coalesce(F.col("k").cast("string"), F.lit("null"))).alias("record_id"), "target_uri", F.lit(date).alias("date"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"), "payload_length",
        F.when(F.col("response").isNotNull(), record_id(F.col("response"))).alias("refers_to"), "payload",
    )
