"""TIFF media columns: one row for each page of each file.

The reader walks the image directories, decodes PackBits, LZW or deflate strips and tiles, undoes predictors and
gives the samples of a page. It takes classic TIFF in either byte order, 8-bit samples, one plane, any number of
samples a pixel. Damaged or unsupported pages don't fail the job: their row has an `error` and no samples.

Cases: null media give no rows; media that are no TIFF give one row with an error; numbers in a directory that can't be
(zero, more samples than the stored bytes can hold) make the page's error, and those beyond an int come out null; a null
id is kept; very long texts are stored whole; equal rows give equal rows; an empty table gives an empty table. Only the
id and media columns are used, so other names can't clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.shared import CHUNK_BYTES, map_texts

# Fixed values of the TIFF 6.0 specification: tags, compression schemes, bytes of each field type.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I"}
CLEAR, END = 256, 257
#: Samples that a stored byte can stand for at most, by scheme: no page is larger than its strips or tiles allow.
GROWTH = {NONE: 1, LZW: 2600, ADOBE_DEFLATE: 1040, DEFLATE: 1040, PACKBITS: 64}
#: Larger pages have an error: a column holds no more bytes by far.
MOST_SAMPLES = 1 << 29

PAGES = "page int, width int, height int, samples_per_pixel int, compression int, predictor int, tiled boolean, samples binary, error string"


def pack_bits(raw: bytes) -> bytes:
    """PackBits: runs of three or more become a count and a byte, the rest literal stretches of at most 128."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return b""
    cuts = np.flatnonzero(np.diff(data)) + 1
    starts = np.concatenate([[0], cuts])
    lengths = np.diff(np.concatenate([starts, [len(data)]]))
    out, plain = bytearray(), 0
    long_runs = np.flatnonzero(lengths >= 3)

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            j = min(b, i + 128)
            out.append(j - i - 1)
            out.extend(raw[i:j])

    for k in long_runs:
        s, n = int(starts[k]), int(lengths[k])
        literal(plain, s)
        plain = s + n
        while n > 1:
            m = min(n, 128)
            out += bytes([257 - m, raw[s]])
            n -= m
        if n:
            plain -= 1
    literal(plain, len(raw))
    return bytes(out)


def unpack_bits(data: bytes, most: int) -> bytes:
    """Undo PackBits; reading stops at `most` bytes."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        else:
            if c > 128 and i + 1 < n:
                out += data[i + 1 : i + 2] * (257 - c)
            i += 2 if c > 128 else 1
    return bytes(out[:most])


def lzw_pack(raw: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes widen one code early."""
    out, acc, bits, width = bytearray(), CLEAR, 9, 9
    table: dict[tuple[int, int], int] = {}
    new, prefix = 258, -1

    def drain() -> None:
        nonlocal acc, bits
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
            acc &= (1 << bits) - 1

    drain()
    for b in raw:
        if prefix < 0:
            prefix = b
            continue
        known = table.get((prefix, b))
        if known is not None:
            prefix = known
            continue
        acc, bits = (acc << width) | prefix, bits + width
        drain()
        table[prefix, b] = new
        new += 1
        prefix = b
        if new == 4095:
            acc, bits = (acc << width) | CLEAR, bits + width
            drain()
            table.clear()
            new, width = 258, 9
        elif new >= 1 << width:
            width += 1
    if prefix >= 0:
        acc, bits = (acc << width) | prefix, bits + width
        drain()
        new += 1
        if new >= 1 << width and width < 12:
            width += 1
    acc, bits = (acc << width) | END, bits + width
    drain()
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def lzw_unpack(data: bytes, most: int) -> bytes:
    """Undo TIFF's LZW; reading stops at the end code or at `most` bytes."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, size = list(first), [], 0
    acc = bits = 0
    width, prior = 9, None
    for byte in data:
        acc, bits = ((acc << 8) | byte), bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == END or size >= most:
            break
        if code == CLEAR:
            table, width, prior = list(first), 9, None
            continue
        if prior is None:
            got = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            got = table[code] if code < len(table) else prior + prior[:1]
            table.append(prior + got[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(got)
        size += len(got)
        prior = got
    return b"".join(out)[:most]


def decoded(data: bytes, compression: int, most: int) -> bytes:
    """One strip or tile, at most `most` bytes."""
    if compression == NONE:
        return data[:most]
    if compression == LZW:
        return lzw_unpack(data, most)
    if compression in (ADOBE_DEFLATE, DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if compression == PACKBITS:
        return unpack_bits(data, most)
    raise ValueError(f"compression {compression} is not supported")


def encoded(data: bytes, compression: int, level: int = 6) -> bytes:
    """The inverse of decoded()."""
    if compression == NONE:
        return data
    if compression == LZW:
        return lzw_pack(data)
    if compression in (ADOBE_DEFLATE, DEFLATE):
        return zlib.compress(data, level)
    if compression == PACKBITS:
        return pack_bits(data)
    raise ValueError(f"compression {compression} is not supported")


@dataclass
class Page:
    """A page's directory and, once read, its samples as (height, width, samples a pixel)."""

    tags: dict[int, tuple[int, ...]] = field(default_factory=dict)
    pixels: np.ndarray | None = None
    error: str | None = None

    def tag(self, key: int, default: int | None = None) -> int:
        if key in self.tags:
            return self.tags[key][0]
        if default is None:
            raise ValueError(f"tag {key} is missing")
        return default


def directories(data: bytes) -> Iterator[Page]:
    """Walk the chain of image directories. A loop in the chain ends the walk with an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        page = Page()
        for k in range(n):
            tag, kind, count, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * k)
            if kind not in TYPE_CODES:
                continue
            nbytes = TYPE_BYTES[kind] * count
            where = at + 10 + 12 * k
            if nbytes > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if not count or where + nbytes > len(data):
                continue  # the tag counts as missing
            page.tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, where)
        yield page
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_page(data: bytes, page: Page) -> np.ndarray:
    """Decode the strips or tiles of a page and undo the predictor."""
    width, height, depth = page.tag(WIDTH), page.tag(LENGTH), page.tag(SAMPLES, 1)
    if set(page.tags.get(BITS, (1,))) != {8}:
        raise ValueError("only 8-bit samples are supported")
    if depth > 1 and page.tag(PLANAR, 1) != 1:
        raise ValueError("only one plane is supported")
    compression, predictor = page.tag(COMPRESSION, 1), page.tag(PREDICTOR, 1)
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not supported")
    tiled = TILE_OFFSETS in page.tags
    tall = min(page.tag(TILE_LENGTH) if tiled else page.tag(ROWS_PER_STRIP, height), height if not tiled else 1 << 30)
    wide = page.tag(TILE_WIDTH) if tiled else width
    offsets = page.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS]
    sizes = page.tags[TILE_BYTES if tiled else STRIP_BYTES]
    if min(width, height, depth, tall, wide) < 1:
        raise ValueError("a width, height or number of samples is 0")
    if compression not in GROWTH:
        raise ValueError(f"compression {compression} is not supported")
    stored = sum(min(n, len(data)) for n in sizes)
    if max(width * height, tall * wide) * depth > min(GROWTH[compression] * stored, MOST_SAMPLES):
        raise ValueError("more samples than the stored bytes can hold")
    across, down = -(-width // wide), -(-height // tall)
    if len(offsets) < across * down or len(sizes) < across * down:
        raise ValueError("strips or tiles are missing")
    out = np.empty((height, width, depth), np.uint8)
    for k in range(across * down):
        y, x = k // across * tall, k % across * wide
        rows = tall if tiled else min(tall, height - y)
        need = rows * wide * depth
        raw = decoded(data[offsets[k] : offsets[k] + sizes[k]], compression, need)
        if len(raw) < need:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(raw, np.uint8).reshape(rows, wide, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        out[y : y + rows, x : x + wide] = block[: height - y, : width - x]
    return out


def read_tiff(data: bytes) -> Iterator[Page]:
    """Every page of a file; what can't be read comes with an error."""
    try:
        for page in directories(data):
            try:
                page.pixels = read_page(data, page)
            except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                page.error = str(e) or type(e).__name__
            yield page
    except (ValueError, struct.error) as e:
        yield Page(error=str(e) or type(e).__name__)


def write_tiff(images: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = 1024, order: str = "<", level: int = 6) -> bytes:
    """A TIFF with a page for each (height, width) or (height, width, samples) array of bytes."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for image in images:
        image = image.reshape(*image.shape[:2], -1)
        height, width, depth = image.shape
        tall, wide = tile or (min(strip_rows, height), width)
        offsets, sizes = [], []
        for y in range(0, height, tall):
            for x in range(0, width, wide):
                block = image[y : y + tall, x : x + wide]
                if tile and block.shape[:2] != (tall, wide):
                    block = np.pad(block, ((0, tall - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, depth), np.uint8))
                raw = encoded(block.tobytes(), compression, level)
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw
        entries = {WIDTH: [width], LENGTH: [height], BITS: [8] * depth, COMPRESSION: [compression], PHOTOMETRIC: [1 if depth < 3 else 2], SAMPLES: [depth], PLANAR: [1], PREDICTOR: [predictor]}
        entries |= {TILE_WIDTH: [wide], TILE_LENGTH: [tall], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [tall], STRIP_BYTES: sizes}
        wheres = {}
        for tag, values in entries.items():
            if 4 * len(values) > 4:
                out += b"\0" * (len(out) % 2)
                wheres[tag] = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values) if tag != BITS else struct.pack(f"{order}{len(values)}H", *values)
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries))
        for tag in sorted(entries):
            values, kind = entries[tag], 3 if tag == BITS else 4
            if tag in wheres and TYPE_BYTES[kind] * len(values) > 4:
                value = struct.pack(order + "I", wheres[tag])
            else:
                value = struct.pack(f"{order}{len(values)}{TYPE_CODES[kind]}", *values).ljust(4, b"\0")
            out += struct.pack(order + "HHI", tag, kind, len(values)) + value
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def tiff_pages(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("media_id",), feature: bool = False) -> DataFrame:
    """One row for each page: the columns of `keep`, then those of PAGES. `samples` are the bytes of the page in row order.

    feature: add a column with image_feature() of the page.
    """
    df = df.where(F.col(media_col).isNotNull()).select(*keep, F.col(media_col))
    kinds = PAGES + ", feature string" * feature
    own = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0
            for i, media in enumerate(batch.column(len(keep))):
                for no, page in enumerate(read_tiff(media.as_py())):
                    rows.append(_values(no, page, feature))
                    at.append(i)
                    held += len(rows[-1][7] or b"") + 100
                    if held > CHUNK_BYTES:
                        yield _paged(batch, at, rows, len(keep), own)
                        at, rows, held = [], [], 0
            if rows:
                yield _paged(batch, at, rows, len(keep), own)

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{schema}, {kinds}")


def _values(no: int, page: Page, feature: bool) -> tuple:
    def get(tag: int, default: int | None = None) -> int | None:
        value = page.tags[tag][0] if tag in page.tags else default
        return value if value is None or value < 1 << 31 else None

    some = page.pixels is not None
    row = (no, get(WIDTH), get(LENGTH), get(SAMPLES, 1), get(COMPRESSION, 1), get(PREDICTOR, 1), TILE_OFFSETS in page.tags, page.pixels.tobytes() if some else None, page.error)
    return (*row, image_feature(page.pixels) if some else None) if feature else row


def _paged(batch: pa.RecordBatch, at: list[int], rows: list[tuple], n: int, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 6 + [pa.bool_(), pa.binary(), pa.string(), pa.string()]
    kept = batch.select(range(n)).take(pa.array(at))
    cols = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds[: len(names)], strict=True)]
    return pa.RecordBatch.from_arrays([*kept.columns, *cols], [*kept.schema.names, *names])


#: A row of samples for stored texts, and the schemes in use. The scheme is a function of the payload alone.
ROW = 64
SCHEMES = (ADOBE_DEFLATE, ADOBE_DEFLATE, ADOBE_DEFLATE, ADOBE_DEFLATE, ADOBE_DEFLATE, ADOBE_DEFLATE, PACKBITS, LZW)


def text_image(text: str | None) -> tuple[int, np.ndarray]:
    """Length of the UTF-8 bytes, and these with zeros up to a positive multiple of 64, as rows of 64 samples."""
    raw = (text or "").encode()
    return len(raw), np.frombuffer(raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\0"), np.uint8).reshape(-1, ROW)


def store_image(image: np.ndarray) -> bytes:
    """A one-page TIFF of the image: strips or tiles, with or without predictor, by a checksum of the samples."""
    pick = zlib.crc32(image.tobytes())
    scheme = SCHEMES[pick % len(SCHEMES)]
    tile = (64, 32) if pick >> 8 & 1 else None
    predictor = 2 if scheme != PACKBITS and pick >> 9 & 1 else 1
    return write_tiff([image], scheme, predictor, tile, level=1)


def image_feature(pixels: np.ndarray) -> str:
    """Mean, spread, entropy in bits and mean step along a row of the samples, as text of fixed form."""
    flat = pixels.reshape(-1)
    share = np.bincount(flat, minlength=256) / len(flat)
    some = share[share > 0]
    level = np.arange(256)
    mean = float(share @ level)
    spread = max(float(share @ (level * level)) - mean * mean, 0.0) ** 0.5
    rows = pixels.reshape(pixels.shape[0], -1)
    step = float(np.abs(np.diff(rows.astype(np.int16), axis=1)).mean()) if rows.shape[1] > 1 else 0.0
    return f"mean={mean:.4f};std={spread:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};step={step:.4f}"


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and `media`, the text's bytes as a TIFF. A null text is an empty one."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def each():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            images = [text_image(x.as_py()) for x in part.column(1)]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in images], pa.int64()), pa.array([store_image(x) for _, x in images], pa.binary())], ["doc_id", "n_bytes", "media"])

        return work

    return map_texts(docs, each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")
