"""TIFF pages, WARC archives, sentence pieces, packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rillwork.llm import packing, pieces, tiff, warc
from rillwork.llm.queries import end_tokenizer


def some_bytes(rng, n):
    return bytes(rng.choice((0, 0, 0, 65, rng.randrange(256))) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 127, 128, 129, 300, 5000])
def test_pack_bits_and_lzw_round_trip(n):
    rng = random.Random(n)
    for raw in (some_bytes(rng, n), bytes(n), bytes(rng.randrange(256) for _ in range(n))):
        assert tiff.unpack_bits(tiff.pack_bits(raw), n) == raw
        assert tiff.lzw_unpack(tiff.lzw_pack(raw), n) == raw


def test_lzw_through_table_resets():
    raw = bytes(np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8))
    assert tiff.lzw_unpack(tiff.lzw_pack(raw), len(raw)) == raw


def test_known_streams():
    # the example of the PackBits description, and a first LZW code of 9 bits that clears the table
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.lzw_pack(b"\x07\x07\x07\x08\x08\x07\x07\x06\x06")[:2] == bytes([0x80, 0x01])


@pytest.mark.parametrize("compression", [1, 5, 8, 32946, 32773])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(compression, tile, order):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (h, w, d), dtype=np.uint8) for h, w, d in ((1, 1, 1), (50, 37, 3), (33, 64, 1))]
    for predictor in (1, 2):
        pages = list(tiff.read_tiff(tiff.write_tiff(images, compression, predictor, tile, strip_rows=7, order=order)))
        assert [p.error for p in pages] == [None] * 3
        assert all((p.pixels == i).all() for p, i in zip(pages, images, strict=True))


def test_bad_media_are_rows_with_errors(spark):
    good = tiff.write_tiff([np.ones((2, 3), np.uint8), np.zeros((1, 5), np.uint8)])
    rows = [(1, b"no tiff"), (2, b""), (3, None), (4, good), (5, good[:-20]), (5, good[:8])]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "media_id long, media binary"), feature=True).collect()
    assert sorted((r.media_id, r.page, r.error is None) for r in got)[:2] == [(1, 0, False), (2, 0, False)]
    assert [(r.page, r.height, r.width, bytes(r.samples)) for r in got if r.media_id == 4] == [(0, 2, 3, b"\1" * 6), (1, 1, 5, b"\0" * 5)]
    assert all(r.error for r in got if r.media_id == 5 and r.samples is None)
    loop = bytearray(good)
    loop[-4:] = good[4:8]
    assert any(p.error for p in tiff.read_tiff(bytes(loop)))


def entry_at(data, tag):
    """Where a directory's entry for a tag begins, in a file of one page."""
    import struct

    (at,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, at)
    return next(at + 2 + 12 * k for k in range(n) if struct.unpack_from("<H", data, at + 2 + 12 * k)[0] == tag)


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
def test_damaged_numbers_make_errors_not_crashes(spark, compression):
    import struct

    good = tiff.write_tiff([np.arange(600, dtype=np.uint8).reshape(20, 30)], compression)
    rows = [(0, good)]
    for tag in (tiff.WIDTH, tiff.LENGTH, tiff.SAMPLES, tiff.ROWS_PER_STRIP, tiff.STRIP_BYTES, tiff.STRIP_OFFSETS, tiff.BITS, tiff.COMPRESSION):
        for count, value in ((1, 0), (1, 0xFFFFFFFF), (1, 0x7FFFFFFF), (0, 1), (0xFFFFFFFF, 8)):
            bad = bytearray(good)
            struct.pack_into("<II", bad, entry_at(good, tag) + 4, count, value)
            rows.append((len(rows), bytes(bad)))
    got = tiff.tiff_pages(spark.createDataFrame(rows, "media_id long, media binary"), feature=True).collect()
    assert {r.media_id for r in got} == set(range(len(rows))) and all((r.error is None) != (r.samples is None) for r in got)
    assert [r.error for r in got if r.media_id == 0] == [None]


def test_any_damage_makes_a_row(spark):
    rng = random.Random(2)
    good = [tiff.write_tiff([np.arange(5000, dtype=np.uint16).astype(np.uint8).reshape(50, 100)], c, 2, t) for c in (1, 5, 8) for t in (None, (16, 32))]
    for _ in range(600):
        data = bytearray(rng.choice(good))
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(data) - 160, len(data)) if rng.random() < 0.8 else rng.randrange(8)
            data[at] = rng.choice((0, 1, 255, rng.randrange(256)))
        pages = list(tiff.read_tiff(bytes(data)))
        tiff_rows = [tiff._values(k, p, True) for k, p in enumerate(pages)]
        assert all((p.pixels is None) == (p.error is not None) for p in pages) and len(tiff_rows) == len(pages)


def test_repeated_media_and_no_media(spark):
    good = tiff.write_tiff([np.ones((2, 3), np.uint8)])
    got = tiff.tiff_pages(spark.createDataFrame([(1, good), (1, good), (None, good)], "media_id long, media binary")).collect()
    assert len(got) == 3 and len({bytes(r.samples) for r in got}) == 1
    assert tiff.tiff_pages(spark.createDataFrame([], "media_id long, media binary")).count() == 0


def test_query_columns_by_definition(spark, make_docs, tmp_path):
    """op10: every column from the text or the stored file alone."""
    import hashlib

    from rillwork.llm import queries

    texts = ["", None, "a", "\u00e9" * 40, "x" * 64, "word " * 50_000, "word " * 50_000]
    make_docs(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op10_tiff(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = tiff.store_image(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        level = np.frombuffer(payload, np.uint8).astype(float)
        share = np.array([(level == v).mean() for v in set(level)])
        step = np.abs(np.diff(level.reshape(-1, 64), axis=1)).mean()
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        values = [float(x.split("=")[1]) for x in r.feature.split(";")]
        assert values == pytest.approx([level.mean(), level.std(), -(share * np.log2(share)).sum(), step], abs=2e-4)
    assert rows[5][1:] == rows[6][1:]


def test_texts_come_back_from_their_images(spark, make_docs):
    texts = ["", None, "a", "é" * 40, "x" * 64, "word " * 5000, "\0\0"]
    stored = tiff.stored_texts(make_docs(list(enumerate(texts))))
    got = {r.doc_id: (r.n_bytes, bytes(r.samples)) for r in tiff.tiff_pages(stored, keep=("doc_id", "n_bytes")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[i][0] == len(raw) and got[i][1].startswith(raw) and len(got[i][1]) % 64 == 0 < len(got[i][1]) and not got[i][1][len(raw) :].strip(b"\0")


PAGES = [(1, "http://a/1", "x" * 1500), (7, "http://a/2", "x" * 1500), (4, "http://b/3", "x" * 1500), (2, "http://b/4", "short"), (3, "http://b/5", "short"), (5, None, None), (6, "http://c/ü", "é" * 600)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc") / "out")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_warc(warc.page_records(pages), folder)
    return folder


def test_largest_id_is_the_response(spark, archive):
    got = {r.record_id: (r.record_type, r.refers_to, r.payload_length) for r in warc.read_warc(spark, archive).where("record_type <> 'warcinfo'").collect()}
    assert got["urn:page:7"] == ("response", None, 1500) and got["urn:page:1"] == ("revisit", "urn:page:7", 1500) == got["urn:page:4"]
    assert got["urn:page:2"][0] == got["urn:page:3"][0] == "response" and got["urn:page:5"] == ("response", None, 0) and got["urn:page:6"][2] == 1200


def test_payloads_come_back(spark, archive):
    got = {r.record_id: r.payload for r in warc.read_warc(spark, archive).where("record_type = 'response'").collect()}
    assert {k: bytes(v).decode() for k, v in got.items()} == {f"urn:page:{i}": h or "" for i, _, h in PAGES if i not in (1, 4)}
    assert all(r.payload is None for r in warc.read_warc(spark, archive, payload=False).collect())


@pytest.mark.parametrize("test,want", [("record_type = 'revisit'", {1, 4}), ("record_type in ('revisit', 'response') and payload_length > 1300", {1, 4, 7}), ("target_uri like 'http://b/%' and record_type = 'response'", {2, 3}), ("refers_to = 'urn:page:7'", {1, 4}), ("payload_length <= 5 and record_type <> 'warcinfo'", {2, 3, 5})])
def test_predicates(spark, archive, test, want):
    assert {int(r.record_id.rpartition(":")[2]) for r in warc.read_warc(spark, archive).where(test).collect()} == want


def test_predicates_are_pushed_and_payloads_skipped(archive):
    reader = warc.WarcReader(archive, True)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")]))
    assert len(left) == 1 and reader.tests == [("record_type", "eq", "revisit")]
    asked = []

    class Counting(warc.Members):
        def _inflate(self, most):
            out = super()._inflate(most)
            asked.append(len(out))
            return out

    for part in reader.partitions():
        for name in part.files:
            with open(name, "rb") as f:
                assert all(x["warc-type"] == "revisit" for x, _ in Counting(f).records(reader.tests, True))
    assert sum(asked) < 8 * (warc.HEAD_BYTES + 500)


def test_members_without_lengths(tmp_path):
    import gzip

    recs = [warc.record({"WARC-Type": t, "WARC-Record-ID": f"<{i}>"}, bytes(20_000)) for i, t in enumerate(("a", "b", "a"))]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
    with open(tmp_path / "x.warc.gz", "rb") as f:
        got = list(warc.Members(f).records([("record_type", "eq", "a")], True))
    assert [x["warc-record-id"] for x, _ in got] == ["<0>", "<2>"] and all(b == bytes(20_000) for _, b in got)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(recs[0])[:-30])
    with open(tmp_path / "x.warc.gz", "rb") as f, pytest.raises(ValueError):
        list(warc.Members(f).records([], True))


ODD_PAGES = [*PAGES, (None, "http://d/1", "x" * 1500), (None, "http://d/2", "n" * 1200), (None, "http://d/2", "n" * 1200), (8, None, "y" * 1100), (8, None, "y" * 1100), (3, "http://e", "y" * 1100), (9, "", "short"), (9, "", "short"), (7, "http://a/2", "z" * 400_000)]
ODD_PAGES += [(1000 + i, f"http://f/{i}", f"{i % 40:04d}" * 300) for i in range(160)]


def plain_records(pages, least=1000):
    held = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= least:
            held.setdefault(h, set()).add(i)
    last = {h: max((i for i in ids if i is not None), default=None) for h, ids in held.items()}
    again = lambda i, h: h in last and last[h] is not None and i != last[h]
    return sorted(("null" if i is None else str(i), len((h or "").encode()), f"urn:page:{last[h]}" if again(i, h) else "", "" if again(i, h) else h or "") for i, _, h in pages)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 3, "filter_blocks": 1}, {"broadcast_rows": 0, "filter_blocks": 2}])
def test_records_of_odd_pages_by_each_way(spark, tmp_path, options, monkeypatch):
    if options.get("filter_blocks") == 2:  # a filter that takes every page for a revisit
        monkeypatch.setattr(warc, "_bits", lambda: [F.lit(0).cast("long")])
    pages = spark.createDataFrame([(*p, "clash", b"clash") for p in ODD_PAGES], "page_id long, url string, html string, digest string, payload binary").repartition(3)
    warc.write_warc(warc.page_records(pages, **options), str(tmp_path / "w"))
    rows = warc.read_warc(spark, str(tmp_path / "w")).where("record_type <> 'warcinfo'").collect()
    assert sorted((r.record_id.rpartition(":")[2], r.payload_length, r.refers_to or "", bytes(r.payload or b"").decode()) for r in rows) == plain_records(ODD_PAGES)
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in rows)


def test_filter_has_its_keys_and_few_others(spark):
    keys = spark.range(40_000).select((F.col("id") * 3).alias("k"), F.sha1(F.col("id").cast("string").cast("binary")).alias("digest"))
    got = warc.with_marks(keys.withColumn("own", F.col("k") % 2 == 0), warc.marks(keys.where("k % 2 = 0"), 10), 10)
    n = {r.own: r for r in got.groupBy("own").agg(F.count_if("marked").alias("marked"), F.count("*").alias("n")).collect()}
    assert n[True].marked == n[True].n == 20_000 and n[False].marked < 0.02 * n[False].n


def test_empty_archive(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(warc.page_records(none), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).where("record_type = 'response'").count() == 0


MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "Hello  world", " lead", "trail ", "   ", "héllo 你好 🙂", "\n\ta b", "a" * 500, "12345 678", "The and attion to thanedble the, anea."]


def best_by_hand(table, text):
    index = {p: i for i, p in enumerate(table.pieces) if table.types[i] in (pieces.NORMAL, pieces.USER)}
    w = (" " + text).replace(" ", pieces.SPACE) if text else ""
    best, back = [0.0] + [float("-inf")] * len(w), [None] * (len(w) + 1)
    for e in range(1, len(w) + 1):
        for b in range(max(0, e - table.longest), e):
            i = index.get(w[b:e])
            s = table.scores[i] if i is not None else table.unknown if e - b == 1 else None
            if s is not None and best[b] + s > best[e]:
                best[e], back[e] = best[b] + s, (b, i)
    out, e = [], len(w)
    while e:
        b, i = back[e]
        out = ([i] if i is not None else [table.bytes[x] for x in w[b:e].encode()]) + out
        e = b
    return out


def test_batched_search_equals_plain_search():
    table = pieces.PieceTable.load(MODEL)
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choice("the anrio e  é\n.你") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    offsets, ids = table.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [best_by_hand(table, t) for t in texts]
    assert table.decode(offsets, ids) == texts


@pytest.mark.parametrize("few", [0, 16])
def test_long_unsegmented_text_is_searched_in_time(monkeypatch, few):
    import time

    monkeypatch.setattr(pieces, "FEW_WORDS", few)
    rng = random.Random(3)
    table = pieces.PieceTable.load(MODEL)
    texts = ["".join(rng.choice("theanrio\u00e9\u4f60") for _ in range(n)) for n in (65, 300, 300)]
    offsets, ids = table.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [best_by_hand(table, t) for t in texts]
    if few:
        began = time.time()
        table.encode(["".join(rng.choice("theanrio") for _ in range(20_000))])
        assert time.time() - began < 2


def test_words_whose_keys_collide_are_still_told_apart(monkeypatch):
    table = pieces.PieceTable.load(MODEL)
    want = table.encode(TEXTS)
    real = np.unique
    monkeypatch.setattr(pieces.np, "unique", lambda x, **k: real(x % np.uint64(2), **k) if k.get("return_index") else real(x, **k))
    got = table.encode(TEXTS)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_library_reads_our_ids():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = pieces.PieceTable.load(MODEL)
    offsets, ids = table.encode(TEXTS)
    assert [lib.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)] == TEXTS


def test_piece_columns(spark, make_docs):
    docs = make_docs([*enumerate(TEXTS), (50, None), (3, "trail ")])
    ids = pieces.encoded(docs, MODEL)
    back = {(r.doc_id, r.text) for r in pieces.decoded(ids, MODEL).collect()}
    assert back == {*enumerate(TEXTS), (50, None)}
    assert pieces.encoded(make_docs([]), MODEL).count() == 0


def first_fit_plain(lengths, capacity):
    free, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((k for k, f in enumerate(free) if f >= lengths[i]), None)
        if b is None:
            free.append(capacity)
            b = len(free) - 1
        out[i] = (b, capacity - free[b])
        free[b] -= lengths[i]
    return out


def test_tree_finds_the_first_bin():
    rng = random.Random(6)
    for n in (1, 2, 50, 333):
        lengths = np.array([rng.randint(1, 100) for _ in range(n)])
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets, strict=True))} == first_fit_plain(lengths.tolist(), 100)


def test_packed_sequences(spark, make_docs):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = [" ".join(rng.choice(("lorem", "ipsum", "Dolor.", "élan", "<|endoftext|>", "42")) for _ in range(rng.choice((0, 3, 40, 900, 2500)))) for _ in range(60)] + [None, ""]
    rows = packing.packed_documents(make_docs([*enumerate(texts), (0, texts[0]), (None, "x")]), end_tokenizer()).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        if i == 0:
            assert sum(r.length for r in mine) == 2 * len(ids)
            continue
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))] and sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in mine)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) * 2048 < 1.2 * sum(r.length for r in rows) + 2048
    assert packing.packed_documents(make_docs([]), end_tokenizer()).count() == 0
