"""Operators on small inputs with results worked out by hand or by a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from rillwork import queries as q
from rillwork.functions import text as tx
from rillwork.functions.vectors import cosine
from rillwork.operators import evaluate, ingest, lifecycle, prepare, prompts, provider, retrieve, score, transform
from rillwork.plans import compose
from rillwork.sources import files
from rillwork.streaming import jobs

SF = "/root/testdata/sf0.001"


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, score double")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_normalise_bounds_and_ties(spark):
    out = got(score.normalize_scores(hits(spark, [(1, 1, 2.0), (1, 2, 4.0), (1, 3, 3.0), (2, 1, 5.0), (3, 1, 7.0), (3, 2, 7.0)])), "query_id", "chunk_id", "score")
    assert out == [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 0.5), (2, 1, 1.0), (3, 1, 1.0), (3, 2, 1.0)]


def test_rrf_of_one_list_is_the_list_and_weights_must_match(spark):
    h = hits(spark, [(1, 1, 2.0), (1, 2, 4.0)])
    assert got(score.rrf_fuse([h]), "chunk_id", "score") == [(1, 2.0), (2, 4.0)]
    with pytest.raises(ValueError):
        score.rrf_fuse([h, h], [1.0])
    with pytest.raises(ValueError):
        score.rrf_fuse([])


def test_rrf_orders_by_summed_reciprocal_ranks(spark):
    a, b = hits(spark, [(1, 1, 9.0), (1, 2, 8.0)]), hits(spark, [(1, 2, 3.0), (1, 3, 2.0)])
    assert got(score.rrf_fuse([a, b]), "chunk_id", "score")[1] == (2, 1.0)


def test_retention_without_access_and_bad_base(spark):
    row = spark.range(1).select(score.retention(F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("long"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("a"), score.retention(F.lit(None).cast("timestamp_ntz"), F.lit(0), F.lit("2024-01-01").cast("timestamp_ntz"), forgotten=True).alias("b")).first()
    assert (row.a, row.b) == (0.0, 1.0)


def test_phrase_needs_order_and_neighbourhood(spark):
    chunks = spark.createDataFrame([(1, 1, "red fox runs"), (2, 2, "fox red runs"), (3, 3, "the red fox and the red fox"), (4, 4, None)], "chunk_id long, document_id long, content string")
    asked = spark.createDataFrame([(1, '"Red fox"'), (2, "  "), (3, "none such")], "query_id long, text string")
    out = retrieve.phrase_topk(asked, chunks, 5)
    assert {(r.query_id, r.chunk_id) for r in out.collect()} == {(1, 1), (1, 3)}
    assert {r.chunk_id for r in retrieve.phrase_topk(asked, chunks, 5, document_id=3).collect()} == {3}


def vector_topk_native(queries, vectors, keep, threshold):
    """By expressions alone, all pairs."""
    pairs = queries.select("query_id", F.col("embedding").alias("q")).crossJoin(vectors.select("chunk_id", "embedding"))
    found = pairs.select("query_id", "chunk_id", F.round(cosine(F.col("q"), F.col("embedding")), 9).alias("score"))
    return score.top_hits(found.where(F.col("score") >= threshold), keep, "query_id")


@pytest.mark.parametrize("matrix", [0, 1 << 22])
def test_vector_search_equals_expressions(spark, monkeypatch, matrix):
    monkeypatch.setattr(retrieve, "MATRIX", matrix)
    monkeypatch.setattr(retrieve, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, [0.0] * 8)] + [(400 + i, [1.0] * 8) for i in range(30)] + [(500, None)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    queries = v.where("chunk_id < 7 or chunk_id > 424").withColumnRenamed("chunk_id", "query_id")
    a = got(retrieve.vector_topk(queries, v, 5, 0.2), "query_id", "chunk_id", "score")
    b = got(vector_topk_native(queries.where("embedding is not null"), v, 10, 0.2), "query_id", "chunk_id", "score")
    assert a == b and all(s >= 0.2 for *_, s in a)


def test_approximate_search_finds_most(spark):
    exact = {(r.query_id, r.chunk_id) for r in q.vector_topk(spark, SF).collect()}
    near = {(r.query_id, r.chunk_id) for r in q.vector_topk_ann(spark, SF).collect()}
    assert len(exact & near) / len(exact) >= 0.9


@pytest.mark.parametrize("seed", range(5))
def test_recursive_pieces_lose_only_separators(seed):
    """Pieces keep the order and all characters but separators, and none is too long that could be cut."""
    rng = random.Random(seed)
    keep = lambda x: "".join(c for c in x if c not in " .,;\n。")
    for _ in range(400):
        text = "".join(rng.choice("ab .,;\n\n。") for _ in range(rng.randint(1, 120)))
        size = rng.randint(3, 30)
        pieces = prepare.split_text(text, size)
        assert keep("".join(pieces)) == keep(text)
        assert all(len(p) <= size or not keep(p) for p in pieces), (text, size, pieces)
        assert len(text) > size or len(pieces) == 1


@pytest.mark.parametrize(
    "text, size, want",
    [
        ("aa\n\nbb\n\ncc", 6, ["aa\n\nbb", "cc"]), ("aa bb cc dd", 5, ["aa bb", "cc dd"]), ("abcdefgh", 3, ["abc", "def", "gh"]), ("one. two. three", 9, ["one. two", " three"]),
        ("x\n\nlong words here\n\ny", 6, ["x", "long", "words", "here", "y"]),
    ],
)
def test_recursive_pieces_by_hand(text, size, want):
    assert prepare.split_text(text, size) == want


def test_text_of_separators_stays_whole():
    assert prepare.split_text("." * 40, 10) == ["." * 40]


def test_recursive_overlap_and_tail(spark):
    docs = spark.createDataFrame([(1, "aaaa bbbb cccc dd"), (2, "  "), (3, None)], "doc_id long, text string")
    out = got(prepare.chunk_recursive(docs, size=9, overlap=3, least=6), "doc_id", "chunk_index", "content")
    assert out == [(1, 0, "aaaa bbbb"), (1, 1, "bbbcccc dd")]
    short = got(prepare.chunk_recursive(docs, size=9, overlap=0, least=8), "content")
    assert short == [("aaaa bbbbcccc dd",)]


@pytest.mark.parametrize("n", [1, 256, 257, 500, 999, 2049, 10241, 30000])
def test_fixed_chunks_cover_the_text(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    rows = prepare.chunk_fixed(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert rows[0].content == text[: len(rows[0].content)] and rows[-1].content == text[-len(rows[-1].content) :]
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    size = n if n <= 256 or n // 10 < 20 else min(n // 10, 1024)
    lap = max(50, min(int(size * 0.1), 200))
    step = size - (lap if lap < size else 0)
    want = [text[i : i + size] for i in range(0, max(n - size, 0) + step, step)][: 1 + -(-max(n - size, 0) // step)]
    if len(want) > 1 and len(want[-1]) < 50:
        want[-2:] = [want[-2] + want[-1]]
    assert [r.content for r in rows] == want


def test_sections_are_cut_to_the_next_heading_of_their_level(spark):
    text = "# A title\nx\n## References\n[1]\n### deep\ny\n## Next\nkept\n# Appendix\nz"
    r = prepare.strip_markdown_sections(spark.createDataFrame([(1, text), (2, "no heads"), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    # the first heading begins with a one-letter word, so it counts as an appendix too and reaches to "# Appendix"
    assert (r[0].filtered_text, r[0].cut_point, r[0].removed_chars) == ("", 0, len(text))
    text = "# Title\nx\n## References\n[1]\n### deep\ny\n## Next\nkept\n# Appendix\nz"
    r = prepare.strip_markdown_sections(spark.createDataFrame([(1, text), (2, "no heads")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].filtered_text == "# Title\nx\n## Next\nkept" and r[0].cut_point == 10
    assert (r[1].filtered_text, r[1].cut_point, r[1].removed_chars) == ("no heads", None, 0)


def test_tail_is_cut_only_where_citations_confirm(spark):
    cite = "[1] Name, A. (2020). Journal of x."
    body = "\n\n".join(["word " * 30] * 4)
    docs = spark.createDataFrame([(1, f"{body}\n\nReferences\n\n{cite}\n\n{cite}"), (2, f"{body}\n\nReferences\n\nplain\n\nplain"), (3, body + "\n\n" + "\n\n".join([cite] * 6)), (4, "")], "doc_id long, text string")
    r = {x.doc_id: x for x in prepare.content_filter(docs).collect()}
    assert r[1].cut_point == len(body) + 2 and r[2].cut_point is None and r[3].cut_point == len(body) + 2 and r[4].filtered_text == ""


def test_responses_are_parsed_strictly(spark):
    rows = spark.createDataFrame([('["a", " b ", ""]',), ('```json\n["c"]\n```',), ('[1, "a"]',), ("[",), ("{}",), (None,)], "r string")
    assert [x[0] for x in rows.select(tx.parse_strings(F.col("r"))).collect()] == [["a", "b"], ["c"], [], [], [], []]


def test_rewrites_fall_back_to_the_query(spark):
    qs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "query_id long, text string")
    rs = spark.createDataFrame([(1, " better "), (2, "b"), (3, "  ")], "query_id long, response string")
    assert got(transform.rewrite(qs, rs), "query_id", "text") == [(1, "better"), (2, "b"), (3, "c"), (4, "d")]


def test_a_failing_row_does_not_fail_the_batch(spark):
    def model(ps):
        if any("bad" in p for p in ps):
            raise RuntimeError("no")
        return [p.upper() for p in ps]

    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id long, prompt string").coalesce(1)
    out = {r.id: (r.response, r.error) for r in provider.complete(rows, model).collect()}
    assert out == {1: ("OK", None), 2: (None, "RuntimeError: no"), 3: (None, None)}


def test_quotas_equal_the_sequential_loop(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {i: rng.randint(1, 30) for i in range(rng.randint(2, 25))}
        total = rng.randint(3, 40)
        rows = [(c, d) for d, n in sizes.items() for c in range(n)]
        df = spark.createDataFrame([(i, d) for i, (_, d) in enumerate(rows)], "chunk_id long, document_id long")
        n_all = sum(sizes.values())
        want = dict(sizes) if n_all <= total else {d: max(1, round(total * n / n_all)) for d, n in sizes.items()}
        while n_all > total and sum(want.values()) > total:
            want[max(want, key=want.get)] -= 1
        assert {r.document_id: r.quota for r in evaluate.sample_quota(df, total).collect()} == want


def test_metrics_by_hand(spark):
    qs = spark.createDataFrame([(1,), (2,)], "query_id long")
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, chunk_id long, rank long")
    truth = spark.createDataFrame([(1, 11), (1, 99)], "query_id long, chunk_id long")
    r = {x.query_id: x for x in evaluate.eval_metrics(qs, ranked, truth, 3).collect()}
    assert (r[1].reciprocal_rank, r[1].found_at_k) == (0.5, 0.5) and r[1].ndcg_at_k == pytest.approx(0.63093 / 1.63093, abs=1e-4)
    assert (r[2].reciprocal_rank, r[2].ndcg_at_k, r[2].found_at_k) == (0.0, 0.0, 0.0)
    assert evaluate.eval_report(evaluate.eval_metrics(qs, ranked, truth, 0), 0).first().mean_ndcg_at_k == 0.0


def test_delete_cascade_by_chunk(spark):
    chunks = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "chunk_id long, document_id long")
    log = spark.createDataFrame([(1,), (2,), (2,)], "chunk_id long")
    left = lifecycle.delete_cascade({"chunks": chunks, "log": log}, spark.createDataFrame([(2,)], "chunk_id long"), "chunk_id")
    assert (left["chunks"].count(), left["log"].count()) == (2, 1)


def test_specs_are_checked():
    with pytest.raises(ValueError):
        compose.ordered(compose.Spec([("a", "vector", {}), ("b", "bm25", {})]))
    with pytest.raises(ValueError):
        compose.ordered(compose.Spec([("a", "vector", {}), ("m", "merge", {})], [("a", "m")]))
    with pytest.raises(ValueError):
        compose.ordered(compose.Spec([("a", "rerank", {}), ("b", "rerank", {})], [("a", "b"), ("b", "a")]))
    assert compose.ordered(compose.preset("full_hybrid"))[-1] == "rerank"


def test_one_query_equals_its_row_among_many(spark):
    many = q.search_hybrid(spark, SF)
    fx = q.fx
    one = compose.compose(compose.preset("hybrid", **q.LOW))(fx.queries(spark, SF).where("query_id = 50"), fx.corpus(spark, SF), q.TOP_K, fx.as_of())
    assert got(one, "chunk_id", "score") == got(many.where("query_id = 50"), "chunk_id", "score")


def test_answers_and_sources(spark):
    qs = spark.createDataFrame([(1, "why")], "query_id long, text string")
    none = spark.createDataFrame([], "query_id long, chunk_id long, final_score double, content string, document_title string")
    assert prompts.rag_prompt(qs, none).first().prompt == "why"
    some = spark.createDataFrame([(1, 5, 0.5, "c", None)], none.schema)
    assert prompts.rag_prompt(qs, some).first().prompt == "Context:\n[Untitled] (score: 0.50)\nc\n\nQuestion: why"


def test_files_are_parsed_or_rejected(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.MD").write_bytes(b"  # hi\r\nthere \n")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "c.txt").write_bytes(b" \n ")
    (tmp_path / "d.pdf").write_bytes(b"x")
    good, bad = files.rejects(files.parse_files(files.discover(spark, str(tmp_path))))
    r = good.collect()
    assert len(r) == 1 and (r[0].title, r[0].content, r[0].file_type) == ("a", "# hi\nthere", "md")
    assert sorted(x.error for x in bad.collect()) == ["empty", "not UTF-8"]


def test_markdown_and_blocks_meet_by_stem(spark, tmp_path):
    (tmp_path / "p.md").write_text("text")
    (tmp_path / "p.json").write_text('[{"text": " ", "text_level": 1, "page_idx": 0}, {"text": "Title", "text_level": 1, "page_idx": 0}]')
    (tmp_path / "q.md").write_text("more")
    (tmp_path / "r.json").write_text("[]")
    rows = files.parsed_pairs(files.discover(spark, str(tmp_path), ("md", "json")))
    assert got(rows, "title", "markdown") == [("Title", "text"), ("q", "more")]


def test_json_sets_come_back(spark, tmp_path):
    row = spark.createDataFrame([("q", ["1"], "d", ("factual", "human"))], files.TEST_SET)
    files.write_json(row, str(tmp_path / "set"))
    assert spark.read.schema(files.TEST_SET).json(str(tmp_path / "set")).collect() == row.collect()


def test_files_that_come_again_are_not_ingested_twice(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def run(name, text):
        (src / name).write_text(text)
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(src))
        jobs.ingest_stream(stream, lambda df: df.select("file_hash", F.col("content").cast("string").alias("text")), out, str(tmp_path / "ck")).awaitTermination()

    run("a.txt", "one")
    run("b.txt", "one")
    run("c.txt", "two")
    assert got(spark.read.parquet(out + "/documents"), "text") == [("one",), ("two",)]


def replay(checkpoint):
    """Take back the last commit, as a crash before it would."""
    marks = [p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()]
    last = max(marks, key=lambda p: int(p.name))
    last.unlink()
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)


def test_ingest_stream_survives_a_replay(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), tmp_path / "ck"
    src.mkdir()

    def run():
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(src))
        jobs.ingest_stream(stream, lambda df: df.select("file_hash", F.col("content").cast("string").alias("text")), out, str(ck)).awaitTermination()
        return got(spark.read.parquet(out + "/documents"), "text")

    for name, text in (("a", "one"), ("b", "two"), ("c", "one")):
        (src / f"{name}.txt").write_text(text)
    assert run() == [("one",), ("two",)]
    replay(ck)
    assert run() == [("one",), ("two",)]
    (src / "d.txt").write_text("three")
    assert run() == [("one",), ("three",), ("two",)]
    replay(ck)
    assert run() == [("one",), ("three",), ("two",)]


def test_access_stream_survives_a_replay(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), tmp_path / "ck"

    def run():
        stream = spark.readStream.schema("chunk_id long, accessed_at timestamp_ntz").parquet(str(src))
        jobs.access_stream(stream, out, str(ck)).awaitTermination()
        return got(jobs.latest(spark, out), "chunk_id", "access_count")

    def come(*ids):
        spark.createDataFrame([(i,) for i in ids], "chunk_id long").selectExpr("chunk_id", "timestamp_ntz'2024-01-01' as accessed_at").coalesce(1).write.mode("append").parquet(str(src))

    come(1, 1, 2)
    assert run() == [(1, 2), (2, 1)]
    replay(ck)
    assert run() == [(1, 2), (2, 1)]
    for _ in range(2):
        come(1, 3)
        want = run()
        replay(ck)
        assert run() == want
    assert want == [(1, 4), (2, 1), (3, 2)]


def test_evaluation_run_equals_brute_force(spark):
    """Whole passages against whole texts, ranks by hand from the scores of the search."""
    texts = {r.doc_id: r.text for r in q.fx.table(spark, SF, "documents").collect()}
    passages = {r.item_id: r.text for r in q.fx.table(spark, SF, "benchmark").collect()}
    truth = {(i, d) for i, p in passages.items() for d, t in texts.items() if p in t}
    b = q.fx.table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    assert truth and {tuple(r) for r in evaluate.containing(b, q.fx.chunks(spark, SF)).collect()} == truth
    rows = {r.query_id: r for r in q.eval_run(spark, SF).collect()}
    assert set(rows) == set(passages)
    for i in passages:
        n = sum(x == i for x, _ in truth)
        assert rows[i].found_at_k == (1.0 if n else 0.0) and rows[i].reciprocal_rank == (1.0 if n else 0.0)


def test_containment_of_short_and_cut_passages(spark):
    chunks = spark.createDataFrame([(1, "Alpha beta gamma, delta epsilon zeta."), (2, "beta gamma"), (3, None), (4, "alpha beta gamma delta epsilon zeta")], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "beta gamma, delta epsilon zeta"), (2, "gamma"), (3, " "), (4, "pha beta gamma, delta epsilon z")], "query_id long, text string")
    assert got(evaluate.containing(asked, chunks), "query_id", "chunk_id") == [(1, 1), (2, 1), (2, 2), (2, 4), (4, 1)]


def test_routes_are_dispatched(spark):
    fx, spec = q.fx, compose.preset("hybrid", **q.LOW)
    qs = fx.queries(spark, SF)
    v = qs.select("query_id", F.lit(1500).alias("variant_no"), "text", "embedding")
    plain = got(q.search_hybrid(spark, SF), "query_id", "chunk_id", "score")
    direct = compose.search_variants(qs, v.withColumn("route", F.lit("direct")), fx.corpus(spark, SF), spec, q.TOP_K, fx.as_of())
    assert got(direct, "query_id", "chunk_id", "score") == plain
    mixed = q.search_routes(spark, SF)
    assert got(mixed.where("query_id % 100 = 0"), "query_id", "chunk_id", "score") == [r for r in plain if r[0] % 100 == 0]
    big = 2**60
    moved = v.withColumn("query_id", F.col("query_id") + big)
    ids = {r.query_id for r in compose.search_variants(qs.withColumn("query_id", F.col("query_id") + big), moved, fx.corpus(spark, SF), spec, q.TOP_K, fx.as_of()).collect()}
    assert ids == {r[0] + big for r in plain}


def test_reindexing_gives_missing_vectors(spark):
    chunks = spark.createDataFrame([(1, 10, "a b", None), (2, 10, "c", "ctx"), (3, 20, "d", None)], "chunk_id long, document_id long, content string, context string")
    docs = spark.createDataFrame([(10, "dirty"), (20, "failed")], "document_id long, sync_status string")
    old = spark.createDataFrame([(2, [9.0] * 64), (7, [1.0] * 64)], "chunk_id long, embedding array<float>")
    merged, report = lifecycle.reindex(docs, chunks, old)
    by_id = {r.chunk_id: r.embedding for r in merged.collect()}
    want = {r.chunk_id: r.embedding for r in provider.embed(spark.createDataFrame([(1, "a b"), (2, "ctx\n\nc")], "chunk_id long, text string")).collect()}
    assert by_id == want | {7: [1.0] * 64}
    assert got(report, "document_id", "total", "succeeded", "sync_status") == [(10, 2, 2, "synced"), (20, 1, 0, "failed")]


def test_contextualising_keeps_marks(spark):
    chunks = spark.createDataFrame([(1, 1, "a", None, False), (2, 1, "b", "old", True), (3, 1, "c", None, None)], "chunk_id long, document_id long, content string, context string, context_embedded boolean")
    new = spark.createDataFrame([(1, "new"), (2, "other")], "chunk_id long, context string")
    old = spark.createDataFrame([(2, [1.0] * 64)], "chunk_id long, embedding array<float>")
    rows, vectors, stored = lifecycle.contextualize_update(chunks, new, old)
    assert got(rows.fillna("", ["context"]), "chunk_id", "context", "context_embedded") == [(1, "new", True), (2, "old", True), (3, "", False)]
    assert got(vectors, "chunk_id") == [(1,), (2,)] and got(stored.postings, "chunk_id", "pos", "token") == [(1, 1, "new"), (1, 2, "a"), (2, 1, "old"), (2, 2, "b")]


def test_ingest_writes_all_tables(spark):
    docs = spark.createDataFrame([(1, "# Title\n\n" + "Some plain sentence of words. " * 60), (2, " "), (3, None)], "doc_id long, text string")
    done = ingest.ingest(docs, context=lambda ps: ["placed" if "Title" in p and "<chunk>" in p else "?" for p in ps])
    rows = done.chunks.orderBy("chunk_index").collect()
    assert len(rows) > 2 and {r.context for r in rows} == {"placed"} and all("sentence" in r.tags for r in rows)
    assert done.vectors.count() == len(rows) and done.documents.count() == 1
    assert got(done.rejects, "doc_id", "error") == [(2, "no chunks"), (3, "no chunks")]


def test_batches_are_sliced_by_size():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 10, None, "y" * 100, "z", "z", ""])], ["id", "text"])
    parts = list(provider.slices(batch, 1, 20))
    assert [p.num_rows for p in parts] == [2, 1, 3] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "query_id long, chunk_id long, score double")
    assert score.normalize_scores(none).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert prepare.chunk_recursive(docs).count() == prepare.chunk_fixed(docs).count() == prepare.content_filter(docs, markdown=True).count() == 0
    assert retrieve.vector_topk(spark.createDataFrame([], "query_id long, embedding array<float>"), spark.createDataFrame([], "chunk_id long, embedding array<float>"), 3).count() == 0


def test_search_records_accesses_where_asked(spark, tmp_path):
    fx, log = q.fx, str(tmp_path / "log")
    fx.accesses(spark, SF).write.parquet(log)
    corpus = fx.corpus(spark, SF)
    corpus.accesses = spark.read.parquet(log)
    before = corpus.accesses.count()
    qs, spec = fx.queries(spark, SF).where("query_id % 50 = 0"), compose.preset("linear", **q.LOW)
    plain = compose.search(qs, corpus, spec, as_of=fx.as_of())
    out = compose.search(qs, corpus, spec, as_of=fx.as_of(), record_to=log)
    cols = ("query_id", "chunk_id", "final_score")
    assert got(out, *cols) == got(plain, *cols)  # plain's files were listed before the append
    grown = spark.read.parquet(log)
    assert out.count() > 0 and grown.count() == before + out.count()
    assert grown.groupBy("chunk_id", "accessed_at").count().join(out.select("chunk_id").distinct(), "chunk_id").where(F.col("accessed_at") == fx.as_of()).count() == out.select("chunk_id").distinct().count()
