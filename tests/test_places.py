"""Searches that touch only their hits, dispatch by route, and the index and the store that live at a path."""

import random

import pytest
from pyspark.sql import functions as F

from rillwork import fixtures as fx
from rillwork import queries as q
from rillwork.operators import evaluate, ingest, phrase_index, prepare, prompts, retrieve, score
from rillwork.plans import compose
from rillwork.tables import Folder, shared_dir, temporary

SF = "/root/testdata/sf0.001"


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# vectors


@pytest.mark.parametrize("matrix", [0, 1 << 22])
def test_vectors_of_other_dimensions_are_no_hits(spark, monkeypatch, matrix):
    monkeypatch.setattr(retrieve, "MATRIX", matrix)
    v = spark.createDataFrame([(1, [5.0]), (2, [1.0, 1.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [0.0, 0.0, 2.0])], "chunk_id long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [1.0] * 9), (4, None), (5, [])], "query_id long, embedding array<float>")
    want = [(1, 3, 1.0), (2, 2, 0.577350269), (2, 7, 1.0)]
    assert got(retrieve.vector_topk(asked, v, 5, 0.0), "query_id", "chunk_id", "score") == want
    assert got(retrieve.vector_topk_ann(asked, v, 5, 0.0), "query_id", "chunk_id", "score") == want
    assert got(retrieve.vector_topk_ann(asked.where("query_id = 2"), v, 5, 0.0), "query_id", "chunk_id", "score") == want[1:]
    assert retrieve.vector_topk(asked.where("query_id > 3"), v, 5, 0.0).count() == 0


# dispatch


def small_corpus(spark):
    docs = spark.createDataFrame([(i, f"t{i}", 1.0) for i in range(3)], "document_id long, title string, weight double")
    chunks = spark.createDataFrame([(i, i, "text", None, [f"tag{i}"]) for i in range(3)], "chunk_id long, document_id long, content string, context string, tags array<string>")
    vectors = spark.createDataFrame([(0, 0, [], [1.0, 0.0]), (1, 1, [], [0.9, 0.1]), (2, 2, [], [0.5, 0.9])], "chunk_id long, document_id long, tags array<string>, embedding array<float>")
    tag_vectors = spark.createDataFrame([(f"tag{i}", [0.0, 1.0]) for i in range(3)], "tag string, vector array<float>")
    accesses = spark.createDataFrame([], "chunk_id long, accessed_at timestamp_ntz")
    return compose.Corpus(docs, chunks, vectors, tag_vectors, accesses)


@pytest.mark.parametrize("route", ["direct", "hyde", "fusion"])
def test_a_lone_variant_is_the_pipeline_reranked_on_the_original(spark, route):
    corpus = small_corpus(spark)
    spec = compose.preset("linear", vector={"threshold": 0.0}, rerank={"threshold": 0.0})
    original = spark.createDataFrame([(1, "q", [0.0, 1.0])], "query_id long, text string, embedding array<float>")
    variant = spark.createDataFrame([(1, 0, "other", [1.0, 0.0], route)], "query_id long, variant_no long, text string, embedding array<float>, route string")
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    found = compose.search_variants(original, variant, corpus, spec, 5, as_of)
    rows = {r.chunk_id: r for r in found.collect()}
    own = compose.compose(spec)(variant.select("query_id", "text", "embedding"), corpus, 5, as_of, rerank_queries=original)
    assert rows == {r.chunk_id: r for r in own.collect()}
    assert rows[0].metadata_score == 1.0  # the tag is the original's vector; the variant's would give 0.5
    assert rows[0].retrieval_score == 1.0 and 0.9 < rows[1].retrieval_score < 1.0 and rows[2].retrieval_score == 0.0


# plans


def test_only_hits_are_shuffled(spark):
    """Content, tags and the log of all chunks never lie in an exchange, whatever is broadcast by size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 2000
        chunks = spark.range(n).selectExpr("id chunk_id", "id document_id", "repeat('x', 10) content", "cast(null as string) context", "array('a') tags")
        docs = spark.range(n).selectExpr("id document_id", "'t' title", "1.0D weight", "'/p' source_path")
        log = spark.range(n).selectExpr("id chunk_id", "timestamp_ntz'2024-01-01' accessed_at")
        hits = spark.createDataFrame([(1, 5, 0.5)], "query_id long, chunk_id long, score double")
        out = score.hydrate(hits, chunks, docs)
        assert out.count() == 1
        for df in (out, score.retention_score(hits, log, F.lit("2024-02-01").cast("timestamp_ntz"))):
            for node in plan(df).split("\n\n"):
                if ") Exchange" in node:
                    assert "content" not in node or "hit-chunks" in plan(df)
        text = plan(score.of_hits(hits, chunks, "content"))
        assert "Exchange" not in text and "hit-chunks" in text  # it was written from a scan, with the ids broadcast
        assert "BroadcastHashJoin" in plan(chunks.join(score.small(hits.select("chunk_id"), "x"), "chunk_id", "left_semi"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_postings_tokenise_once(spark):
    from rillwork.operators import index

    text = index.postings(fx.chunks(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("split(") == 1


# preparation


def test_many_headings_and_sections_side_by_side(spark):
    """Against a plain walk, with nested, adjacent and unending sections; and a document of very many headings."""
    rng = random.Random(8)

    def plain(text):
        lines = [x + "\n" for x in text.split("\n")]
        lines[-1] = lines[-1][:-1]
        heads = [(i, len(x) - len(x.lstrip("#")), x.lstrip("#").strip()) for i, x in enumerate(lines) if x.startswith("#")]
        gone = set()
        for i, level, title in heads:
            if title in ("References", "Appendix"):
                gone |= set(range(i, next((j for j, other, _ in heads if j > i and other <= level), len(lines))))
        kept = "".join(x for i, x in enumerate(lines) if i not in gone)
        first = sum(len(x) for x in lines[: min(gone)]) if gone else None
        return (kept.rstrip() if gone else text, len(text) - len(kept) if gone else 0, first)

    texts = ["\n".join(rng.choice(["# Head", "## Head", "### Head", "# References", "## Appendix", "### References", "line", "more", ""]) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None)], "doc_id long, text string")
    rows = {r.doc_id: (r.filtered_text, r.removed_chars, r.cut_point) for r in prepare.strip_markdown_sections(docs).collect()}
    assert {i: rows[i] for i in range(len(texts))} == {i: plain(t) for i, t in enumerate(texts)}
    assert rows[900][0] is None and prepare.content_filter(docs, markdown=True).count() == 201
    many = "\n".join(f"{'#' * (1 + i % 6)} {'References' if i % 7 == 0 else f'Part {i}'}\nline" for i in range(50_000))
    got_many = prepare.strip_markdown_sections(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()
    assert got_many.removed_chars > 0 and got_many.n_sections > 1000


def test_a_search_leaves_nothing_in_the_scratch_folder(spark):
    folder = Folder(spark, shared_dir(spark))
    before = set(folder.names(""))
    with temporary(spark):
        rows = score.hydrate(q.search_linear(spark, SF), fx.chunks(spark, SF), fx.docs(spark, SF)).collect()
        assert rows and len(set(folder.names("")) - before) > 3
    assert set(folder.names("")) == before


def test_a_local_session_without_a_folder_gets_one(spark, monkeypatch):
    from rillwork import tables

    class Bare:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "local[1]", "applicationId": "bare", "getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)}))})

    assert tables.shared_dir(Bare) == tables.shared_dir(Bare)
    Bare.sparkContext.master = "spark://x"
    with pytest.raises(ValueError):
        tables.shared_dir(Bare)


# containment


def test_containment_equals_brute_force_on_cut_words(spark):
    rng = random.Random(4)
    words = ["a", "concat", "b", "five", "xfour", "four", "Ünder", "on", "cat", "e1"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["a concat b", "one two three four five", None, ""]
    asked = ["cat", "one two three four fi", "four fi", "t", " b", "on", "..", "our"] + [t[i : i + rng.randint(1, 30)] for t in texts[:40] if t for i in [rng.randint(0, len(t) - 1)]]
    from rillwork.functions.text import tokens

    c = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, content string")
    s = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "query_id long, text string")
    worded = {r.query_id for r in s.where(F.size(tokens(F.col("text"))) > 0).collect()}
    want = sorted((i, j) for i, p in enumerate(asked) if i in worded for j, t in enumerate(texts) if t and p in t)
    assert got(evaluate.containing(s, c), "query_id", "chunk_id") == want


# the index at a path


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, content string")


def test_index_is_added_to_deleted_from_and_merged(spark, tmp_path):
    path = str(tmp_path / "index")
    a = chunk_rows(spark, [(1, "one two two"), (2, "two three"), (None, "no id"), (3, None)])
    first = phrase_index.StoredIndex.open(spark, path, buckets=4).add(a)
    assert first.totals() == (3, 5) and first.add(a) is first and first.backfill(a) is first
    second = first.add(a.unionByName(chunk_rows(spark, [(4, "two one")])))
    assert second.totals() == (4, 7) and len(second.segments) == 2
    third = second.delete(chunk_rows(spark, [(1, ""), (99, "")]))
    assert third.totals() == (3, 4) and got(third.lengths, "chunk_id") == [(2,), (3,), (4,)]
    assert third.delete(chunk_rows(spark, [(1, "")])) is third
    fourth = third.add(chunk_rows(spark, [(1, "new words")]))
    want = [(1, "new", 1), (1, "words", 2), (2, "three", 2), (2, "two", 1), (4, "one", 2), (4, "two", 1)]
    assert got(fourth.postings, "chunk_id", "token", "pos") == want
    merged = fourth.merge()
    merged.vacuum()
    again = phrase_index.StoredIndex.open(spark.newSession(), path)
    assert again == merged and got(again.postings, "chunk_id", "token", "pos") == want and again.totals() == (4, 6)
    assert len(Folder(spark, path).names("segments")) == len(Folder(spark, path).names("manifests")) == 1
    wanted = spark.createDataFrame([("two",), ("nowhere",)], "token string")
    assert got(again.holding(wanted), "token", "chunk_id", "positions") == [("two", 2, [1]), ("two", 4, [1])]
    with pytest.raises(ValueError):
        again.add(chunk_rows(spark, [(7, "x"), (7, "y")]))


def test_index_survives_a_run_that_died_and_refuses_two_writers(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = chunk_rows(spark, [(1, "one")])
    base = phrase_index.StoredIndex.open(spark, path)
    Folder(spark, path).create("segments/1/lengths/part-0.parquet", "left by a run that died")
    done = base.add(rows)
    assert got(done.postings, "chunk_id", "token", "pos") == [(1, "one", 1)]
    with pytest.raises(FileExistsError):
        base.add(chunk_rows(spark, [(2, "two")]))  # it goes on from a version that isn't the newest
    assert got(phrase_index.StoredIndex.open(spark, path).lengths, "chunk_id") == [(1,)]


def test_an_empty_index_is_searched(spark, tmp_path):
    empty = phrase_index.StoredIndex.open(spark, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, "one")], "query_id long, text string")
    assert retrieve.phrase_topk(asked, chunk_rows(spark, []), 5, stored=empty).count() == 0
    assert empty.delete(chunk_rows(spark, [(1, "")])) is empty and empty.merge() is empty


def test_search_reads_only_the_buckets_of_its_tokens(spark, tmp_path):
    made = phrase_index.StoredIndex.open(spark, str(tmp_path / "index")).add(fx.chunks(spark, SF))
    text = plan(made.holding(spark.createDataFrame([("the",)], "token string")))
    assert "PartitionFilters" in text and "bucket" in text.split("PartitionFilters", 1)[1][:200]


def test_phrases_with_repeated_words(spark, tmp_path):
    rows = chunk_rows(spark, [(1, "a b a b a"), (2, "a a a"), (3, "b a b"), (4, "x")])
    asked = spark.createDataFrame([(1, "a b a"), (2, "a a"), (3, "b"), (4, "b a b a"), (5, "x y"), (6, '"a" b')], "query_id long, text string")
    want = [(1, 1, 2), (2, 2, 2), (3, 1, 2), (3, 3, 2), (4, 1, 1), (6, 1, 2), (6, 3, 1)]
    from rillwork.operators.index import TextIndex

    for made in (TextIndex.passing(rows), phrase_index.StoredIndex.open(spark, str(tmp_path / "i")).add(rows)):
        assert got(retrieve.phrase_counts(asked, made), "query_id", "chunk_id", "f") == want


# the store


def test_store_is_read_by_another_session_and_takes_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "store")
    text = "# T\n\n" + "Some plain sentence of words. " * 60
    big = 9_223_372_036_854_775_807
    docs = spark.createDataFrame([(1, text), (big, text + "more"), (2, text), (3, " "), (4, None)], "doc_id long, text string")
    store = ingest.CorpusStore.open(spark, path).ingest(docs, dedup=True)
    assert got(store.table("documents"), "doc_id", "sync_status") == [(1, "synced"), (big, "synced")]
    assert got(store.table("rejects"), "doc_id", "error") == [(3, "no chunks"), (4, "no chunks")]  # 2 is a copy of 1
    assert store.ingest(docs, dedup=True) == store
    assert got(store.new(docs), "doc_id") == [(2,)] and store.new(docs, dedup=True).count() == 0
    again = ingest.CorpusStore.open(spark.newSession(), path)
    assert again == store and again.table("chunks").count() == again.table("vectors").count() == again.index().totals()[0] > 4
    more = again.ingest(docs.unionByName(spark.createDataFrame([(5, text + "other")], "doc_id long, text string")), dedup=True)
    assert len(more.batches) == 2 and got(more.table("documents"), "doc_id") == [(1,), (5,), (big,)]
    assert more.index().totals()[0] == more.table("chunks").count()


def test_chunks_of_large_ids_keep_apart(spark):
    docs = spark.createDataFrame([(9_300_000_000_000, "word " * 400), (9_300_000_000_001, "word " * 400)], "doc_id long, text string")
    done = ingest.ingest(docs, chunker=prepare.chunk_fixed, markdown=False)
    assert done.chunks.count() == done.chunks.select("chunk_id").distinct().count() == done.chunks.select("document_id", "chunk_index").distinct().count()


def test_the_most_used_tags_stand_in_a_prompt(spark, monkeypatch):
    monkeypatch.setattr(prompts, "MOST_TAGS", 2)
    docs = spark.createDataFrame([(1, "text")], "document_id long, content string")
    use = spark.createDataFrame([("a", 1), ("b", 5), ("c", 3), ("d", 3)], "tag string, n long")
    assert '["b","c"]' in prompts.tag_prompt(docs, use).first().prompt
    assert '["a","b"]' in prompts.tag_prompt(docs, use.select("tag")).first().prompt


def test_routes_are_those_of_the_query(spark):
    assert q.search_routes(spark, SF).count() > 0
