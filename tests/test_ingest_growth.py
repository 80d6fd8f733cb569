"""Ingest: what moves between tasks goes with the documents, not with their chunks times their texts."""

import hashlib
import json
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillwork import tables
from rillwork.functions import text as tx
from rillwork.functions.vectors import code_of
from rillwork.operators import ingest, prepare, prompts, provider
from rillwork.tables import shared_dir

TEXT = "# Title\n\n" + "Some plain sentence of words. " * 400


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def other(docs):
    return prepare.chunk_fixed(docs)


@pytest.mark.parametrize("chunker", [prepare.chunk_fixed, prepare.chunk_recursive, other])
def test_chunks_are_asked_for_where_their_text_lies(spark, monkeypatch, chunker):
    """No text is joined to its chunks; another chunker's chunks meet it once, in an array."""
    docs = spark.createDataFrame([(1, TEXT), (2, " "), (3, None), (4, "short")], "doc_id long, text string")
    rows = prepare.by_document(docs, chunker)
    assert ("Join" in plan(rows)) == (chunker is other) and {r.doc_id: r.text for r in rows.collect()} == {1: TEXT, 4: "short"}
    pieces = rows.select("doc_id", F.inline("pieces")).collect()
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, chunker(docs).select("doc_id", "chunk_index", "content").collect()))


def test_a_text_goes_to_the_provider_s_task_once(spark):
    """The plan of contexts() has no prompt, which is as long as the document, for each chunk; what comes of it is as before."""
    docs = spark.createDataFrame([(1, TEXT), (2, TEXT[::-1]), (3, "x")], "document_id long, text string")
    rows = prepare.chunk_fixed(docs, "document_id").withColumn("chunk_id", F.col("document_id") * 100 + F.col("chunk_index"))
    rows = rows.unionByName(spark.createDataFrame([(3, 1, None, 0, 0, 301)], rows.schema))
    got = prompts.contexts(rows, docs)
    assert prompts.CONTEXT_ASK not in plan(got)
    want = provider.complete(prompts.context_prompt(rows, docs), provider.echo, ("chunk_id",)).select("chunk_id", "response")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_offline_model_says_the_same(spark):
    asked = ["a\nb", " a ", "", "\n \n", "x y\x85", "p" * 3000 + "\n" + "q" * 2000, "h" * 5000 + "one", "h" * 5000 + "two", "h" * 5000 + "\ntwö", "a\r\n" + " " * 2000]
    plain = [f"{p.strip().splitlines()[-1] if p.strip() else ''} #{hashlib.md5(p.encode()).hexdigest()[:8]}" for p in asked]
    assert provider.echo(asked) == plain
    texts = ["Numbers1letters_splits and SPLITS numbers", "größere Zeichen ÄNDERN größere", "", "aaaaaa bbbbbb cccccc dddddd dddddd"]
    count = [Counter(re.findall(r"[^\W\d_]{6,}", p.lower())) for p in texts]
    assert provider.keywords(texts) == [json.dumps([w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3]], ensure_ascii=False) for c in count]


def test_tokens_cut_in_python_are_those_of_the_column(spark):
    texts = ["Plain TEXT_with 1,2 \x00\x7f", "Größe ﬁ éa", "", None, "日本 x", " . "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    whole = tx.with_tokens(rows, F.col("text")).coalesce(1).orderBy("id").toArrow().combine_chunks().to_batches()[0]
    want = [r.w for r in rows.orderBy("id").select(tx.tokens(F.col("text")).alias("w")).collect()]
    assert tx.token_lists(whole).to_pylist() == want and tx.token_lists(whole.slice(4, 2)).to_pylist() == want[4:]
    assert tx.token_lists(whole.slice(0, 1)).to_pylist() == want[:1]
    assert code_of(pa.array(["a", "é"])).tolist() == [int(hashlib.md5(t.encode()).hexdigest()[:6], 16) for t in ("a", "é")]


def test_flags_of_paragraphs_are_those_of_the_bare_patterns(spark):
    paras = ["[1] Name, A. (2020). https://x", "doi: 10 arXiv:1", "Vol.x", "Journal", "proceedings x", " References ", "#  Appendix A", "## " + "w" * 51, "A. b", "# " + " " * 60 + "References" + " " * 60, "", "  ", ", 2020", "[12, 3]", "[AB+12]", "et al.x", "J. x", "Xyz,  A."]
    rows = spark.createDataFrame([(p,) for p in paras], "p string")
    bare = [F.when(F.col("p").rlike(x), 1.0).otherwise(0.0) for x in prepare.CITATION_FEATURES]
    assert rows.where(prepare.citation_density(F.col("p")) != sum(bare[1:], bare[0]) / 8).count() == 0
    joined = "\n\n".join(["x" * 40] * 30 + ["Appendix A"] + ["[1] Name, A. (2020). https://x"] * 3)
    assert prepare.tail_cut(spark.createDataFrame([(1, joined)], "doc_id long, text string")).collect()[0].cut_point == 42 * 30


def test_groups_of_an_index_give_its_entries_again(spark, monkeypatch):
    """Postings are shuffled a group of a token's chunks at a time; long texts and frequent words come back whole."""
    from rillwork.operators import phrase_index

    words = [["a", "b", "a"], ["b"], [], ["c"] * 70_000 + ["a"], ["a"] * 300]
    rows = spark.createDataFrame([(i * 7 - 1, w) for i, w in enumerate(words)], "chunk_id long, words array<string>").coalesce(1)
    groups = phrase_index.groups_of(rows)
    assert groups.count() == 3 and phrase_index.entries_of(rows).count() == 6
    back = phrase_index.ungrouped(groups.withColumn("bucket", F.lit(1))).drop("bucket")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, phrase_index.entries_of(rows).collect()))


def test_a_store_writes_each_table_once(spark, tmp_path, monkeypatch):
    """What a run gives is written to the store itself, and the index reads the run's own chunks."""
    made = []
    written = ingest.written
    monkeypatch.setattr(ingest, "written", lambda df, name: made.append(name) or written(df, name))
    docs = spark.createDataFrame([(1, TEXT), (2, TEXT + "more")], "doc_id long, text string")
    store = ingest.CorpusStore.open(spark, str(tmp_path / "store")).ingest(docs.where("doc_id = 1"), chunker=prepare.chunk_fixed)
    assert made == ["to-ingest", "clean"]
    more = store.ingest(docs, chunker=prepare.chunk_fixed)
    assert more.index().totals()[0] == more.table("chunks").count() > store.table("chunks").count() and more.table("documents").count() == 2


def test_a_run_leaves_its_store_alone(spark, tmp_path):
    """Tables on the way go when a run ends."""
    shared = Path(shared_dir(spark).removeprefix("file://"))
    docs = spark.createDataFrame([(i, f"# Head {i}\n\n" + f"word{i} letters and more. " * 40) for i in range(6)], "doc_id long, text string")
    before = set(shared.iterdir())
    store = ingest.CorpusStore.open(spark, str(tmp_path / "store")).ingest(docs.where("doc_id < 4"), dedup=True).ingest(docs, dedup=True)
    assert set(shared.iterdir()) == before
    assert sorted(r.doc_id for r in store.table("documents").collect()) == list(range(6)) and store.index().totals()[0] == store.table("chunks").count()


def test_workers_give_memory_back(monkeypatch):
    """A worker stays when its task is done: what the task took is given back at its end, or when its rows aren't asked for any more."""
    given = []
    monkeypatch.setattr(tables, "release", lambda: given.append(1))
    batches = [pa.RecordBatch.from_arrays([pa.array([i])], ["x"]) for i in range(3)]
    assert [b.column(0)[0].as_py() for b in tables.lean(lambda bs: (b for b in bs))(iter(batches))] == [0, 1, 2] and given == [1]
    rows = tables.lean(lambda bs: (b for b in bs))(iter(batches))
    next(rows)
    rows.close()
    assert given == [1, 1]
