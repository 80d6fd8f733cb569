"""Phrase search by entries and by chunks, and queries that ask for the same phrase; vectors in groups and in cells."""

import numpy as np
import pytest

from rillwork import queries
from rillwork.operators import phrase_index, retrieve


@pytest.fixture
def chunks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e"], rng.integers(0, 30)))) for i in range(60)]
    return spark.createDataFrame([*rows, (60, None), (61, "a a a a")], "chunk_id long, content string")


@pytest.mark.parametrize("few, asked", [(200, 500_000), (0, 500_000), (0, 2)])
def test_equal_phrases_are_searched_once(spark, chunks, tmp_path, monkeypatch, few, asked):
    texts = ["a b", "A, b", "c", "a a", "d e a", "", None, "not there", 'e "e" e e']
    asked_for = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "query_id long, text string")
    stored = phrase_index.StoredIndex.open(spark, str(tmp_path / "index")).add(chunks.where("chunk_id % 3 > 0")).add(chunks)
    stored = stored.delete(chunks.where("chunk_id = 5").select("chunk_id")).add(chunks).merge()
    sizes, write = [], retrieve.written
    monkeypatch.setattr(retrieve, "FEW_PHRASES", few)
    monkeypatch.setattr(retrieve, "ASKED", asked)
    monkeypatch.setattr(retrieve, "written", lambda df, name: (sizes.append((name, t := write(df, name))), t)[1])
    for index in (None, stored):
        sizes.clear()
        hits = retrieve.phrase_topk(asked_for, chunks, 100, stored=index).toPandas()
        held = {(r.chunk_id, r.content) for r in chunks.collect()}
        words = lambda t: (t or "").lower().replace('"', " ").replace(",", " ").split()
        want = set()
        for q in asked_for.collect():
            w = words(q.text)
            want |= {(q.query_id, c) for c, t in held if w and any(words(t)[i : i + len(w)] == w for i in range(len(words(t))))}
        assert set(zip(hits.query_id, hits.chunk_id, strict=True)) == want
        once = hits[hits.query_id == 0].set_index("chunk_id").score
        for other in (1, 9, 10):
            assert hits[hits.query_id == other].set_index("chunk_id").score.to_dict() == once.to_dict()
        met = sum(t.count() for name, t in sizes if name == "phrase-lengths")
        assert met == len(want - {(q, c) for q, c in want if q in (1, 10) or q > 8})  # not once for each query


def test_deleted_index_is_summed_up_by_entries(spark):
    """A token of a chunk is one row on its way to the sums, not one for each place."""
    plan = queries.index_delete(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
