"""Queries whose cost must grow with their tables."""

import pytest

from rillwork import fixtures as fx
from rillwork import queries

D = "/root/testdata/sf0.001"


def test_texts_are_the_chunks_without_tags(spark):
    names = fx.texts(spark, D).columns
    assert sorted(map(tuple, fx.texts(spark, D).collect())) == sorted(map(tuple, fx.chunks(spark, D).select(*names).collect()))


@pytest.mark.parametrize("name", ["bm25_passing", "bm25_topk", "rrf_weighted", "terms_topk", "index_append", "semantic_dedup"])
def test_no_text_goes_through_a_join(spark, monkeypatch, name):
    """Chunks with tags are joined, which would shuffle all texts of a large table: none of these asks for them."""

    def joined(*_):
        raise AssertionError("texts are joined")

    monkeypatch.setattr(fx, "chunks", joined)
    monkeypatch.setattr(fx, "docs", joined)
    queries.queries()[name](spark, D).limit(1).count()


def test_entries_are_grouped_in_small_parts(spark, monkeypatch):
    """A task's memory follows from the tokens that are grouped at a time, not from its chunks."""
    import numpy as np

    from rillwork.operators import phrase_index

    seen, argsort = [], np.argsort
    monkeypatch.setattr(phrase_index.np, "argsort", lambda a, **how: seen.append(len(a)) or argsort(a, **how))
    rows = spark.range(1).select("id").alias("r")
    run = {}
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: run.setdefault("f", f))
    import pyarrow as pa

    words = pa.array([[f"w{i % 50}" for i in range(200_000)]] * 6)
    phrase_index.entries_of(rows.selectExpr("id as chunk_id", "array('a') as words"))
    out = list(run["f"](iter([pa.RecordBatch.from_arrays([pa.array(range(6)), words], ["chunk_id", "words"])])))
    assert sum(b.num_rows for b in out) == 300 and sum(seen) == 1_200_000 and max(seen) <= 1 << 18
