"""Near copies by cosine against all pairs."""

import math

import numpy as np
import pytest

from rillwork.operators import semantic


def plain(rows, threshold):
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    at = {i: i for i, _ in ok}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for k, (i, a) in enumerate(ok):
        for j, b in ok[k + 1 :]:
            if len(a) == len(b) and round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9) >= threshold:
                x, y = find(i), find(j)
                at[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in ok}


@pytest.mark.parametrize("threshold, block, cell", [(0.95, 2048, 1024), (0.9, 7, 20), (0.99, 16, 10)])
def test_classes_equal_all_pairs(spark, monkeypatch, threshold, block, cell):
    monkeypatch.setattr(semantic, "CELL", cell)
    rng = np.random.default_rng(int(threshold * 100))
    rows = []
    for k in range(40):
        base = rng.standard_normal(12)
        rows += [(len(rows) + j, (base + rng.standard_normal(12) * s).tolist()) for j, s in enumerate(rng.uniform(0, 0.5, 6))]
    rows += [(1000 + i, [1.0] * 12) for i in range(50)] + [(2000 + i, (np.ones(12) * (i + 1)).tolist()) for i in range(20)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [math.nan] * 12), (3004, [None] * 12), (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "chunk_id long, embedding array<double>, cell int").repartition(3)
    got = semantic.near_copies(df, threshold, block=block).collect()
    want = plain(rows, threshold)
    assert len(got) == len(rows)
    assert {r.id: r.class_id for r in got if r.id is not None} == {i: want.get(i, i) for i, _ in rows if i is not None}


def test_cells_leave_most_pairs_out(spark, monkeypatch):
    """Vectors in clusters: a vector visits few cells, and no pair of blocks is larger than two blocks."""
    monkeypatch.setattr(semantic, "CELL", 50)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((20, 16)) * 3
    rows = [(i, (centre[i % 20] + rng.standard_normal(16) * 0.3).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "rep long, embedding array<double>")
    c = semantic.centres(df, len(rows))
    met = semantic.placed(df, 16, c, math.sqrt(0.1))
    assert met.count() < 4 * len(rows) < len(c) * len(rows)
    sizes = semantic.deal(met, 30).groupBy("cell", "lo", "hi").count().collect()
    assert max(r["count"] for r in sizes) <= 100


def test_a_block_meets_few_others(spark, monkeypatch):
    """Scattered vectors visit many cells, so cells and blocks are as large as a task holds: what is shuffled stays within a few
    times the vectors, and no table of it is written."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    sent, names, links, write = [], [], semantic.links, semantic.written
    monkeypatch.setattr(semantic, "links", lambda met, *more: sent.append(met.count()) or links(met, *more))
    monkeypatch.setattr(semantic, "written", lambda rows, name: names.append(name) or write(rows, name))
    got = {r.id: r.class_id for r in semantic.near_copies(df).collect()}
    assert sum(sent) <= 4 * len(rows) and "dealt" not in names and "cells" not in names
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    near, label, before = np.round(unit @ unit.T, 9) >= semantic.THRESHOLD, np.arange(len(rows)), None
    while before is None or (label != before).any():
        before, label = label, np.where(near, label, len(rows)).min(axis=1)
    assert got == dict(enumerate(label.tolist()))


def test_no_vectors(spark):
    assert semantic.near_copies(spark.createDataFrame([], "chunk_id long, embedding array<float>")).count() == 0
    with pytest.raises(ValueError):
        semantic.near_copies(spark.createDataFrame([], "chunk_id long, embedding array<float>"), 0.0)
