"""Ranked terms search: early termination finds what reading everything finds."""

import numpy as np
import pytest

from rillwork.operators import terms


@pytest.mark.parametrize("seed", range(6))
def test_best_equals_all_entries(seed):
    rng = np.random.default_rng(seed)
    lists = []
    for n in (5000, 3000, 400, 20, 1):
        chunk = rng.choice(8000, n, replace=False)
        lists.append((float(rng.uniform(1e-6, 6)), terms.Entries(chunk.astype(np.int64), rng.uniform(0.1, 2.2, n) ** 2)))
    total = np.zeros(8000)
    for idf, e in lists:
        total[e.chunk] += idf * e.impact
    chunks, scores, read = terms.best(lists, 10)
    want = np.lexsort((np.arange(8000), -total))[:10]
    order = np.lexsort((chunks, -scores))[:10]
    assert chunks[order].tolist() == want.tolist() and np.allclose(scores[order], total[want])
    assert read < 8421


def test_search_reads_a_part_of_the_entries(spark, monkeypatch):
    monkeypatch.setattr(terms, "PART", 4000)
    monkeypatch.setattr(terms, "ASKED", 10)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    weight = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(words, int(rng.integers(5, 60)), p=weight / weight.sum())) for _ in range(3000)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "w0 w1 w250 w299"), (2, "w3 w3 w100 nowhere"), (3, ""), (4, None), (5, "nowhere"), (6, "w280 w281 w282 w0 w1 w2")], "query_id long, text string")
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = {}
    for r in terms.terms_topk(asked, chunks, 5, 1, counts=counts).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    n, total = len(texts), sum(len(t.split()) for t in texts)
    tf = [dict(zip(*np.unique(t.split(), return_counts=True), strict=True)) for t in texts]
    for q, text in ((1, "w0 w1 w250 w299"), (2, "w3 w100"), (6, "w280 w281 w282 w0 w1 w2")):
        scores = np.zeros(n)
        for t in text.split():
            df = sum(t in x for x in tf)
            idf = max(np.log((n - df + 0.5) / (df + 0.5)), 0) or 1e-6
            for i, x in enumerate(tf):
                if t in x:
                    scores[i] += idf * x[t] * 2.2 / (x[t] + 1.2 * (0.25 + 0.75 * len(texts[i].split()) * n / total))
        want = sorted((-round(s, 12), i) for i, s in enumerate(scores) if s > 0)[:5]
        assert [(i, pytest.approx(s)) for s, i in want] == [(i, s) for s, i in sorted(got[q])]
    assert set(got) == {1, 2, 6}
    assert 0 < counts[1].value < 0.7 * counts[0].value
