"""Ranked search of many queries, and nearest neighbours by one-bit codes."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from oracle_check import assert_same, connect
from pyspark.sql import functions as F

from rillwork.llm import one_bit, queries, shared_terms

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    found = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain_terms(t))
    for item, ts in wanted.items():
        scores = []
        for doc, c in found:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms if c else 0
            s = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0 and doc is not None:
                scores.append((-s, doc))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, at int, score int")
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in shared_terms.shared_search(d, q, **more).collect()), key=str)


ITEMS = [(1, "Alpha beta, GAMMA delta"), (2, "alpha beta gamma eins"), (3, "beta gamma zwei"), (4, ""), (5, None), (2, "more"), (None, "delta"), (7, "ÉCOLE été œuvre"), (8, "nowhere")]


def test_terms_are_those_of_the_pattern():
    for text in ("a-b_c D1É", "", None, "日本 x\x00y", "Z" * 5000 + " é"):
        assert [t.decode() for t in shared_terms.terms(text)] == plain_terms(text)


@pytest.mark.parametrize("block_terms", [1000, 3])
def test_search_against_plain(spark, block_terms):
    docs = [(i, " ".join(("alpha beta gamma delta eins zwei more École été".split() * 3)[i % 7 : i % 7 + i % 11])) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "delta delta"), (102, "alpha " * 20_000), (103, "delta"), (103, "delta"), (104, "...")]
    assert searched(spark, docs, ITEMS, block_terms=block_terms) == plain_search(docs, ITEMS)


def test_search_of_nothing(spark):
    assert searched(spark, [], ITEMS) == [] == searched(spark, [(1, "alpha")], []) == searched(spark, [(1, None)], ITEMS)


def test_sharing_sums_the_terms_of_each_query():
    rng = np.random.default_rng(1)
    lists = [sorted({b"%d" % t for t in rng.zipf(1.4, 40) if t < 400}) for _ in range(60)] + [[], [b"1"]]
    s = shared_terms.mined(lists)
    value = list(rng.integers(1, 10**9, len(s.terms)))
    for a, b in zip(s.left, s.right, strict=True):
        value.append(value[a] + value[b])
    begin = 0
    for ts, end in zip(lists, s.use_ends, strict=True):
        assert sum(value[u] for u in s.uses[begin:end]) == sum(value[s.terms.index(t)] for t in ts)
        begin = end
    assert s.additions() < sum(len(ts) - 1 for ts in lists if ts)


def test_op11_as_sql(spark):
    assert_same(spark, connect(SF), queries.op11_ranked_search, queries.OP11, SF)


def plain_nearest(rows, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % 20 == 0:
            near = sorted((-round(float((a * b).sum()), 12), i) for i, b in ok if i != q and len(b) == len(a))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_nearest_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(70).tolist()) for i in range(100)] + [(i, [1.0] * 70) for i in range(200, 280)]
    rows += [(300, None), (320, []), (340, [0.0] * 70), (360, [math.nan] * 70), (380, [None] * 70), (400, [math.inf] * 70), (None, [1.0] * 70), (420, [1.0, 2.0]), (421, [2.0, 1.0]), (440, [3.0, 3.0, 3.0]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, code int, score double").repartition(3)
    got, want = found(one_bit.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()), plain_nearest(rows, 20)
    assert set(got) == {q for q in want if want[q]}  # a vector alone in its dimension has no neighbours
    assert all(len(got[q]) == len(want[q]) for q in got)
    assert sum(len(set(got[q]) & set(want[q])) for q in got) >= 0.98 * sum(map(len, want.values()))
    assert got[200] == want[200]
    assert got[420] == [(421, 4.0)]
    again = found(one_bit.nearest(df, F.col("vec_id") % 20 == 0, 20, block=200).collect())
    assert again == got


def test_vectors_at_the_centre_and_even_queries():
    turn, v = one_bit.rotation(130), np.array([[2.0] * 130, [2.0] * 130, [3.0] * 130])
    for q in (np.array([[1.0] * 130]), np.zeros((1, 130)) + turn.sum(axis=1)):
        tile, coded = one_bit.Queries.of(q, turn), one_bit.codes(v, v[0], turn)
        guess, bound = one_bit.estimated(tile, *coded, q @ v[0], 130)
        for floor in (guess[0, 0] - 1, guess[0, 0] + 1, -np.inf):
            assert (one_bit.may_reach(tile, *coded, q @ v[0], np.array([floor]), 130) == (guess + bound >= floor)).all()


def test_equal_vectors_whose_least_ids_are_the_query(spark):
    rows = [(20, [1.0, 2.0])] * 9 + [(i, [1.0, 2.0]) for i in range(30, 45)] + [(40, [1.0, 2.0])] * 5 + [(19, [1.0, 1.0]), (60, [0.5, 1.0])]
    got = found(one_bit.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") % 20 == 0, 4).collect())
    assert got[20] == [(i, 5.0) for i in (30, 31, 32, 33)] and got[40] == [(20, 5.0)] * 4
    assert got[60] == [(20, 2.5)] * 4
    rows = [(20, [9.0, 1.0 * i]) for i in range(9)] + [(i, [1.0, 0.1 * (i - 30)]) for i in range(30, 37)]  # the query's own rows are the nearest
    got = found(one_bit.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") == 20, 4).collect())
    assert [i for i, _ in got[20]] == [30, 31, 32, 33]


def test_nearest_of_nothing(spark):
    assert one_bit.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_leave_most_pairs_out():
    rng = np.random.default_rng(3)
    v, q = rng.standard_normal((4000, 64)), rng.standard_normal((50, 64))
    centre, turn = v.mean(axis=0), one_bit.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    tile, coded = one_bit.Queries.of(q, turn), one_bit.codes(v, centre, turn)
    guess, bound = one_bit.estimated(tile, *coded, q @ centre, 64)
    for floor in (np.full(50, 3.0), np.linspace(-20, 20, 50), np.full(50, -np.inf)):
        assert (one_bit.may_reach(tile, *coded, q @ centre, floor, 64) == (guess + bound >= floor[:, None])).all()
    true = q @ v.T
    assert (np.abs(true - guess) <= bound).mean() > 0.93
    best = np.sort(true, axis=1)[:, -20:-19]
    assert (guess + bound >= best)[true >= best].mean() > 0.99
    assert (guess + bound >= best).mean() < 0.3


def test_op12_finds_what_all_pairs_find(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = found(queries.op12_one_bit_search(spark, "/root/testdata/sf0.01").collect())
    want = plain_nearest([(r["vec_id"], r["embedding"]) for r in rows.collect()], 20)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.99 * sum(map(len, want.values()))
