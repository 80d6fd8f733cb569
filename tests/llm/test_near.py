"""Near copies of the pipeline's stage."""

import random
import time
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillwork.llm import near
from rillwork.llm.shared import shared_dir, written


def plain_groups(texts):
    """texts: {doc: text}; least doc that links of five-word Jaccard 0.8 or more reach, by comparing all pairs."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    at = {d: d for d in texts}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            at[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def edited_texts(seed):
    """Texts and their copies with 0 to 12 words changed, all with a common passage."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for k in range(24):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 4, 5, 6, 40, 120, 400]))] + passage * (k % 2)
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(13) * len(base) // 200):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), "", None, " \n", "one", "One"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"block": 2})])
def test_groups_equal_brute_force(spark, make_docs, seed, options):
    texts = edited_texts(seed)
    rows = near.near_copies(make_docs([*texts.items(), (None, "one")]), **options).collect()
    assert {r.doc_id: r.component_id for r in rows} == plain_groups(texts) and len(rows) == len(texts)


def test_the_order_of_shingles_changes_nothing(spark, make_docs, monkeypatch):
    texts = edited_texts(3)
    monkeypatch.setattr(near, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(near, "BROADCAST_ROWS", 0)
    assert {r.doc_id: r.component_id for r in near.near_copies(make_docs(list(texts.items()))).collect()} == plain_groups(texts)


def test_stage_drops_a_copy_with_a_few_edits(spark, make_docs):
    """Three of 200 words changed: similarity over 0.8, but as a rule more than 3 bits of a SimHash."""
    import corpus_pipeline

    rng = random.Random(5)
    docs = []
    for k in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        docs.append((k, " ".join(words)))
        for at in (30, 90, 150):
            words[at] = "changed"
        docs.append((100 + k, " ".join(words)))
    kept = corpus_pipeline.one_of_each(spark, make_docs(docs), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))


def test_a_hot_shingle_lies_in_many_tasks(spark, make_docs, monkeypatch):
    """Half of the texts begin with one passage. Its rows are ranges of texts, so no task of the joins by shingle has more
    than its share, and the groups are those of brute force."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(12))
    texts = {i: (passage + " " if i % 2 else "") + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for i in range(600)}
    texts |= {600 + i: texts[i] + " more" for i in range(0, 600, 7)}
    seen = []
    deal = type(spark.range(0)).repartitionByRange

    def watched(self, *by):
        out = deal(self, 16, *by)
        if "key" in by:
            seen.append([r["count"] for r in out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()])
        return out

    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", watched)
    monkeypatch.setattr(near, "COMMON", 0)  # no shingle is known as common
    monkeypatch.setattr(near, "MOST_COMMON", 0)
    monkeypatch.setattr(near, "RUN", 40)
    rows = near.near_copies(make_docs(list(texts.items())).repartition(8)).collect()
    assert {r.doc_id: r.component_id for r in rows} == plain_groups(texts)
    assert seen and all(max(n) <= 3 * sum(n) / 16 for n in seen)


def test_simhash_chains_give_candidates(spark, make_docs, monkeypatch):
    """Their pairs connect what brute force finds at 3 or fewer bits; the stage takes them up and gives the same groups."""
    rng = random.Random(8)
    texts = {}
    for k in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts[k] = " ".join(words)
        words[rng.randrange(5, 295)] = "changed"
        texts[100 + k] = " ".join(words)
    sims = {near.set_print(s): near.fingerprint(s) for s in map(near.shingle_set, texts.values())}
    close = {(max(a, b), min(a, b)) for a, b in combinations(sims, 2) if ((sims[a] ^ sims[b]) & (2**64 - 1)).bit_count() <= 3}
    prints = near._prefixes(make_docs(list(texts.items()))).localCheckpoint()
    assert len(close) >= 5 and {(r.u, r.v) for r in near._chained(prints).collect()} == close
    seen, chained = [], near._chained
    monkeypatch.setattr(near, "_chained", lambda stand: seen.append(1) or chained(stand))
    monkeypatch.setattr(near, "FIRST_KEYS", 1)
    rows = near.near_copies(make_docs(list(texts.items()))).collect()
    assert seen and {r.doc_id: r.component_id for r in rows} == plain_groups(texts)


def test_no_rows(make_docs):
    assert near.near_copies(make_docs([])).count() == 0


def test_what_a_step_wrote_goes_when_it_is_done(spark, make_docs, monkeypatch):
    """Of the stage only what its result reads stays in the shared folder, and shuffle files of written tables go. A hub's
    pairs are dealt to several places."""
    monkeypatch.setattr(near, "HUB", 2)
    local = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: sum(f.stat().st_size for d in local for f in d.rglob("shuffle_*.data"))
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before, files = set(shared.iterdir()), shuffled()
    texts = edited_texts(4)
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, make_docs(texts.items()), "").collect()}
    assert kept == set(plain_groups(texts).values())
    assert {f.name.split("-")[1] for f in set(shared.iterdir()) - before} == {"near", "drop"}
    written(spark.range(200_000).repartition(4, "id"), "dealt")
    for _ in range(50):
        if shuffled() - files < 200_000:
            break
        time.sleep(0.2)
    assert shuffled() - files < 200_000  # what counting alone shuffled
