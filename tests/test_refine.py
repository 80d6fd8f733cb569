"""Compression of hits against a plain version, and summaries by levels."""

import math
import random
from collections import Counter

from rillwork import fixtures as fx
from rillwork import queries as q
from rillwork.operators import refine

SF = "/root/testdata/sf0.001"


def plain(text, budget):
    """Sentences, word counts and walks by dictionaries and lists."""
    parts = refine.sentences(text)
    words = [Counter(refine.WORD.findall(p.lower())) for p in parts]
    size = [sum(w.values()) for w in words]
    if sum(size) <= budget:
        return text
    n = len(parts)
    cos = lambda a, b: round(sum(a[t] * b[t] for t in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 9) if a and b else 0.0
    s = [[0.0 if i == j else cos(words[i], words[j]) for j in range(n)] for i in range(n)]
    at = [1 / n] * n
    for _ in range(refine.ROUNDS):
        at = [(1 - refine.FOLLOW) / n + refine.FOLLOW * sum(at[i] * (s[i][j] / sum(s[i]) if sum(s[i]) else 1 / n) for i in range(n)) for j in range(n)]
    central = [round(x / max(at), 9) for x in at]
    taken = []
    while True:
        fit = [i for i in range(n) if i not in taken and 0 < size[i] <= budget - sum(size[j] for j in taken)]
        if not fit:
            return " ".join(parts[i] for i in sorted(taken))
        taken.append(max(fit, key=lambda i: (round(refine.CENTRAL * central[i] - (1 - refine.CENTRAL) * max([0.0, *(s[j][i] for j in taken)]), 9), -i)))


def test_compression_equals_plain_and_keeps_the_budget(spark):
    rng = random.Random(2)
    texts = [" ".join(" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randint(1, 9))) + rng.choice(". ! ?".split()) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    texts += ["One sentence alone", "", None, "a. b. c.", "..."]
    rows = spark.createDataFrame([(1, i, t, 7) for i, t in enumerate(texts)], "query_id long, chunk_id long, content string, n_words int")
    got = {r.chunk_id: r for r in refine.compress_hits(rows, 20).collect()}
    for i, t in enumerate(texts):
        assert got[i].content == (None if t is None else plain(t, 20))
        if t is not None:
            assert len(refine.WORD.findall(got[i].content)) <= 20 and got[i].n_kept <= got[i].n_sentences


def test_long_contents_are_compressed_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(refine, "STRETCH", 10)
    text = " ".join(f"sentence number {i} of many words here." for i in range(95))
    short, kept, n = refine.compressed(text, 70)
    assert n == 95 and 0 < len(refine.WORD.findall(short)) <= 70
    order = [refine.sentences(text).index(s) for s in refine.sentences(short)]
    assert order == sorted(order) and len(order) == kept and max(order) > 80


def test_hits_of_a_search_keep_the_budget(spark):
    rows = q.compress_hits(spark, SF).collect()
    assert rows and all(len(refine.WORD.findall(r.content)) <= 60 for r in rows) and any(r.n_kept < r.n_sentences for r in rows)


def plain_summary(chunks, budget, ask):
    """chunks in order: the same levels by lists."""
    level, texts = 0, list(chunks)
    while True:
        pieces = [t[i : i + budget // 4] for t in texts for i in range(0, max(len(t), 1), budget // 4)]
        groups, at = {}, 0
        for p in pieces:
            groups.setdefault(at // (budget // 2), []).append(p)
            at += len(p) + 1
        asked = ["\n".join(g) for g in groups.values()]
        assert all(len(a) <= budget for a in asked)
        level += 1
        answers = [ask(a) for a in asked]
        if len(answers) == 1:
            return answers[0], level
        texts = [a[: budget // 8] for a in answers]


def test_summaries_equal_plain_levels(spark):
    seen = spark.sparkContext.accumulator(0)
    longest = 64 + len("\n\n" + refine.SUMMARY_ASK)

    def provider(prompts):
        seen.add(sum(len(p) > longest for p in prompts))
        return [f"{len(p)}:{p[:30]}" for p in prompts]

    rng = random.Random(5)
    docs = {d: ["".join(rng.choice("abc .") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(1, 30))] for d in range(12)}
    rows = spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)] + [(99, 0, None)], "document_id long, chunk_index long, content string")
    got = {r.document_id: (r.summary, r.levels) for r in refine.summarize(rows, provider, 64).collect()}
    ask = lambda a: provider_text(a)
    assert got == {d: plain_summary(ts, 64, ask) for d, ts in docs.items()} and seen.value == 0
    assert max(n for _, n in got.values()) <= 2 + math.ceil(math.log2(30 * 90 / 16))


def provider_text(text):
    p = text + "\n\n" + refine.SUMMARY_ASK
    return f"{len(p)}:{p[:30]}"


def test_a_failed_answer_is_the_documents_error(spark):
    def provider(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("refused")
        return ["fine" for _ in prompts]

    rows = spark.createDataFrame([(1, 0, "good " * 40), (2, 0, "x" * 100 + " bad " + "x" * 100)], "document_id long, chunk_index long, content string")
    got = {r.document_id: r.error for r in refine.summarize(rows, provider, 64).collect()}
    assert got[1] is None and got[2] == "RuntimeError: refused"


def test_every_document_gets_one_summary(spark):
    rows = q.summarize_documents(spark, SF).collect()
    some = fx.table(spark, SF, "documents").where("trim(text) <> ''").count()
    assert len(rows) == len({r.document_id for r in rows}) and some - 5 <= len(rows) <= some
