"""Alignment of two tokenizers against a plain version that encodes whole texts."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from rillwork.llm import queries, spans

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a▁b c", "x日本😁\U0001f9ff y", " ", "\n\n a ", "foo.\r\nbar's <s> <|endoftext|>", None, "", "aé" * 3000, "日本語" * 2000, " x 　 y", "tab\tx\n\ny  z", "it's.\nIt'll!\n$$$ a1b2", "x́ ́y", " a  b",
    "ab" * 70_000, "one two " * 200_000, "same text", "same text",
]


def ends(table, ids):
    out, at = [], 0
    for i in ids:
        at += len(table[i])
        out.append(at)
    return out


def plain(texts):
    t = spans.Tokenizers(A, B)
    groups = []
    for text in texts:
        groups.append(None)
        if text:
            a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
            if b"".join(t.a_bytes[i] for i in a) == (" " + text).encode() == b"".join(t.b_bytes[i] for i in b):
                a_end, b_end = ends(t.a_bytes, a), ends(t.b_bytes, b)
                common = sorted(set(a_end) & set(b_end))
                at_a, at_b = ({e: i + 1 for i, e in enumerate(x)} for x in (a_end, b_end))
                cuts = [(0, 0)] + [(at_a[c], at_b[c]) for c in common]
                groups[-1] = [(a[p:q], b[r:s]) for (p, r), (q, s) in zip(cuts, cuts[1:], strict=False)]
    links = [[] if g is None else [(x, y) for a, b in g for x in a for y in b] for g in groups]
    count = Counter(p for x in links for p in set(x))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for g, link in zip(groups, links, strict=True):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or [])
        n_a, n_b = (sum(len(x[k]) for x in g or []) for k in (0, 1))
        out.append((n_a, n_b, len(g or []), len(link), sum(count[p] == best[p[0]] for p in link), sum(count[p] for p in link), said))
    return out


@pytest.fixture(scope="module")
def case(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ODD
    return texts, plain(texts)


@pytest.mark.parametrize("broadcast", [spans.BROADCAST_PAIRS, 10])
def test_alignment_against_plain(spark, make_docs, case, broadcast):
    texts, want = case
    docs = make_docs([(None if i == 3 else i, t) for i, t in enumerate(texts)]).repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in spans.aligned(docs, A, B, broadcast_pairs=broadcast).collect()}
    assert got == {None if i == 3 else i: w for i, w in enumerate(want)}


def test_forgetting_segments_changes_nothing(spark, make_docs, case, monkeypatch):
    texts, want = case
    monkeypatch.setattr(spans, "KEPT_SEGMENTS", 50)
    monkeypatch.setattr(spans, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(spans, "TAKE_CHARS", 500)
    s = spans.Segments(spans.Tokenizers(A, B), True)
    import pyarrow as pa

    for i in range(0, len(texts), 20):
        place, end = s.placed(pa.array(texts[i : i + 20]))
        for w, lo, hi in zip(want[i : i + 20], end[:-1], end[1:], strict=True):
            assert ";".join(s.groups[p] for p in place[lo:hi]) == w[-1]


def test_nothing(spark, make_docs):
    assert spans.aligned(make_docs([]), A, B).count() == 0
    assert [tuple(r)[1:] for r in spans.aligned(make_docs([(1, None)]), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_op13(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for (i, _), w in zip(docs, plain([t for _, t in docs]), strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op13_token_alignment(spark, sf).collect()} == want


def test_words_are_encoded_once_whatever_sign_follows():
    import pyarrow as pa

    s = spans.Segments(spans.Tokenizers(A, B), True)
    texts = ["word word, word. word! wörd; wörd: wörd", "wörd, word? word"]
    place, end = s.placed(pa.array(texts))
    assert sorted(s.index) == sorted([" word", " wörd", *",.!;:?"])
    for want, lo, hi in zip(plain(texts), end[:-1], end[1:], strict=True):
        assert ";".join(s.groups[p] for p in place[lo:hi]) == want[-1]


def test_segments_start_at_spaces_and_signs():
    import random
    import re

    import numpy as np

    rng = random.Random(5)
    some = "aZé×÷ß²ɿʀя日😁 \n\t\r\x0b\x1c\x85\xa0  ​   　あ.,'_<@\\~09"
    space = re.compile(r"(?<=\S)(?=[ \n]\S)")
    both = re.compile(f"{space.pattern}|{spans.SIGNS}")
    for _ in range(2000):
        text = "".join(rng.choices(some, k=rng.randint(1, 30)))
        for signs, pattern in ((False, space), (True, both)):
            want = [len(text[: m.start()].encode()) for m in pattern.finditer(text) if m.start()]
            assert np.flatnonzero(spans._starts(np.frombuffer(text.encode(), np.uint8), signs)).tolist() == want


def test_random_texts_of_signs_and_spaces(spark, make_docs):
    import random

    rng = random.Random(6)
    some = [*"aZé×÷ß²я日😁 \n\t\xa0　.,'_<@\\~09", "́", " the", "'s", "ing", "</s>", "² .", "ä.", "Ж,"]
    texts = ["".join(rng.choices(some, k=rng.randint(1, 60))) for _ in range(500)]
    got = {r["doc_id"]: tuple(r)[1:] for r in spans.aligned(make_docs(list(enumerate(texts))), A, B).collect()}
    assert got == dict(enumerate(plain(texts)))
