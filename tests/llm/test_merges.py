"""Ids of a merge model against the library's."""

import random

import public_tokenizers
import pytest

from rillwork.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "Hello  world", " lead", "trail ", "   ", "héllo 你好 🙂", "\n\ta b", "a" * 500, "12345 678", "The and attion to thanedble the, anea."]


@pytest.mark.parametrize("long_word", [1, 64])
def test_merges_equal_the_library(monkeypatch, long_word):
    import sentencepiece

    monkeypatch.setattr(pieces, "LONG_WORD", long_word)
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choice("the anrio e  é\n.你") for _ in range(rng.randint(1, 90))) for _ in range(200)]
    table = pieces.PieceTable.for_model(MODEL)
    offsets, ids = table.encode(texts)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [lib.encode(t) for t in texts]
    assert table.decode(offsets, ids) == texts


def test_encoded_column_equals_the_library(spark, make_docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = pieces.encoded(make_docs(list(enumerate(TEXTS))), MODEL).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: lib.encode(t) for i, t in enumerate(TEXTS)}
