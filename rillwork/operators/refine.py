"""Shorter texts for a model: hits cut to their central sentences, and documents summed up level by level."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.operators.provider import Completion, complete, echo, slices
from rillwork.tables import written

#: Tokens that a compressed hit may have; weight of being central against being new; share of the walk that follows similarity.
BUDGET, CENTRAL, FOLLOW, ROUNDS = 200, 0.7, 0.85, 30
#: Sentences that are compared with each other; longer contents are compressed stretch by stretch.
STRETCH = 500
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\s*\n+\s*|(?<=[。！？])")
WORD = re.compile(r"[^\W_]+")

#: Characters of a summary prompt's text, at most, and its request.
PROMPT_CHARS = 4000
SUMMARY_ASK = "Sum up the text above in a few sentences. Answer with these alone."


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in SENTENCE.split(text)) if s]


def similarities(parts: list[list[str]]) -> np.ndarray:
    """Cosines of the sentences' word counts; 0 on the diagonal."""
    place: dict[str, int] = {}
    for p in parts:
        for w in p:
            place.setdefault(w, len(place))
    m = np.zeros((len(parts), max(len(place), 1)))
    for i, p in enumerate(parts):
        for w in p:
            m[i, place[w]] += 1
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    s = np.round(m @ m.T, 9)
    np.fill_diagonal(s, 0.0)
    return s


def centrality(similar: np.ndarray) -> np.ndarray:
    """How often a walk along similarities is at each sentence, by power iteration; the largest is 1."""
    n = len(similar)
    out = similar.sum(axis=1, keepdims=True)
    step = np.where(out > 0, np.divide(similar, out, out=np.zeros_like(similar), where=out > 0), 1 / n)
    at = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        at = (1 - FOLLOW) / n + FOLLOW * (at @ step)
    return np.round(at / at.max(), 9)


def chosen(parts: list[str], budget: int) -> list[int]:
    """Sentences that stay, in their order: again and again the best one that fits, by centrality less the similarity to
    the nearest one that was taken. Equal ones go by place."""
    words = [WORD.findall(p.lower()) for p in parts]
    size = np.array([len(w) for w in words])
    similar = similarities(words)
    central, nearest = centrality(similar), np.zeros(len(parts))
    left, taken, free = budget, [], size > 0
    while True:
        fits = free & (size <= left)
        if not fits.any():
            return sorted(taken)
        value = np.where(fits, CENTRAL * central - (1 - CENTRAL) * nearest, -np.inf)
        i = int(np.argmax(np.round(value, 9)))
        taken.append(i)
        free[i] = False
        left -= int(size[i])
        nearest = np.maximum(nearest, similar[i])


def compressed(text: str, budget: int) -> tuple[str, int, int]:
    """The text's central sentences within a budget of words, their number, and how many sentences there are."""
    parts = sentences(text)
    n = [len(WORD.findall(p)) for p in parts]
    if sum(n) <= budget:
        return text, len(parts), len(parts)
    kept: list[str] = []
    used = seen = 0
    for at in range(0, len(parts), STRETCH):  # the budget is shared by words; what a stretch leaves the next one has
        seen += sum(n[at : at + STRETCH])
        taken = [at + i for i in chosen(parts[at : at + STRETCH], budget * seen // sum(n) - used)]
        kept += [parts[i] for i in taken]
        used += sum(n[i] for i in taken)
    return " ".join(kept), len(kept), len(parts)


def compress_hits(hits: DataFrame, budget: int = BUDGET, text: str = "content") -> DataFrame:
    """Hits with content cut to its central sentences, in their order, and n_kept and n_sentences. Null stays null."""
    names = hits.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            got = [(None, None, None) if t is None else compressed(t, budget) for t in batch.column(at).to_pylist()]
            short, kept, n = (pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64())))
            yield pa.RecordBatch.from_arrays([*(short if i == at else c for i, c in enumerate(batch.columns)), kept, n], [*names, "n_kept", "n_sentences"])

    schema = hits.withColumns({"n_kept": F.lit(None).cast("long"), "n_sentences": F.lit(None).cast("long")}).schema
    return hits.mapInArrow(run, schema)


def grouped(parts: DataFrame, budget: int) -> DataFrame:
    """Texts of neighbours joined: document_id, part and text, `budget` characters at most.

    parts: document_id, part, text. A text is cut into pieces of a quarter of the budget; pieces that begin in the same half
    of it, counted from the document's start, go together, so two pieces or more as long as there are any.
    """
    piece = budget // 4
    cut = parts.withColumn("n", F.greatest(F.ceil(F.length("text") / piece), F.lit(1)).cast("int")).select("document_id", "part", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    cut = cut.select("document_id", "part", "i", F.substring(F.col("text"), F.col("i") * piece + 1, F.lit(piece)).alias("text"))
    w = Window.partitionBy("document_id").orderBy("part", "i").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("group", F.floor(F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)) / (budget // 2)))
    pieces = F.array_sort(F.collect_list(F.struct("part", "i", "text")))
    return cut.groupBy("document_id", F.col("group").alias("part")).agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "\n").alias("text"))


def summary_prompt(text: str = "text"):
    return F.concat(F.col(text), F.lit("\n\n" + SUMMARY_ASK))


def summarize(chunks: DataFrame, provider: Completion = echo, budget: int = PROMPT_CHARS, levels: int = 64) -> DataFrame:
    """document_id, summary, levels (rounds of asking) and error, from chunks (document_id, chunk_index, content).

    Chunks are grouped up to the budget and each group is asked for; the answers, cut at an eighth of the budget, are grouped
    again, until a document has one. So no prompt's text passes the budget, and answers become fewer by a half at least with
    each level. A level is a written table. A failed answer is empty, and its error stays with the document.
    """
    if budget < 64:
        raise ValueError("a budget of 64 characters at least")
    now = written(grouped(chunks.where("content is not null").select("document_id", F.col("chunk_index").alias("part"), F.col("content").alias("text")), budget), "summary-level")
    now = now.withColumn("error", F.lit(None).cast("string"))
    done = None
    for level in range(1, levels + 1):
        answers = written(_answered(now, provider).withColumn("n", F.count("*").over(Window.partitionBy("document_id"))), "summary-answers")
        last = answers.where("n = 1").select("document_id", F.col("text").alias("summary"), F.lit(level).cast("long").alias("levels"), "error")
        done = last if done is None else done.unionByName(last)
        more = answers.where("n > 1")
        if not more.limit(1).count():
            return done
        errors = more.groupBy("document_id").agg(F.max("error").alias("error"))
        now = written(grouped(more.select("document_id", "part", F.substring("text", 1, budget // 8).alias("text")), budget).join(errors, "document_id"), "summary-level")
    raise RuntimeError(f"documents didn't come down to one summary in {levels} levels")


def _answered(rows: DataFrame, provider: Completion) -> DataFrame:
    """document_id, part, text (the answer) and error, the first one of the document's line."""
    got = complete(rows.select(F.struct("document_id", "part", "error").alias("key"), summary_prompt().alias("prompt")), provider, ("key",))
    return got.select("key.document_id", "key.part", F.coalesce("response", F.lit("")).alias("text"), F.coalesce("key.error", "error").alias("error"))
