"""Quality rules as a ledger of failure bits.

Every rule is evaluated once; a row of the ledger holds the measurements and a bit for each rule that failed.
Policies are versioned bit masks over the ledger, so a policy changes, or is ablated, without reading texts again.

Cases: a null or empty text has no words and measurements of 0; its ratios are 0. Equal rows give equal rows.
An empty table gives an empty ledger. Other columns of the input, whatever their names, are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.shared import map_texts

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct_words long, longest_word long, n_upper long, n_chars long"


def repeat_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that are found twice or more. Exact: windows get dense numbers by doubling, no hashes."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    rank, step = codes.astype(np.int64), 1
    while step < window:
        if len(rank) <= step:
            return 0
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step *= 2
    often = np.bincount(rank)[rank] > 1 if len(rank) else np.zeros(0, bool)
    if not often.any():
        return 0
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of a text, in the order of MEASURES."""
    raw = (text or "").encode()
    words = raw.split()  # on bytes, white space is exactly 09-0D and 20
    lines = [x for x in raw.split(b"\n") if x.strip()]
    codes = {}
    ranks = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    chars = len(text or "")
    spaces = len(raw) - sum(map(len, words))
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return (len(words), chars - spaces, symbols, len(lines) - len(set(lines)), repeat_words(ranks), len(lines), len(codes), max(map(len, codes), default=0), upper, chars)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measurements for each document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def each():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(t) for t in _texts(part)]
            cols = np.array(rows, np.int64).reshape(len(rows), len(names)).T
            return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in cols)], ["doc_id", *names])

        return work

    return map_texts(docs, each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def _texts(part: pa.RecordBatch) -> Iterator[str | None]:
    return (x.as_py() for x in part.column(1))


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails` is true."""

    name: str
    fails: Column


def base_rules() -> list[Rule]:
    """The two rules that hold under any policy."""
    return [Rule("few_words", F.col("n_words") < 20), Rule("repeated_windows", 100 * F.col("n_repeat_words") > 30 * F.col("n_words"))]


def default_rules() -> list[Rule]:
    """In ledger order: a rule's place is its bit. New rules go to the end."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        *base_rules(),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * words),
        Rule("dup_lines", (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) & (F.col("n_dup_lines") >= 3)),
        Rule("short_words", 2 * F.col("word_chars") < 4 * words),
        Rule("long_words", F.col("word_chars") > 15 * words),
        Rule("few_distinct_words", (20 * F.col("n_distinct_words") < F.col("n_words")) & (F.col("n_words") >= 100)),
        Rule("shouting", 2 * F.col("n_upper") > F.col("word_chars")),
        Rule("endless_word", F.col("longest_word") > 1000),
    ]


#: Policies by version: the names of the rules whose failure rejects a document.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "dup_lines", "short_words", "long_words", "few_distinct_words", "shouting", "endless_word"),
}


def mask_of(names: tuple[str, ...] | list[str], rules: list[Rule]) -> int:
    """The bits of the named rules."""
    bit = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bit[x] for x in set(names))


def ledger(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and `failures`, a long with a bit for each failed rule."""
    rules = default_rules() if rules is None else rules
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules at most")
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(r.fails, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measures(docs, id_col, text_col).withColumn("failures", bits)


def apply_policy(rows: DataFrame, mask: int, name: str = "kept") -> DataFrame:
    """True where no rule of the mask failed."""
    return rows.withColumn(name, F.col("failures").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablation(rows: DataFrame, names: tuple[str, ...] | list[str], rules: list[Rule] | None = None) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail only it, and that the policy without it keeps.

    The ledger is first counted by its distinct masks, of which there are few; the rest is bitwise sums.
    """
    rules = default_rules() if rules is None else rules
    mask = mask_of(names, rules)
    masks = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("failed")).agg(F.count("*").alias("n"))
    one = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if r.name in names))).alias("r")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    failed, bit = F.col("failed"), F.col("r.bit")
    return (
        masks.select("failed", "n", one)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(n(failed.bitwiseAND(bit) != 0).alias("n_failed"), n(failed == bit).alias("n_only"), n(failed == 0).alias("kept"), n(failed.bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without"))
    )


def rule_verdicts(docs: DataFrame, policy: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with base_failed and kept under a policy; a policy never keeps what the base rules fail."""
    rules = default_rules()
    base = mask_of([r.name for r in base_rules()], rules)
    rows = apply_policy(ledger(docs, rules, id_col, text_col), base | mask_of(POLICIES[policy], rules))
    return rows.withColumn("base_failed", F.col("failures").bitwiseAND(F.lit(base).cast("long")) != 0)
