"""The corpus pipeline: stages over `documents`, each written and read again.

Cases: null and empty texts go through every stage: they are scored, have no lines, are near copies of each other and
give one token. Rows with a null id stay in near dedup; rows that repeat an id are told apart by their texts, so each
stays that stands for a group of its own. Very long texts are taken whole. Extra columns pass through all stages but packing. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import lines, near, packing, quality_classifier, queries, simhash, toxicity
from rillwork.llm.shared import forget, settled


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject."""
    return quality_classifier.keep_quality(docs, _labels(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't reject."""
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites, but for the first place of each."""
    cleaned = lines.remove_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return simhash.one_of_each(docs, find=near.near_copies, with_print=near.with_print)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.packed_documents(docs, queries.end_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("line dedup", remove_boilerplate),
    ("near dedup", one_of_each),
    ("packing", pack),
]

#: The stages fit models, so SQL can't express them; tests/llm/test_text.py holds run() against the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`. Of what they write, the input of the last one stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))  # noqa: B023
        forget(spark, *before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
