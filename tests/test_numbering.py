"""Numbers by ranges where the optimiser merges ranges."""

import hashlib

import pytest

from rillwork.operators import evaluate


@pytest.fixture
def merged(spark):
    """Small ranges are merged, by their sizes, which differ between plans with other columns."""
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_split_takes_the_first_of_the_order(merged):
    n = 20_000
    want = sorted(range(n), key=lambda i: hashlib.md5(f"{i}:0".encode()).hexdigest())[: round(n * 0.3)]
    split = evaluate.auto_split(merged.range(n).withColumnRenamed("id", "document_id"), 0.3)
    got = evaluate.split_manifest(split, 0.3).where("side = 'included'").toPandas()["document_id"]
    assert sorted(got) == sorted(want)
