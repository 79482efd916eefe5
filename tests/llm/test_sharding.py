import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardspark.llm import sharding

from .conftest import HARD


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 40, 41, 97, 1000])
def test_feistel_permutes(spark, total):
    rows = spark.range(total).select(sharding.feistel(F.col("id"), total, "k").alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(total))


def test_counts_differ_by_one_and_slots_are_gapless(make_docs):
    rows = sharding.shard_documents(make_docs(HARD * 7, extra=True), 5).collect()
    assert len(rows) == len(HARD) * 7
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    for r in rows:
        text = (HARD[r.doc_id % len(HARD)] or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 16, zlib.crc32(text))


def test_same_whatever_the_partitions(make_docs):
    docs = make_docs([f"text {i}" for i in range(200)])
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(docs.repartition(1)).collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(docs.repartition(7)).collect()}
    assert one == two
    other = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(docs, key="b").collect()}
    assert one != other


def test_null_and_repeated_ids_and_empty(make_docs):
    rows = sharding.shard_documents(make_docs([(None, "a", None)] * 3 + [(4, None, None)]), 2).collect()
    assert Counter(r.shard for r in rows) == {0: 2, 1: 2}
    assert sharding.shard_documents(make_docs([])).collect() == []
