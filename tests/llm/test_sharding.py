"""Feistel sharding: a permutation, even shards, the same for any layout of the input."""

import zlib
from collections import Counter

import numpy as np
import pytest

from heliograph.llm import queries, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_and_its_inverse(n):
    numbers = np.arange(n)
    there = sharding.permute(numbers, n, 5)
    assert sorted(there) == list(range(n))
    assert (sharding.permute(there, n, 5, inverse=True) == numbers).all()
    if n > 60:
        assert (sharding.permute(numbers, n, 6) != there).any()
        assert (there == numbers).sum() < n / 5


def test_shards_do_not_depend_on_the_layout(spark):
    rows = [(i % 40 if i % 3 else None, "x" * (i % 5)) for i in range(500)] + [(7, "hot")] * 9000
    df = spark.createDataFrame(rows, "doc_id long, shard_of string")
    a = sharding.feistel_shards(df.repartition(7), 6).collect()
    b = sharding.feistel_shards(df.coalesce(1), 6).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))
    assert Counter((r.doc_id, r.shard_of) for r in a) == Counter(rows)
    by = {s: sorted(r.slot for r in a if r.shard == s) for s in range(6)}
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(slots == list(range(len(slots))) for slots in by.values())
    assert sorted(r.row_number for r in a) == list(range(len(rows)))


def test_empty_table(spark):
    assert sharding.feistel_shards(spark.createDataFrame([], "doc_id long"), 4).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op6_feistel_sharding(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
