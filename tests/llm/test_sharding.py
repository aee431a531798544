from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import sharding as s


def brute(sizes, shards):
    """The smallest largest part over all ways to cut."""
    n = len(sizes)
    best = None
    for parts in range(1, min(shards, n) + 1):
        for cuts in combinations(range(1, n), parts - 1):
            edges = [0, *cuts, n]
            most = max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:]))
            best = most if best is None else min(best, most)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=9), st.integers(1, 5))
def test_capacity_is_the_smallest(sizes, shards):
    capacity, ends = s.minimax_cuts(np.array(sizes), shards)
    assert capacity == brute(sizes, shards)
    edges = [0, *ends]
    assert len(ends) <= shards and ends[-1] == len(sizes)
    assert all(sum(sizes[a:b]) <= capacity for a, b in zip(edges, edges[1:]))


def test_whole_table(spark):
    rows = [(i % 37, i % 11, "x") for i in range(500)] + [(None, 3, "y"), (None, None, "y"), (40, None, "z"), (41, 0, "z")]
    df = spark.createDataFrame(rows, "conv_id long, n long, shard string")
    out = s.shard(df, "conv_id", F.col("n"), 5).collect()
    sizes = {}
    for k, n, _ in rows:
        sizes[k] = sizes.get(k, 0) + (n or 0)
    assert {r.conv_id: r.size for r in out} == sizes
    order = sorted(out, key=lambda r: (r.conv_id is not None, r.conv_id))
    assert [r.shard for r in order] == sorted(r.shard for r in out)
    capacity, _ = s.minimax_cuts(np.array([r.size for r in order]), 5)
    assert max(r.shard_size for r in out) == capacity
    for r in out:
        assert r.shard_size == sum(x.size for x in out if x.shard == r.shard)
    assert s.shard(df.limit(0), "conv_id", F.col("n")).count() == 0
    assert {r.shard for r in s.shard(df, "conv_id", F.lit(1), 1).collect()} == {0}


def test_text_keys(spark):
    df = spark.createDataFrame([(f"k{i:03d}", "a" * i) for i in range(50)], "k string, t string")
    out = s.shard(df, "k", F.octet_length("t"), 4).collect()
    assert max(r.shard_size for r in out) == s.minimax_cuts(np.arange(50), 4)[0]


def test_key_columns_that_clash(spark):
    df = spark.createDataFrame([(i, i) for i in range(20)], "size long, shard long")
    out = s.shard(df, "size", F.col("shard"), 3)
    assert out.columns == ["key", "size", "shard", "shard_size"] and {r.key: r.size for r in out.collect()} == {i: i for i in range(20)}
