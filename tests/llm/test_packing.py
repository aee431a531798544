from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import packing as p
from sparkloom.llm.mixing import repeated
from sparkloom.llm.tokens import coder


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40), st.integers(1, 8))
def test_differencing_places_every_item_once(sizes, k):
    found = p.differencing(sizes, k)
    assert sorted(i for _, items in found for i in items) == list(range(len(sizes)))
    assert all(total == sum(sizes[i] for i in items) for total, items in found) and len(found) <= k


def dense(sizes, k):
    """The same differencing on whole vectors, zeros and all; ties in the same order."""
    parts = [(sorted([s] + [0] * (k - 1), reverse=True), n) for n, s in enumerate(sizes)]
    ticket = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda x: (-(x[0][0] - x[0][-1]), x[1]))
        (a, _), (b, _), *rest = parts
        parts = [*rest, (sorted((x + y for x, y in zip(a, reversed(b))), reverse=True), ticket)]
        ticket += 1
    return parts[0][0] if parts else [0] * k


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=25), st.integers(2, 6))
def test_differencing_is_that_of_whole_vectors(sizes, k):
    found = [total for total, _ in p.differencing(sizes, k)]
    assert sorted(found + [0] * (k - len(found)), reverse=True) == dense(sizes, k)


def test_classic_example():
    assert sorted(t for t, _ in p.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    best = min(max(sum(s for s, w in zip((8, 7, 6, 5, 4), put) if w == x) for x in range(3)) for put in product(range(3), repeat=5))
    assert p.differencing([8, 7, 6, 5, 4], 3)[0][0] - best <= 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_windows_stay_within_capacity(sizes):
    found = p.windows(sizes, 50)
    assert all(total <= 50 for total, _ in found)
    assert sorted(i for _, items in found for i in items) == list(range(len(sizes)))
    least = -(-sum(sizes) // 50)
    assert len(found) <= max(least * 2, least + 2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=8))
def test_no_fewer_windows_than_needed(sizes):
    def fewest(left, loads):
        if not left:
            return len(loads)
        rest = [fewest(left[1:], [*loads[:i], x + left[0], *loads[i + 1 :]]) for i, x in enumerate(loads) if x + left[0] <= 50]
        return min([*rest, fewest(left[1:], [*loads, left[0]])])

    assert p.least_windows(sizes, 50) <= fewest(sizes, []) <= len(p.windows(sizes, 50)) <= len(sizes)


def test_repeated_rows_cost_no_more_than_others(spark):
    assert len(p.windows([1500] * 4000, 4096)) == 2000
    df = spark.createDataFrame([(1, "some few words")], "doc_id long, text string")
    many = df.unionByName(df.selectExpr("cast(null as long) as doc_id", "text")).crossJoin(spark.range(20_000)).drop("id")
    n = coder().count("some few words")
    out = p.pack(many, capacity=256).cache()
    load = out.groupBy("window_id", "window_tokens").sum("n_tokens").collect()
    assert sum(r[2] for r in load) == 40_000 * n and all(r[1] == r[2] <= 256 for r in load)
    assert len(load) <= 1.1 * (40_000 // (256 // n))
    assert {(r.doc_id, r["count"]) for r in out.groupBy("doc_id").count().collect()} == {(1, 20_000), (None, 20_000)}


def test_ids_of_other_types_and_clashing_names(spark):
    rows = [(str(i), "some words " * (i + 1), 1, "g", 2) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id string, text string, copies int, group string, n_tokens int")
    assert sorted({r.doc_id for r in p.pack(df, capacity=64).collect()}) == sorted(r[0] for r in rows)


def test_repeated_numbers_every_copy(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 10_000), ("d", 1), ("e", -2)], "x string, n long")
    got = {}
    for r in repeated(df, "n", "at").collect():
        got.setdefault(r.x, []).append(r.at)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [0, 1, 2], "c": list(range(10_000)), "d": [0]}


def test_windows_are_near_equal():
    sizes = np.random.default_rng(0).integers(10, 900, 400).tolist()
    totals = [t for t, _ in p.windows(sizes, 4096)]
    assert max(totals) - min(totals) <= 41 and len(totals) <= -(-sum(sizes) // 4096) + 1


def test_whole_table(spark):
    rows = [(i, "word " * (1 + i * 37 % 300)) for i in range(200)] + [(900, "long text " * 3000), (None, "no id"), (None, "no id"), (5, "again"), (901, None), (902, ""), (903, "w" * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, window_id string")
    out = p.pack(df, capacity=500, group_windows=4).collect()
    count = {}
    for i, text in rows:
        count[i] = count.get(i, 0) + coder().count(text)
    got = {}
    load = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        load[r.window_id] = load.get(r.window_id, 0) + r.n_tokens
        assert r.start_token == r.piece * 500
    assert got == {i: n for i, n in count.items() if n}
    assert all(load[r.window_id] == r.window_tokens <= 500 for r in out)
    assert p.pack(df.limit(0)).count() == 0
