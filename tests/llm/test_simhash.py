import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import simhash as s
from sparkloom.llm.components import components


def prose(rng, n, vocabulary=5000):
    return [f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(n)]


def corpus(seed=1, originals=250, copies=3, low=0.005, high=0.03):
    """Originals, and copies of them with a share of the words replaced."""
    rng = random.Random(seed)
    rows, group = [], []
    for g in range(originals):
        words = prose(rng, rng.randrange(80, 600))
        rows.append(" ".join(words))
        group.append(g)
        for _ in range(copies):
            rate = rng.uniform(low, high)
            rows.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < rate else w for w in words))
            group.append(g)
    return rows, np.array(group)


def brute(prints, most):
    words = np.ascontiguousarray(prints).view(np.uint64)
    a, b = np.triu_indices(len(words), 1)
    near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= most
    return {*zip(a[near].tolist(), b[near].tolist())}


def test_bound_is_below_the_distance():
    prints = np.random.default_rng(0).integers(0, 256, (60, 32), dtype=np.uint8)
    counts, words = s.unary(prints), prints.view(np.uint64)
    pairs = np.unpackbits(prints, axis=1).reshape(60, 128, 2).sum(axis=2).astype(int)
    for i in range(60):
        l1 = np.abs(pairs - pairs[i]).sum(axis=1)
        assert (np.bitwise_count(counts ^ counts[i]).sum(axis=1) == l1).all()
        assert (l1 <= np.bitwise_count(words ^ words[i]).sum(axis=1)).all()


def agree(prints):
    return sum((s._counts(prints) == v).mean(axis=0) ** 2 for v in range(3))


def meeting(prints, plan):
    """All pairs that meet in a cell of any band, one of them at home."""
    met = set()
    for rows, keys in s.cells(prints, plan):
        for cell in np.unique(keys >> 1):
            here = rows[keys >> 1 == cell]
            home = set(rows[keys == cell * 2].tolist())
            met |= {(min(a, b), max(a, b)) for a in home for b in here.tolist() if a != b}
    return met


def flipped(distance, n, seed=0):
    """Pairs of random fingerprints that differ in exactly ``distance`` bits."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (n, s.BITS), dtype=np.uint8)
    other = bits.copy()
    for row in other:
        row[rng.choice(s.BITS, distance, replace=False)] ^= 1
    return np.packbits(bits, axis=1), np.packbits(other, axis=1)


def same_cell(a, b, plan):
    """For pairs of rows: whether they meet in any band."""
    met = np.zeros(len(a), bool)
    for own, radius in plan:
        met |= np.abs(s._counts(a)[:, own].astype(int) - s._counts(b)[:, own].astype(int)).sum(axis=1) <= radius
    return met


def test_cells_hold_the_pairs_within_the_radius():
    _, prints = s.fingerprints(corpus(2, originals=40, copies=2, high=0.1)[0])
    plan = s.bands(3000, agree(prints))[:3] + [(np.arange(20), 1), (np.arange(30, 36), 0)]
    a, b = np.triu_indices(len(prints), 1)
    want = {*zip(a[same_cell(prints[a], prints[b], plan)].tolist(), b[same_cell(prints[a], prints[b], plan)].tolist())}
    assert meeting(prints, plan) == want and want


def test_the_search_is_exact_up_to_the_core_bands_bound():
    random_agree = np.full(s.SEGMENTS, 0.375)
    for n in (1000, 236_000, 15_000_000):
        plan = s.bands(n, random_agree)
        core = [own for own, radius in plan if radius]
        assert sorted(np.concatenate(core).tolist()) == list(range(s.SEGMENTS))
        assert same_cell(*flipped(min(2 * len(core) - 1, s.MAX_DISTANCE), 500), plan).all()
    tight = s.bands(236_000, random_agree, max_distance=9)
    assert len(tight) == 5 and same_cell(*flipped(9, 500), tight).all()


def test_recall_at_every_distance():
    for n in (236_000, 15_000_000):
        plan = s.bands(n, np.full(s.SEGMENTS, 0.375))
        share = {d: same_cell(*flipped(d, 1000, d), plan).mean() for d in (10, 20, 25, 30, 33, s.MAX_DISTANCE)}
        assert min(share.values()) >= s.RECALL - 0.025, share


def roots(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_links_connect_what_every_pair_does(monkeypatch):
    texts, group = corpus(3, originals=6, copies=40)
    _, prints = s.fingerprints(texts)
    truth = brute(prints, s.MAX_DISTANCE)
    assert len(truth) > 1000 and all(group[a] == group[b] for a, b in truth)
    n, home = len(prints), np.zeros(len(prints), np.int64)
    for pairs in (10**6, 1000, 7):
        monkeypatch.setattr(s, "PAIRS_AT_ONCE", pairs)
        found = s.links(home, prints, s.MAX_DISTANCE)
        assert roots(n, found) == roots(n, truth) and len(found) < n
    half = n // 2
    looking = np.where(np.arange(n) < half, 0, 1)
    assert roots(n, s.links(looking, prints, s.MAX_DISTANCE)) == roots(n, [(a, b) for a, b in truth if a < half])
    side = np.arange(n) % 2
    assert roots(n, s.links(home, prints, s.MAX_DISTANCE, side)) == roots(n, [(a, b) for a, b in truth if side[a] != side[b]])


def test_large_cells_are_compared_in_blocks(spark, monkeypatch):
    texts, _ = corpus(7, originals=30, copies=6, high=0.06)
    _, prints = s.fingerprints(texts)
    prints = np.unique(prints, axis=0)
    points = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(prints)], "id long, print binary").repartition(3)
    monkeypatch.setattr(s, "bands", lambda *_: [(np.arange(40, 60), 1), (np.arange(3), 1), (np.arange(5, 8), 0)])
    plain = [tuple(r) for r in s.near_edges(points).collect()]
    dealt = [tuple(r) for r in s.near_edges(points, hot=12, block=5).collect()]
    met = {p for p in brute(prints, s.MAX_DISTANCE) if p in meeting(prints, s.bands())}
    assert roots(len(prints), plain) == roots(len(prints), dealt) == roots(len(prints), met)


def test_batches_that_cut_cells():
    _, prints = s.fingerprints(corpus(8, originals=4, copies=9)[0])
    keys = np.sort(np.random.default_rng(0).integers(0, 12, len(prints)))
    words = np.ascontiguousarray(prints).view(np.int64)
    table = pa.table([pa.array(keys), pa.array(np.arange(len(keys))), *[pa.array(np.ascontiguousarray(c)) for c in words.T]], names=["key", "id", *s._WORDS])
    for hot in (3, 9, 1000):
        for rows, at_once in ((1, 1), (2, 5), (7, 3), (40, 1)):
            s.ROWS_AT_ONCE = at_once
            out = pa.Table.from_batches(s._compare(iter(table.to_batches(rows)), s.MAX_DISTANCE, hot)).to_pylist()
            sizes = np.bincount(keys >> 1)
            passed = sorted(r["id"] for r in out if r["u"] is None)
            assert passed == [i for i, k in enumerate(keys) if sizes[k >> 1] > hot]
            kept = np.flatnonzero(sizes[keys >> 1] <= hot)
            want = [(kept[a], kept[b]) for a, b in s.links(keys[kept], prints[kept], s.MAX_DISTANCE)]
            assert roots(len(keys), [(r["u"], r["v"]) for r in out if r["u"] is not None]) == roots(len(keys), want)
    s.ROWS_AT_ONCE = 50_000


def test_groups_on_spark(spark):
    texts, group = corpus(5, originals=60, copies=3, high=0.02)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0]) for i in range(50)]
    out = s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    rep = {r.doc_id: r.rep_doc_id for r in out}
    label = [*group, *[group[0]] * 50]
    ids = [r[0] for r in rows]
    first = {}
    for i, g in zip(ids, label):
        first.setdefault(g, i)
    right = sum(rep.get(i, i) == first[g] for i, g in zip(ids, label))
    assert right >= 0.97 * len(ids)
    assert all(rep.get(i) == 0 for i in range(1000, 1050))


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, " \n"), (5, "!!! ??"), (6, "!!! ??"), (None, "some words here"), (7, "some words here"), (7, "some words here"), (8, "Some  words here."), (9, "word " * 200_000), (10, "word " * 100_000)]
    df = spark.createDataFrame([(*r, "extra", "x") for r in rows], "doc_id long, text string, rep_doc_id string, _gone string")
    assert {(r.doc_id, r.rep_doc_id) for r in s.near_duplicates(df).collect()} == {(6, 5), (8, 7), (10, 9)}
    kept = s.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "7", "9", "None"]
    assert s.near_duplicates(df.limit(0)).count() == 0


def test_left_out_ids_may_be_too_many_to_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "the same few words" if i % 2 else f"other words {i}") for i in range(20)], "doc_id long, text string")
    want = sorted(map(str, s.drop_near_duplicates(df).collect()))
    monkeypatch.setattr(s, "BROADCAST_IDS", 0)
    assert sorted(map(str, s.drop_near_duplicates(df).collect())) == want
    with pytest.raises(TypeError):
        s.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_components_of_chains(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 202), (201, 202)]
    found = {(r.node, r.root) for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {(i, 0) for i in range(1, 41)} | {(101, 100), (201, 200), (202, 200)}


def test_every_near_pair_meets_at_any_size():
    for n in (1000, 236_000, 15_000_000, 10**10):
        for share in (0.375, 0.7):
            plan = s.bands(n, np.full(s.SEGMENTS, share))
            for distance in (11, 25, 30, s.MAX_DISTANCE):
                assert same_cell(*flipped(distance, 1000, distance), plan).all(), (n, share, distance)


def alike(n=400, seed=9):
    """Fingerprints that have most bits in common, far from each other, and for each one exactly at the limit."""
    rng = np.random.default_rng(seed)
    bits = np.tile(rng.integers(0, 2, s.BITS, dtype=np.uint8), (2 * n, 1))
    for row in range(n):
        bits[row, rng.choice(s.BITS, 48, replace=False)] ^= 1
        bits[n + row] = bits[row]
        bits[n + row, rng.choice(s.BITS, s.MAX_DISTANCE, replace=False)] ^= 1
    return np.packbits(bits, axis=1)


def test_large_cells_find_what_every_pair_does(monkeypatch):
    prints = alike(200)
    n = len(prints)
    monkeypatch.setattr(s, "SMALL", 20)
    keys = np.sort(np.r_[np.zeros(200, np.int64), np.ones(50, np.int64), np.full(n - 250, 2)])
    order, side = np.random.default_rng(1).permutation(n), np.arange(n) % 3
    shuffled = prints[order]
    truth = {p for p in brute(shuffled, s.MAX_DISTANCE) if keys[p[0]] >> 1 == keys[p[1]] >> 1 and not keys[p[0]] & 1}
    assert len(truth) > 50
    for pairs in (10**6, 1000, 7):
        monkeypatch.setattr(s, "PAIRS_AT_ONCE", pairs)
        assert roots(n, s.links(keys, shuffled, s.MAX_DISTANCE)) == roots(n, truth)
        want = [(a, b) for a, b in truth if side[a] != side[b]]
        assert roots(n, s.links(keys, shuffled, s.MAX_DISTANCE, side)) == roots(n, want) and want


def test_cells_full_of_near_rows_keep_one_link_a_row(monkeypatch):
    monkeypatch.setattr(s, "PAIRS_AT_ONCE", 50)
    bits = np.zeros((400, s.BITS), np.uint8)
    bits[np.arange(400), np.arange(400) % s.BITS] = 1
    assert len(s.links(np.zeros(400, np.int64), np.packbits(bits, axis=1), s.MAX_DISTANCE)) == 399


def test_edges_do_not_depend_on_the_count_of_points(spark, monkeypatch):
    prints = alike()
    monkeypatch.setattr(s, "agreement", lambda _: (15_000_000, np.full(s.SEGMENTS, 0.375)), raising=False)
    points = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(prints)], "id long, print binary")
    found = [tuple(r) for r in s.near_edges(points).collect()]
    truth = brute(prints, s.MAX_DISTANCE)
    assert len(truth) >= 400 and roots(len(prints), found) == roots(len(prints), truth)
