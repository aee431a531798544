from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing as m
from sparkloom.llm.tokens import coder

ROWS = [(i, "word " * (1 + i * 7 % 40), ["a", "a", "a", "b", "c", None][i % 6]) for i in range(120)]
ROWS += [(500, None, "a"), (501, "", "b"), (3, "twice here", "b"), (3, "twice here", "b"), (None, "no id", "a"), (600, None, "empty")]
SCHEMA = "doc_id long, text string, source string, n_tokens string, key string, epoch int"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", "y", 5) for r in rows], SCHEMA)


def brute(spark, rows, weights=None, tokens=None):
    """The mixture, source by source, in plain Python; the keys are Spark's hash."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    keys = {r.i: r.k for r in spark.createDataFrame([(i,) for i in [*ids, None]], "i long").select("i", F.xxhash64(F.lit(m.SEED), "i").alias("k")).collect()}
    by = defaultdict(list)
    for i, text, source in rows:
        n = coder().count(text)
        if n:
            by[source or ""].append((keys[i], i is not None, i or 0, n, i))
    total = {s: sum(x[3] for x in v) for s, v in by.items()}
    w = {s: Fraction(weights.get(s, 0)) if weights is not None else round(total[s] ** m.ALPHA * 2**20) for s in by}
    wanted = sum(total.values()) if tokens is None else tokens
    exact = {s: Fraction(wanted) * w[s] / (sum(w.values()) or 1) for s in by}
    budgets = {s: int(x) for s, x in exact.items()}
    left = (wanted if sum(w.values()) else 0) - sum(budgets.values())
    for s in sorted(by, key=lambda s: (budgets[s] - exact[s], s))[:left]:
        budgets[s] += 1
    out = []
    for s, docs in by.items():
        budget = budgets[s]
        epoch = at = 0
        docs.sort()
        while budget > 0:
            n = docs[at][3]
            out.append((s, epoch, docs[at][4], n, min(n, budget)))
            budget -= n
            at += 1
            if at == len(docs):
                epoch, at = epoch + 1, 0
    return sorted(map(str, out))


def test_matches_brute_force(spark):
    for weights, tokens in ((None, None), ({"a": 1, "b": 3, "": 0.5}, 20_000), ({"c": 1}, 37), ({}, 100), ({"a": 1.0}, 0), ({"a": 1, "b": 1, "c": 1, "": 1e-9}, 20_001)):
        got = m.mixture(frame(spark), weights, tokens, ranges=16).select("source", "epoch", "doc_id", "n_tokens", "take_tokens").collect()
        assert sorted(str(tuple(r)) for r in got) == brute(spark, ROWS, weights, tokens), (weights, tokens)


def test_budgets_are_exact(spark):
    got = m.mixture(frame(spark), {"a": 2, "b": 1, "c": 1}, 10_000).groupBy("source").agg(F.sum("take_tokens").alias("n")).collect()
    assert {r.source: r.n for r in got} == {"a": 5000, "b": 2500, "c": 2500}


def test_light_sources_keep_their_share(spark):
    rows = [(i, "word " * 50, "web") for i in range(200)] + [(900, "word " * 50, "rare")]
    got = m.mixture(frame(spark, rows), {"web": 0.9996, "rare": 0.0004}, 100_000).groupBy("source").agg(F.sum("take_tokens").alias("n")).collect()
    assert {r.source: r.n for r in got} == {"web": 99_960, "rare": 40}
    totals = spark.createDataFrame([(f"s{i}", 10) for i in range(3000)], "source string, total long")
    own = m.budgets(totals, None, 10_000)
    assert own.groupBy().sum("budget").first()[0] == 10_000 and own.where("budget in (3, 4)").count() == 3000
    for wrong in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            m.budgets(totals, {"s1": wrong}, 5)


def test_thousands_of_epochs(spark):
    rows = [(1, "tiny one", "t"), (2, "word " * 3000, "big")]
    n = coder().count("tiny one")
    got = m.mixture(frame(spark, rows), {"t": 1, "big": 1}, 20_000 * n)
    assert got.where("source = 't'").agg(F.count("*"), F.max("epoch"), F.sum("take_tokens")).first()[:] == (10_000, 9_999, 10_000 * n)
    assert m.mix_documents(frame(spark, rows), {"t": 1}, 10_000 * n).count() == 10_000


def test_many_sources_are_salted(spark, monkeypatch):
    want = sorted(map(str, m.mix_documents(frame(spark)).collect()))
    monkeypatch.setattr(m, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, m.mix_documents(frame(spark)).collect())) == want


def test_documents_follow_the_mixture(spark):
    df = frame(spark)
    for weights, tokens in ((None, None), ({"a": 1, "b": 3}, 9000)):
        want = defaultdict(int)
        for r in m.mixture(df, weights, tokens).collect():
            want[r.doc_id, r.n_tokens] += 1
        out = m.mix_documents(df, weights, tokens)
        assert out.columns == df.columns
        got = defaultdict(int)
        for r in out.collect():
            got[r.doc_id, coder().count(r.text)] += 1
        extra = {k: v for k, v in got.items() if v != want.get(k, 0)}
        # only rows that repeat the id at a cut may come once more
        assert all(k[0] == 3 for k in extra) and set(want) <= set(got)


def test_nothing_to_mix(spark):
    df = frame(spark)
    assert m.mixture(df.limit(0)).count() == 0 and m.mix_documents(df.limit(0)).count() == 0
    assert m.mixture(df.where("source = 'empty'")).count() == 0
    long = frame(spark, [(1, "many words " * 200_000, "a"), (2, "few", "b")])
    assert m.mixture(long, {"b": 1}, 5).groupBy().sum("take_tokens").first()[0] == 5
