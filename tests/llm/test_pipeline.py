"""run() against the stages worked out in plain Python on a small table."""

import random
import sys
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from sparkloom.llm import mixing, packing, quality, secret_scan, simhash
from sparkloom.llm.tokens import DEFAULT_VOCABULARY, coder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    rng = random.Random(4)
    make = lambda n: " ".join(f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.randrange(10**4)}" for _ in range(n))
    rows = [(i, make(rng.randrange(20, 200)), "en", f"s{i % 3 if i % 2 else 0}") for i in range(60)]
    for i in range(10):
        words = rows[i][1].split()
        words[len(words) // 2] = "changed"
        rows.append((100 + i, " ".join(words), "en", "s1"))
    rows += [(200 + i, rows[20][1], "de", "s2") for i in range(8)]
    rows += [(300, "the same line again and again here\n" * 40, "en", "s0"), (301, "key 8fJq2LxT0vYw7RzBnC4mKd9PaGh3 end", "en", "s1"), (302, None, "en", None), (303, "", "en", "s2"), (None, "no id at all", None, "s1")]
    return [(*r, len(r[1] or "")) for r in rows]


def brute(spark, rows):
    """Rows kept by each stage, and the tokens of the last."""
    rows = [r for r, f, m in zip(rows, *quality.profile([r[1] for r in rows])) if f <= quality.MAX_FRACTION and m <= quality.MAX_LONGEST]
    counts = [len(rows)]
    at, prints = simhash.fingerprints([r[1] for r in rows])
    words = prints.view(np.uint64)
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    owners = [rows[i][0] for i in at]
    for a in range(len(at)):
        for b in range(a):
            if None not in (owners[a], owners[b]) and np.bitwise_count(words[a] ^ words[b]).sum() <= simhash.MAX_DISTANCE:
                x, y = sorted((find(owners[a]), find(owners[b])))
                root[y] = x
    rows = [r for r in rows if r[0] is None or find(r[0]) == r[0]]
    counts.append(len(rows))
    clean = []
    for r in rows:
        text, found = r[1], secret_scan.findings(r[1], DEFAULT_VOCABULARY, secret_scan.MAX_RATIO)
        for a, b, _ in reversed(found):
            text = text[:a] + secret_scan.MARK + text[b:]
        clean.append((r[0], text, r[3]))
    counts.append(len(clean))
    keys = {r.i: r.k for r in spark.createDataFrame([(r[0],) for r in clean], "i long").select("i", F.xxhash64(F.lit(mixing.SEED), "i").alias("k")).collect()}
    by = defaultdict(list)
    for i, text, source in clean:
        if n := coder().count(text):
            by[source or ""].append((keys[i], i, n))
    total = {s: sum(x[2] for x in v) for s, v in by.items()}
    w = {s: round(t**mixing.ALPHA * 2**20) for s, t in total.items()}
    exact = {s: Fraction(sum(total.values()) * w[s], sum(w.values())) for s in by}
    budgets = {s: int(x) for s, x in exact.items()}
    for s in sorted(by, key=lambda s: (budgets[s] - exact[s], s))[: sum(total.values()) - sum(budgets.values())]:
        budgets[s] += 1
    mixed = Counter()
    for s, docs in by.items():
        left = budgets[s]
        docs.sort()
        at = 0
        while left > 0:
            mixed[docs[at][1], docs[at][2]] += 1
            left -= docs[at][2]
            at = (at + 1) % len(docs)
    counts.append(sum(mixed.values()))
    return counts, mixed


def test_stages_and_run(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    counts, mixed = brute(spark, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() == counts[at], name
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert secret_scan.MARK in texts[301] and 300 not in texts
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = Counter()
    for (i, n), times in mixed.items():
        want[i] += n * times
    got, load = Counter(), Counter()
    for r in out:
        got[r.doc_id] += r.n_tokens
        load[r.window_id] += r.n_tokens
        assert r.window_tokens <= packing.CAPACITY
    assert got == want
    assert all(load[r.window_id] == r.window_tokens for r in out)


def test_clashing_columns_long_texts_and_ties(spark, tmp_path):
    rng = random.Random(8)
    long = " ".join(str(rng.randrange(10**9)) for _ in range(60_000))
    names = ["repeat_fraction", "longest_repeat", "_gone", "_source", "_doc", "_times", "n_tokens", "key", "copies", "group", "a b"]
    rows = [(r[0], r[1], r[2], r[3], r[4], *[f"{c}{i}" for c in names]) for i, r in enumerate(table()[:40])]
    rows += [(800, long, "en", "s0", len(long), *names), (7, rows[7][1], "en", rows[7][3], rows[7][4], *names)]
    schema = SCHEMA + "".join(f", `{c}` string" for c in names)
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {(r[0], r[5:]) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns and docs.dtypes == df.dtypes, name
        found = docs.collect()
        assert {(r[0], tuple(r)[5:]) for r in found} <= kept, name
        if name != "mixing":
            assert [len(r.text) for r in found if r.doc_id == 800] == [len(long)], name
            assert sum(r.doc_id == 7 for r in found) == 2, name  # rows that repeat an id stay together
    out = corpus_pipeline.packing_windows(spark, df, str(tmp_path)).where("doc_id = 800").collect()
    assert sum(r.n_tokens for r in out) == coder().count(long) and max(r.piece for r in out) > 10


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "secret scans", "mixing", "packing"]


def test_near_dedup_keeps_the_same_documents_in_a_large_table(spark, monkeypatch):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(250)]
    rows = [(i, " ".join(words)) for i, words in enumerate(base)]
    rows += [(1000 + i, " ".join([*words[24:], *(f"x{rng.randrange(10**6)}" for _ in range(24))])) for i, words in enumerate(base)]
    words = np.ascontiguousarray(simhash.fingerprints([r[1] for r in rows])[1]).view(np.uint64)
    apart = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2)
    a, b = np.nonzero(np.triu(apart <= simhash.MAX_DISTANCE, 1))
    assert len(a) > 100 and (b == a + 250).all()  # each near a single other one, so the later goes
    want = {i for i, _ in rows} - {rows[i][0] for i in b}
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    # what a count over a table of that size would say has no bearing on what is found
    monkeypatch.setattr(simhash, "agreement", lambda _: (15_000_000, np.full(simhash.SEGMENTS, 0.375)), raising=False)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
