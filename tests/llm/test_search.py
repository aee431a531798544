import math
import random
import re
import shutil

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import search as s

WORD = re.compile(r"\w+")


def brute(docs, queries, k):
    """Every document against every query."""
    bags = [(i, WORD.findall(t.lower())) for i, t in docs if i is not None and t and WORD.search(t)]
    n, mean = len(bags), sum(len(b) for _, b in bags) / max(1, len(bags))
    out = set()
    for q, text in queries:
        words = set(WORD.findall((text or "").lower()))
        scored = []
        for i, bag in bags:
            score = 0.0
            for w in words:
                tf, df = bag.count(w), sum(w in b for _, b in bags)
                if tf:
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (s.K1 + 1) / (tf + s.K1 * (1 - s.B + s.B * len(bag) / mean))
            if score > 0:
                scored.append((-round(score, 6), i))
        out |= {(q, r + 1, i) for r, (v, i) in enumerate(sorted(scored)[:k])}
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(n))
    docs = [(i, make(rng.randrange(1, 40))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(15)] + [(None, "w1 w2"), (2000, None), (2001, ""), (2002, " .,! "), (7, "w3 w3")]
    queries = [(i, make(rng.randrange(1, 12))) for i in range(25)] + [(90, docs[5][1]), (91, "unknown"), (92, None), (93, ""), (None, "w1")]
    d = spark.createDataFrame([(*r, "x", 1.0) for r in docs], "doc_id long, text string, rank string, score double").repartition(5)
    q = spark.createDataFrame(queries, "item_id long, text string")
    got = s.top_k(d, q, k=6).collect()
    want = brute(docs, [x for x in queries if x[0] is not None and x[1] is not None], 6)
    assert {(r.item_id, r["rank"], r.doc_id) for r in got} == want
    rounds = s.top_k(d, q, k=6, at_once=14).collect()
    assert {tuple(r) for r in rounds} == {tuple(r) for r in got}


def test_pruning_skips_blocks_and_loses_nothing(spark):
    # one block holds the good documents; the bound keeps the others from being decoded
    docs = [(i, "common filler words here " * 3) for i in range(1000)] + [(5000 + i, "rare gem common") for i in range(12)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame([(1, "rare gem common")], "item_id long, text string")
    got = s.top_k(d, q, k=10).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(5000, 5010))
    index = s.build_index(d).toArrow().combine_chunks().to_batches()
    words = ["common", "gem", "rare"]
    idf = np.log(1 + (1012 - np.array([1012, 12, 12]) + 0.5) / (np.array([1012, 12, 12]) + 0.5))
    own = s.Searcher([np.arange(3)], words, idf, (1000 * 12 + 36) / 1012, 10, np.zeros(1))
    found = [b for b in own.search(iter(index), False)]
    assert found[0].column("doc_id").to_pylist() == list(range(5000, 5010))
    assert own.blocks == 8 and own.decoded == 1


def test_bounds_are_above_every_score(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(1, 200)))) for i in range(400)]
    index = s.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).toArrow().combine_chunks().to_batches()[0]
    words = [f"w{i}" for i in range(0, 40, 3)]
    own = s.Searcher([], words, np.linspace(0.1, 2, len(words)), 80.0, 10, np.zeros(0))
    held, offsets = s._known(index.column("words"), pa.array(words))
    for row, a, b in zip(index.drop_columns(["words"]).to_pylist(), offsets, offsets[1:]):
        block = s.Block(row, held[a:b], own)
        bound = np.zeros(len(words))
        bound[block.terms[block.found]] = block.bound
        _, _, term, impact = block.forward
        assert (impact <= bound[term] + 1e-12).all() and len(term)


def test_an_index_answers_later_batches_without_the_texts(spark, tmp_path):
    docs = [(i, f"word{i % 7} text{i}") for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    s.build_index(spark.read.parquet(f"{tmp_path}/docs")).write.parquet(f"{tmp_path}/index")
    shutil.rmtree(tmp_path / "docs")
    index = spark.read.parquet(f"{tmp_path}/index")
    for asked in ([(1, "word3")], [(2, "text9 word5"), (3, "nothing else")]):
        got = s.search(index, spark.createDataFrame(asked, "item_id long, text string"), k=4).collect()
        assert {(r.item_id, r["rank"], r.doc_id) for r in got} == brute(docs, asked, 4)


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        s.build_index(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_nothing_to_search(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert s.top_k(d, q).count() == 0
    assert s.top_k(q.withColumnRenamed("item_id", "doc_id"), q.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    long = spark.createDataFrame([(1, "a " * 300_000 + "b")], "doc_id long, text string")
    assert s.top_k(long, q).count() == 1
