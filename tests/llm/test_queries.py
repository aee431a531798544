import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from sparkloom.llm import bitpack, chat, mixing, packing, quality, queries, secret_scan, simhash, tokens

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_chat_sql_escapes_as_the_operator_does(spark):
    texts = ["plain", "a<|end|>\nb", "<|null|>", "x <\\| y", "<\\\\| and <| too", None, "", "ends <|end|>", "<|user|>\n"]
    rows = [(i // 3, i % 3, "user" if i % 2 else "ro|le%7C", t) for i, t in enumerate(texts)]
    schema = "conv_id long, turn long, role string, text string"
    conversations = spark.createDataFrame(rows, schema).toArrow()  # noqa: F841 - duckdb reads it by name
    got = chat.chat_texts(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.connect().sql(chat.ORACLE_SQL).fetchall())


def test_repetition_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fraction, longest = quality.profile([r.text for r in rows])
    want = {r.doc_id: (f, m) for r, f, m in zip(rows, fraction, longest) if f <= quality.MAX_FRACTION and m <= quality.MAX_LONGEST}
    got = {r.doc_id: (r.repeat_fraction, r.longest_repeat) for r in entry.queries()["op1_repetition"](spark, SF).collect()}
    assert got == want and 0 < len(want) < len(rows)


def test_packing_and_mixing_queries(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    count = {r.doc_id: tokens.coder().count(r.text) for r in rows}
    held, load = Counter(), {}
    for r in entry.queries()["op2_packing"](spark, SF).collect():
        held[r.doc_id] += r.n_tokens
        load.setdefault(r.window_id, [r.window_tokens, 0])[1] += r.n_tokens
    assert held == {i: n for i, n in count.items() if n} and all(a == b <= packing.CAPACITY for a, b in load.values())
    taken = Counter()
    for r in entry.queries()["op5_mixing"](spark, SF).collect():
        assert r.n_tokens == count[r.doc_id] and 0 < r.take_tokens <= r.n_tokens
        taken[r.source] += r.take_tokens
    totals = Counter()
    for r in rows:
        totals[r.source or ""] += count[r.doc_id]
    w = {s: round(n**mixing.ALPHA * 2**20) for s, n in totals.items() if n}
    assert sum(taken.values()) == sum(totals.values())
    assert all(abs(taken[s] - sum(totals.values()) * w[s] / sum(w.values())) < 1 for s in w)


def test_simhash_query(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    at, prints = simhash.fingerprints([r.text for r in rows])
    words = np.ascontiguousarray(prints).view(np.uint64)
    root = {rows[i].doc_id: rows[i].doc_id for i in at}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(at)):
        for b in np.flatnonzero(np.bitwise_count(words[:a] ^ words[a]).sum(axis=1) <= simhash.MAX_DISTANCE):
            x, y = sorted((find(rows[at[a]].doc_id), find(rows[at[b]].doc_id)))
            root[y] = x
    want = {(i, find(i)) for i in root if find(i) != i}
    assert {tuple(r) for r in entry.queries()["op3_simhash"](spark, SF).collect()} == want and want


def test_packed_ids_and_secrets_queries(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    coder = tokens.coder()
    bits = tokens.id_bits(coder.n_vocab)
    out = entry.queries()["op7_bitpack"](spark, SF).collect()
    assert {r.doc_id for r in out} == set(rows)
    for r in out:
        assert bitpack.unpack(r.packed, r.offsets, bits, r.n_tokens).tolist() == coder.encoding.encode_ordinary(rows[r.doc_id] or "")
    larger = SF.replace("0.001", "0.01")  # the smallest tables hold no secret
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text").collect()}
    want = sorted((i, a, b - a) for i, t in rows.items() for a, b, _ in secret_scan.findings(t, tokens.DEFAULT_VOCABULARY, secret_scan.MAX_RATIO))
    assert sorted((r.doc_id, r.start, r.length) for r in entry.queries()["op8_secrets"](spark, larger).collect()) == want and want
