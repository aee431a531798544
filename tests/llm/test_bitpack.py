import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import bitpack as b
from sparkloom.llm.tokens import coder


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=60), st.integers(1, 20), st.integers(0, 70), st.integers(0, 70))
def test_round_trip_of_any_range(bits, ids, block, start, stop):
    ids = np.array(ids, np.uint64).astype(np.uint64) % (1 << bits)
    ids = ids.astype(np.uint32)
    packed, offsets = b.pack_ids(ids, bits, block)
    assert np.array_equal(b.unpack(packed, offsets, bits, len(ids), block=block), ids)
    assert np.array_equal(b.unpack(packed, offsets, bits, len(ids), start, stop, block), ids[start:stop])
    assert offsets[-1] == len(packed) and len(packed) <= -(-len(ids) * bits // 8) + len(offsets)


def test_whole_table(spark):
    rows = [(1, "some text here, naïve"), (2, None), (3, ""), (1, "some text here, naïve"), (None, "no id"), (4, "a long text " * 40_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bits string")
    out = b.packed_ids(df, block=100).collect()
    assert len(out) == len(rows)
    want = {i: coder().encoding.encode_ordinary(t or "") for i, t in rows}
    for r in out:
        assert b.unpack(bytes(r.packed), r.offsets, r.bits, r.n_tokens, block=100).tolist() == want[r.doc_id]
        assert r.bits == 16 and r.n_tokens == len(want[r.doc_id])
    last = next(r for r in out if r.doc_id == 4)
    assert b.unpack(bytes(last.packed), last.offsets, last.bits, last.n_tokens, 777, 1234, 100).tolist() == want[4][777:1234]
    assert b.packed_ids(df.limit(0)).count() == 0
