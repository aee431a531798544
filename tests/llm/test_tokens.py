import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.tokens import coder, id_bits, slices

PARTS = st.sampled_from([" ", "  ", "\n", "\t", "　", "\x1c", "It's", "été", "naïve", "42", "!!", "日本", "a", "don't ", " \n ", "'s"])
TEXT = st.one_of(st.none(), st.text(max_size=40), st.lists(PARTS, max_size=20).map("".join))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_ids_are_those_of_tiktoken(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    c = coder()
    whole = [c.encoding.encode_ordinary(t) if t else [] for t in texts]
    column = pa.array(texts, pa.string())
    ids, at = c.ids(column)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == whole
    assert c.counts(column).tolist() == [len(w) for w in whole] == [c.count(t) for t in texts]
    one = pa.array([None, *texts], pa.string()).slice(1)
    assert c.counts(one).tolist() == [len(w) for w in whole]


def test_parts_hold_every_row():
    column = pa.array(["a" * 10, None, "b" * 100, "", "c"] * 7)
    assert pa.concat_arrays(list(slices(column, 25))).equals(column)
    assert list(slices(column.slice(0, 0))) == []


def test_large_columns_in_parts():
    text = " ".join(f"word{i} naïve" for i in range(200_000))
    c = coder()
    column = pa.array([text, "a b", text * 5, None])
    ids, at = c.ids(column)
    assert np.array_equal(ids[: at[1]], c.encoding.encode_ordinary(text))
    assert c.counts(column).tolist() == np.diff(at).tolist()


def test_id_bits():
    assert [id_bits(n) for n in (1, 2, 3, 256, 257, 32000, 50257)] == [1, 1, 2, 8, 9, 15, 16]
