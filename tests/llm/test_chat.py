from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import chat as c

PIECE = st.sampled_from(["<|", "|>", "<|end|>", "<|null|>", "<\\|", "\\", "\n", "<", "|", "%7C", "%", "user", "é", " ", "<|user|>\n"])
TEXT = st.lists(PIECE, max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, st.one_of(st.none(), TEXT)), max_size=5))
def test_turns_come_back(turns):
    text, escaped = c.render(turns)
    assert c.parse(text) == turns and 0 <= escaped <= len(turns)


def test_plain_turns_are_not_escaped():
    assert c.render([("user", "hi"), ("assistant", "a < b | c")]) == ("<|user|>\nhi<|end|>\n<|assistant|>\na < b | c<|end|>\n", 0)
    assert c.render([]) == ("", 0)
    for wrong in ("x", "<|user", "<|user|>\nhi", "<|user|>\nhi<|end|>"):
        assert c.parse(wrong) is None


def test_whole_table(spark):
    rows = [(1, 1, "assistant", "yo<|end|>\n"), (1, 0, "user", "hi"), (2, 0, None, None), (None, 3, "user", "a"), (None, 4, "user", ""), (1, 1, "assistant", "yo<|end|>\n"), (3, None, "user", "w " * 200_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, escaped string")
    rows_out = c.chat_texts(df).collect()
    out = {r.conv_id: r for r in rows_out}
    assert c.parse(out[1].text) == [("user", "hi"), ("assistant", "yo<|end|>\n"), ("assistant", "yo<|end|>\n")]
    assert (out[1].n_turns, out[1].escaped) == (3, 2)
    assert c.parse(out[2].text) == [("", None)]
    assert sorted(map(str, (c.parse(r.text) for r in rows_out if r.conv_id is None))) == ["[('user', '')]", "[('user', 'a')]"]
    assert len(c.parse(out[3].text)[0][1]) == 400_000
    assert c.chat_texts(df.limit(0)).count() == 0


def test_long_conversations_come_in_parts(spark):
    df = spark.range(10_000).selectExpr("7L as conv_id", "cast(9999 - id as int) as turn", "'user' as role", "concat('t', 9999 - id) as text", "1 as part")
    out = sorted(c.chat_texts(df, turns_at_once=3000).collect(), key=lambda r: r.part)
    assert [(r.part, r.n_turns) for r in out] == [(0, 3000), (1, 3000), (2, 3000), (3, 1000)]
    assert [t for r in out for _, t in c.parse(r.text)] == [f"t{i}" for i in range(10_000)]
