import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import quality as q


def brute(text, min_chars):
    """Every substring from every place, looked for everywhere else."""
    text = q.normal(text)
    n = len(text)
    covered, most = np.zeros(n, bool), 0
    for i in range(n):
        for k in range(n - i, min_chars - 1, -1):
            if text.find(text[i : i + k]) != i or text.find(text[i : i + k], i + 1) >= 0:
                covered[i : i + k], most = True, max(most, k)
                break
    return (float(covered.mean()) if n else 0.0), most


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab é\U0001f600\n", max_size=50), max_size=6), st.integers(1, 12))
def test_matches_brute_force(texts, min_chars):
    fraction, longest = q.profile(texts, min_chars)
    for text, f, most in zip(texts, fraction, longest):
        assert (pytest.approx(f), most) == brute(text, min_chars)
    first = q.profile(texts, min_chars, 0.4)[0]
    assert first == pytest.approx(fraction)


def test_colliding_hashes_change_nothing(monkeypatch):
    texts = ["one two three four five six", "abc abc abc abd abd", "x" * 30, "no repeats"]
    want = [x.tolist() for x in q.profile(texts, 3)]
    monkeypatch.setattr(q, "_rolling", lambda codes, size: codes[: len(codes) - size + 1] % np.uint64(3))
    assert [x.tolist() for x in q.profile(texts, 3)] == want


def test_the_unit_is_the_same_at_every_length():
    piece = "abcdefghijklmnopqrstuvwxyz012345"
    for text, most in ((piece * 2, 32), (piece * 2 + "z", 32), (piece + " " + piece, 32), ("xyzw" * 40, 156)):
        fraction, longest = q.profile([text])
        assert longest[0] == most and fraction[0] == pytest.approx(brute(text, q.MIN_CHARS)[0]) and fraction[0] > 0.95


def test_a_text_written_twice_is_covered_whole(spark):
    passage = " ".join(f"w{i}" for i in range(150))[:639]
    assert [x[0] for x in q.profile([f"{passage} {passage}"])] == [pytest.approx(1, abs=0.001), 639]
    df = spark.createDataFrame([(1, f"{passage} {passage}"), (2, passage)], "doc_id long, text string")
    assert [r.doc_id for r in q.repetition_filter(df).collect()] == [2]


def test_a_line_at_head_and_foot_is_no_reason():
    line = "All rights reserved by the authors of this text."
    body = "Between them is a body of some forty letters or so."
    fraction, longest = q.profile([f"{line}\n{body}\n{line}", f"{line}\n{line}", f"{line}\n{line}\n{line}"])
    assert fraction[0] < q.MAX_FRACTION < min(fraction[1:]) and longest[0] == len(line)


def test_repeats_do_not_cross_documents():
    same = "one two three four five six seven eight nine ten eleven"
    fraction, longest = q.profile([same, same, None, ""], 8)
    assert fraction.tolist() == [0, 0, 0, 0] and longest.tolist() == [0, 0, 0, 0]


def test_filter_on_odd_rows(spark):
    line = "this is a line of text that is said again"
    rows = [(1, None, "a"), (2, "", None), (3, (line + "\n") * 30, "a"), (4, line, "a"), (4, line, "a"), (None, "  \n ", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, repeat_fraction string")
    out = q.repetition_filter(df)
    assert out.columns == ["doc_id", "text", "repeat_fraction", "longest_repeat"]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "4", "4", "None"]
    assert q.repetition_scores(df.limit(0)).count() == 0
    long = spark.createDataFrame([(9, " ".join(str(hash((i, "x")) % 10**12) for i in range(200_000))), (8, "word " * 200_000)], "doc_id long, text string")
    assert [r.doc_id for r in q.repetition_filter(long).collect()] == [9]
    assert {r.doc_id: r.longest_repeat for r in q.repetition_scores(long).collect()}[8] == 999_994


def test_one_long_repeat_is_enough(spark):
    part = " ".join(f"w{i}" for i in range(400))
    other = " ".join(f"v{i}" for i in range(8000))
    df = spark.createDataFrame([(1, f"{part} {other} {part}")], "doc_id long, text string")
    assert q.repetition_filter(df).count() == 0
    assert q.repetition_filter(df, max_longest=5000).count() == 1
