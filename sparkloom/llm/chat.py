"""Conversations as one rendered text each, which a parser can turn back into the turns.

Grammar::

    text    := turn*
    turn    := "<|" role "|>" "\\n" content "<|end|>" "\\n"

The parser is deterministic: it reads a header, then everything to the next end mark.
Content or roles that hold a mark of the grammar would be read differently from how they were
written, so every rendered text is parsed again and compared with its turns. Where they
differ, the offending turns are escaped one level further, and the check is repeated
until the turns come back identical. An escape puts ``\\`` between the two characters of
``<|`` (and after a ``<`` that is followed by backslashes and then ``|``, so that escaping can be undone
exactly); the parser takes one away again. ``escaped`` counts turns that needed it.

A conversation is cut into parts of ``TURNS`` turn numbers, each a text of its own that
parses back, so that one with millions of turns is not gathered in one task; turns are
numbered from 0, and ordinary conversations have just part 0.

Defined results: turns are in the order of ``turn``, nulls first (with the turns of part 0),
then of role and text. Null text is written as ``<|null|>`` in place of content and comes back
as null, an empty one as nothing; a null role is an empty role. Nothing says which of the
turns without an id of the conversation belong together: each is a conversation of its own
with a null id. Repeated rows are turns of their own. A very long text is rendered whole. An
empty table gives no rows. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END, NULL = "<|", "|>", "<|end|>", "<|null|>"
TURNS = 4096
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
Turn = tuple[str, str | None]


def escape(content: str) -> str:
    """``content`` with one more backslash in every ``<|``, ``<\\|`` and so on."""
    return _ESCAPE.sub(r"<\\\1|", content)


def unescape(content: str) -> str:
    """The reverse of :func:`escape`."""
    return _UNESCAPE.sub(r"<\1|", content)


def _turn(role: str, content: str | None, escaped: bool) -> str:
    if escaped:
        role, content = _role_out(role), content if content is None else escape(content)
    return f"{OPEN}{role}{CLOSE}\n{NULL if content is None else content}{END}\n"


def _role_out(role: str) -> str:
    return role.replace("%", "%25").replace("|", "%7C").replace("\n", "%0A")


def _role_in(role: str) -> str:
    return role.replace("%0A", "\n").replace("%7C", "|").replace("%25", "%")


def parse(text: str) -> list[Turn] | None:
    """The turns of a rendered text; None if it does not follow the grammar."""
    turns, at = [], 0
    while at < len(text):
        close = text.find(CLOSE + "\n", at)
        if not text.startswith(OPEN, at) or close < 0:
            return None
        body = close + len(CLOSE) + 1
        if text.startswith(NULL + END + "\n", body):
            end, content = body + len(NULL), None
        else:
            end = text.find(END + "\n", body)
            if end < 0:
                return None
            content = unescape(text[body:end])
        turns.append((_role_in(text[at + len(OPEN) : close]), content))
        at = end + len(END) + 1
    return turns


def render(turns: list[Turn]) -> tuple[str, int]:
    """The text that parses back into ``turns``, and how many turns had to be escaped."""
    escaped = [False] * len(turns)
    while True:
        text = "".join(_turn(role, content, e) for (role, content), e in zip(turns, escaped))
        if parse(text) == turns:
            return text, sum(escaped)
        wrong = [i for i, turn in enumerate(turns) if not escaped[i] and parse(_turn(*turn, False)) != [turn]]
        if not wrong:
            raise ValueError("the turns cannot be rendered")
        for i in wrong:
            escaped[i] = True


def chat_texts(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns_at_once: int = TURNS) -> DataFrame:
    """``(conv_id, part, n_turns, escaped, text)``, a row for each part of a conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.col(text_col).alias("text")).alias("t")
    part = F.coalesce(F.floor(F.col(turn_col) / turns_at_once), F.lit(0)).cast("long").alias("part")
    each = df.select(F.col(id_col).alias("conv_id"), part, turn)
    grouped = each.where("conv_id is not null").groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = each.where("conv_id is null").select("conv_id", F.lit(0).cast("long").alias("part"), F.array("t").alias("turns"))
    turns = grouped.unionByName(alone).select("conv_id", "part", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            out = [(len(roles), *render(list(zip(roles, texts)))) for roles, texts in pairs]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([n for n, _, _ in out], pa.int32()),
                    pa.array([e for _, _, e in out], pa.int32()),
                    pa.array([t for _, t, _ in out], pa.string()),
                ],
                names=["conv_id", "part", "n_turns", "escaped", "text"],
            )

    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(work, f"conv_id {kind}, part long, n_turns int, escaped int, text string")


#: Turns whose content or role does not come back as written are escaped; there are no nulls in ``conv_id``.
ORACLE_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(turn // {TURNS}, 0) AS part, turn, coalesce(role, '') AS r, text AS c FROM conversations),
j AS (SELECT *, coalesce(contains(c, '<|end|>' || chr(10)) OR c = '<|null|>' OR regexp_matches(c, '<\\+[|]'), false)
  OR contains(r, '|>' || chr(10)) OR regexp_matches(r, '%25|%7C|%0A') AS e FROM t),
w AS (SELECT *, '<|' || CASE WHEN e THEN replace(replace(replace(r, '%', '%25'), '|', '%7C'), chr(10), '%0A') ELSE r END || '|>' || chr(10)
  || CASE WHEN c IS NULL THEN '<|null|>' WHEN e THEN regexp_replace(c, '<(\\*)[|]', '<\\\1|', 'g') ELSE c END || '<|end|>' || chr(10) AS x FROM j)
SELECT conv_id, CAST(part AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (e) AS INTEGER) AS escaped,
  string_agg(x, '' ORDER BY turn NULLS FIRST, r, c NULLS FIRST) AS text FROM w GROUP BY conv_id, part
"""
