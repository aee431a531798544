"""Random strings, recognised by how poorly a tokenizer compresses them.

A vocabulary learned from ordinary text covers words, names and even made-up syllables
with several characters an id; random keys take an id for every one or two characters.
Candidates are unbroken runs of key characters that hold a letter. Their number of
characters for each id is compared with ``MAX_RATIO``. As ``=``, ``/`` and ``_`` join a key
to names, a run that does not pass is split at them and its parts are tried alike. Of
``SHORT`` to ``MIN_LENGTH`` characters only what has both cases (other than a first capital) or
a credential's name before it is tried, and what has no digit needs ``SHORT`` letters.

Left out are identifiers and digests that are known for what they are: UUIDs; runs of
digits with separators; names put together from ordinary words and short numbers;
strings of a digest's form (32, 40, 56, 64, 96 or 128 hex digits, or ``sha256-`` and the
like before base64) unless a credential's name assigns them (``token = "..."``); and any
string in ``known``, a set of SHA-256 digests of strings to pass over.

The scan for candidates runs in the JVM, so only texts that hold one reach Python.

Defined results: null and empty texts have no findings, and an empty table has none. Repeated
rows have findings each, and rows with a null id too, under that id. A very long text is
scanned whole, in time in proportion to it; a name counts however much white space or name
lies between it and the value. Further columns, whatever their names, are not looked at by
:func:`scan`. In :func:`redact` a text without findings stays as it is, null included; ``n_chars``,
where there is such a column, follows the new text. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.tokens import DEFAULT_VOCABULARY, coder

MIN_LENGTH = 20
SHORT = 16
MAX_RATIO = 2.4
MARK = "[SECRET]"
_CHARS = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{_CHARS}])(?=[0-9+/_=-]*+[A-Za-z])[{_CHARS}]{{{SHORT},}}+"
JOINTS = [re.compile(x) for x in ("=(?!=*$)", "/", "_")]
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGESTS = {32, 40, 56, 64, 96, 128}
INTEGRITY = re.compile(r"(md5|sha(1|224|256|384|512))[-=]", re.I)
CREDENTIAL = re.compile("api|auth|access|secret|private|token|passw(or)?d|pwd|credential|bearer|key", re.I)
NAME = re.compile(r"([A-Za-z]+|[0-9]{1,4})([-_/=+]([A-Za-z]+|[0-9]{1,8}))+")


def _back(text: str, at: int, inside) -> int:
    """Where the run of characters that ends at a place begins."""
    while at and inside(text[at - 1]):
        at -= 1
    return at


def _named(text: str, start: int) -> bool:
    """Whether a credential's name, then ``=``, ``:``, ``=>`` or white space, stands before a place; quotes may be around."""
    at = start - 1 if start and text[start - 1] in "\"'" else start
    value, at = at, _back(text, at, str.isspace)
    for sign in ("=>", "=", ":"):
        if text.endswith(sign, 0, at):
            at = _back(text, at - len(sign), str.isspace)
            break
    else:
        if at == value:
            return False
    at -= at > 0 and text[at - 1] in "\"'"
    return bool(CREDENTIAL.search(text, _back(text, at, lambda c: c.isalnum() or c in "_-"), at))


def _excluded(text: str, start: int, value: str, known: frozenset[str]) -> str | None:
    """Why a candidate is no secret, if it is of a known kind."""
    if UUID.fullmatch(value):
        return "uuid"
    if known and hashlib.sha256(value.encode()).hexdigest() in known:
        return "known"
    digest = (HEX.fullmatch(value) and len(value) in DIGESTS) or INTEGRITY.match(value)
    if digest and not _named(text, start):
        return "digest"
    if NAME.fullmatch(value) and max(map(len, re.findall("[A-Za-z]+", value))) >= 3:
        return "name"
    return None


def _tried(text: str, start: int, value: str) -> bool:
    """Whether the ratio may decide on a run or part."""
    letters = sum(map(str.isalpha, value))
    if not letters or len(value) < SHORT or (letters < SHORT and not any(map(str.isdigit, value))):
        return False
    mixed = value[1:].lower() != value[1:] and value.upper() != value
    return len(value) >= MIN_LENGTH or mixed or _named(text, start)


def _within(text: str, start: int, end: int, path: str, max_ratio: float, known: frozenset[str]) -> Iterator[tuple[int, int, float]]:
    """The run itself if it is a secret, else those of its parts that are."""
    value = text[start:end]
    if len(value) < SHORT:
        return
    why = _excluded(text, start, value, known)
    if why is None and _tried(text, start, value):
        ratio = len(value) / max(1, coder(path).count(value))
        if ratio <= max_ratio:
            yield start, end, ratio
            return
    if why is None or why == "name":
        for joint in JOINTS:
            if places := [m.start() for m in joint.finditer(value)]:
                for a, b in zip([-1, *places], [*places, len(value)]):
                    yield from _within(text, start + a + 1, start + b, path, max_ratio, known)
                return


def findings(text: str | None, path: str, max_ratio: float, known: frozenset[str] = frozenset()) -> list[tuple[int, int, float]]:
    """``(start, end, characters an id)`` of every secret in a text."""
    return [f for match in _pattern().finditer(text or "") for f in _within(text, *match.span(), path, max_ratio, known)]


def _pattern() -> re.Pattern:
    return re.compile(CANDIDATE)


def scan(
    df: DataFrame,
    path: str = DEFAULT_VOCABULARY,
    max_ratio: float = MAX_RATIO,
    known: frozenset[str] = frozenset(),
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """A row for each secret: id, place, length, characters an id, and the value's digest.

    The secret itself is not copied; its SHA-256 digest lets findings be compared and
    passed as ``known`` later.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(i, *f) for i, text in enumerate(texts) for f in findings(text, path, max_ratio, known)]
            values = [texts[i][start:end] for i, start, end, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] - r[1] for r in rows], pa.int64()),
                    pa.array([round(r[3], 4) for r in rows], pa.float64()),
                    pa.array([hashlib.sha256(v.encode()).hexdigest() for v in values], pa.string()),
                ],
                names=["doc_id", "start", "length", "chars_per_token", "digest"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    held = df.where(F.col(text_col).rlike(CANDIDATE)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return held.mapInArrow(work, f"doc_id {kind}, start long, length long, chars_per_token double, digest string")


def redact(
    df: DataFrame,
    path: str = DEFAULT_VOCABULARY,
    max_ratio: float = MAX_RATIO,
    known: frozenset[str] = frozenset(),
    text_col: str = "text",
    mark: str = MARK,
) -> DataFrame:
    """``df`` with every secret replaced by ``mark``; all rows and columns stay."""

    def clean(text: str) -> str:
        parts, at = [], 0
        for start, end, _ in findings(text, path, max_ratio, known):
            parts += [text[at:start], mark]
            at = end
        return "".join(parts) + text[at:] if parts else text

    @F.pandas_udf(T.StringType())
    def cleaned(texts):
        return texts.map(clean, na_action="ignore")

    text = F.col(text_col)
    # the inner condition hands the Python stage nulls instead of texts without a candidate
    out = df.withColumn(text_col, F.coalesce(cleaned(F.when(text.rlike(CANDIDATE), text)), text))
    if "n_chars" in df.columns and text_col == "text":
        length = F.coalesce(F.length(text_col), F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(df.schema["n_chars"].dataType))
    return out
