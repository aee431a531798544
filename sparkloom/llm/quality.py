"""Repetition inside a document, found with a suffix array.

The unit is the character, whatever the text, with every run of white space taken as one
space. Substrings of ``min_chars`` characters that a text holds twice are found first, by
rolling hashes whose matches are compared character by character; only what they cover
can be part of a long enough repeat. A suffix array over the covered stretches comes from
prefix doubling, in which only suffixes still tied are sorted again, and the ranks kept of
each doubling give the longest common prefixes of neighbours in that order. A suffix's
larger common prefix with a neighbour is the depth of its longest-common-prefix interval:
the longest substring starting there that the text holds elsewhere too. Where the suffix
one character before has a longer one, the substring could be continued to the left at
both places and is not maximal; all others are occurrences of maximal repeated substrings.
The spans of all occurrences, the first one too, are united: a text that says everything
twice is covered whole. Many documents share one array: each numbers its characters
apart from the others and every stretch ends in a number of its own, so no repeat leaves it.

Defined results: a null, empty or blank text has fraction 0 and longest repeat 0, and is
kept. Repeated rows are judged each by itself, and rows with null ids like any others. An
input column that has the name of a computed one is replaced. All other columns pass
through unchanged. An empty table gives an empty one. A very long text is worked on whole;
memory follows the longest text: some 40 bytes a character, and where it repeats itself
some 30 more and 4 for each doubling up to its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.groups import lean

MIN_CHARS = 24
MAX_FRACTION = 0.75
MAX_LONGEST = 1000
CHARS_AT_ONCE = 100_000
FRACTION, LONGEST = "repeat_fraction", "longest_repeat"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of ``ids`` (its last value must be unique) and the ranks by doubling.

    ``ranks[h][i]`` is equal for two positions exactly if the next 2**h values are.
    """
    n = len(ids)
    kind = np.int32 if n < 1 << 31 else np.int64
    order = np.argsort(ids, kind="stable")
    new = np.r_[True, ids[order][1:] != ids[order][:-1]]
    rank = np.empty(n, kind)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, width = [rank], 1
    tied = _tied(order, rank)
    while len(tied):
        keys = rank[tied].astype(np.int64) * n + rank[np.minimum(tied + width, n - 1)]
        sort = np.argsort(keys, kind="stable")
        places = np.sort(_slots(rank, tied))
        suffixes, keys = tied[sort], keys[sort]
        order[places] = suffixes
        head = np.r_[True, keys[1:] != keys[:-1]]
        rank = rank.copy()
        rank[suffixes] = np.maximum.accumulate(np.where(head, places, 0))
        ranks.append(rank)
        width *= 2
        tied = suffixes[_still_tied(head)]
    return order, ranks


def _still_tied(head: np.ndarray) -> np.ndarray:
    last = np.r_[head[1:], True]
    return ~(head & last)


def _tied(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    by = rank[order]
    head = np.r_[True, by[1:] != by[:-1]]
    return order[_still_tied(head)]


def _slots(rank: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """The places in the order that the tied suffixes hold among them."""
    groups, sizes = np.unique(rank[tied], return_counts=True)
    within = np.arange(len(tied)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(groups, sizes) + within


def neighbour_lcp(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix in the order with the one before it; 0 at first."""
    n = len(order)
    out = np.zeros(n, np.int64)
    pair = 1 + np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]])
    a, b, length = order[pair - 1], order[pair], np.zeros(len(pair), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank = ranks[level]
        same = rank[np.minimum(a + length, n - 1)] == rank[np.minimum(b + length, n - 1)]
        length += same.astype(np.int64) << level
    out[pair] = length
    return out


def longest_match(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place the length of the longest substring from there that is elsewhere too."""
    best = np.empty(len(order), np.int64)
    best[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return best


def normal(text: str | None) -> str:
    """The text with single spaces."""
    return " ".join(text.split()) if text else ""


def _rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` values from each place on; the last ``size - 1`` places have none."""
    power, base, width, out, held = codes, _BASE, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                if out is None:
                    out, held = power, width
                else:  # what is held so far follows the block of this width
                    out = power[: len(codes) - held - width + 1] * _pow(_BASE, held) + out[width:]
                    held += width
            if width * 2 > size:
                return out[: len(codes) - size + 1]
            power = power[:-width] * base + power[width:] if len(power) > width else power[:0]
            base, width = base * base, width * 2


def _pow(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _twice(codes: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
    """Places from where ``size`` values are found at another place of their document as well."""
    if len(codes) < size:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        own = docs[: len(codes) - size + 1]
        grams = _rolling(codes.astype(np.uint64), size) * _MIX
        grams = (grams ^ grams >> np.uint64(32) ^ own.astype(np.uint64) * _BASE) * _MIX
    whole = np.flatnonzero(own == docs[size - 1 :])
    grams = grams[whole]
    in_order = np.sort(grams)
    again = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if not len(again):
        return whole[:0]
    # a bitmap leaves few to look up
    bits = max(16, int(len(again) * 16).bit_length())
    shift = np.uint64(64 - bits)
    seen = np.zeros(1 << bits, bool)
    seen[again >> shift] = True
    maybe = np.flatnonzero(seen[grams >> shift])
    found = again[np.minimum(np.searchsorted(again, grams[maybe]), len(again) - 1)] == grams[maybe]
    maybe = maybe[found]
    order = maybe[np.argsort(grams[maybe], kind="stable")]
    at, keys = whole[order], grams[order]
    # equal hashes are compared character by character with the first of their kind
    first = at[np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], np.arange(len(at)), 0))]
    same = docs[at] == docs[first]
    for step in range(size):
        same &= codes[at + step] == codes[first + step]
    if not same.all():
        return np.sort(_exactly(codes, docs, size, at))
    return np.sort(at)


def _exactly(codes: np.ndarray, docs: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """Of the places ``at`` those whose values are found again, whatever the hashes say."""
    rows = np.column_stack([docs[at], *[codes[at + step] for step in range(size)]])
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    return at[counts[inverse.ravel()] > 1]


def _inside(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0


def _profile(texts: list[str], min_chars: int, enough: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Covered fraction and longest repeat of normal, filled texts; the latter is 0 beyond ``enough``."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    docs = np.repeat(np.arange(len(texts)), sizes)
    twice = _twice(codes, docs, min_chars)
    covered = _inside(twice, twice + min_chars, len(codes))
    fraction = np.bincount(docs[covered], minlength=len(texts)) / sizes
    if enough is not None:
        covered &= (fraction <= enough)[docs]
    longest = np.zeros(len(texts), np.int64)
    at = np.flatnonzero(covered)
    if not len(at):
        return fraction, longest
    # the covered stretches, each with a number of its own at its end
    last = np.r_[(np.diff(at) > 1) | (np.diff(docs[at]) > 0), True]
    place = np.arange(len(at)) + np.cumsum(last) - last
    n, stops = len(at) + int(last.sum()), place[last] + 1
    ids = np.empty(n, np.int64)
    span = int(codes[at].max()) + 1
    ids[place] = docs[at] * span + codes[at]
    ids[stops] = len(texts) * span + np.arange(len(stops))
    order, ranks = suffix_array(ids)
    length = longest_match(order, neighbour_lcp(order, ranks))
    maximal = np.flatnonzero((length >= min_chars) & np.r_[True, length[:-1] <= length[1:]])
    owner = np.empty(n, np.int64)
    owner[place], owner[stops] = docs[at], docs[at[last]]
    np.maximum.at(longest, owner[maximal], length[maximal])
    united = _inside(maximal, maximal + length[maximal], n)
    for doc, chars in zip(*np.unique(owner[united], return_counts=True)):
        fraction[doc] = chars / sizes[doc]
    return fraction, longest


def profile(texts: list[str | None], min_chars: int = MIN_CHARS, enough: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Covered fraction and longest repeat, in characters, of each text.

    Where the fraction is beyond ``enough`` the longest repeat is not looked for.
    """
    fraction, longest = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    own: list[str] = []
    rows: list[int] = []
    chars = 0
    for row, text in enumerate(map(normal, texts)):
        if text:
            own.append(text)
            rows.append(row)
            chars += len(text)
        if rows and (chars >= CHARS_AT_ONCE or row == len(texts) - 1):
            fraction[rows], longest[rows] = _profile(own, min_chars, enough)
            own, rows, chars = [], [], 0
    return fraction, longest


def _scored(df: DataFrame, text_col: str, min_chars: int, limits: tuple[float, int] | None) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name not in (FRACTION, LONGEST)]
    schema = T.StructType([*kept, T.StructField(FRACTION, T.DoubleType()), T.StructField(LONGEST, T.LongType())])
    names = [f.name for f in kept]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            fraction, longest = profile(batch.column(at).to_pylist(), min_chars, None if limits is None else limits[0])
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(fraction), pa.array(longest)], names=[*batch.schema.names, FRACTION, LONGEST]
            )
            if limits is not None:
                out = out.filter(pa.array((fraction <= limits[0]) & (longest <= limits[1])))
            yield out

    return df.select(*[f"`{n}`" for n in names]).mapInArrow(lean(score), schema)


def repetition_scores(df: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``df`` with ``repeat_fraction`` and ``longest_repeat`` of every row."""
    return _scored(df, text_col, min_chars, None)


def repetition_filter(
    df: DataFrame,
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    max_fraction: float = MAX_FRACTION,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """The rows whose repeats stay within both limits, with their two figures.

    Repeats of under ``min_chars`` characters count for neither. The work is local to
    each row: no shuffle, and memory follows the longest document.
    """
    return _scored(df, text_col, min_chars, (max_fraction, max_longest))


def drop_repetitive(
    df: DataFrame,
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    max_fraction: float = MAX_FRACTION,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """The rows of :func:`repetition_filter` as they came, without figures."""
    at = df.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fraction, longest = profile(batch.column(at).to_pylist(), min_chars, max_fraction)
            yield batch.filter(pa.array((fraction <= max_fraction) & (longest <= max_longest)))

    return df.mapInArrow(lean(judge), df.schema)
