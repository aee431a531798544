"""Words of whole columns: Arrow cuts the texts, and only distinct stretches are looked into."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What ends a word, for RE2; a word is a run of letters, digits and underscores.
BREAK = r"[^\p{L}\p{N}_]+"


def stretches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the stretches between spaces, where each text's begin, and the distinct stretches.

    A null text has no stretches; every other one has at least one, which may be empty.
    """
    parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
    coded = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    return coded.indices.to_numpy(), offsets - offsets[0], coded.dictionary


def lower_words(distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of all stretches one after the other, and how many each has."""
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(distinct), BREAK, " "))
    parts = pc.split_pattern(plain, " ")
    words = parts.flatten()
    sizes = np.diff(parts.offsets.to_numpy()).astype(np.int64)
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not filled.all():
        ends = np.r_[0, np.cumsum(filled)]
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        sizes = ends[offsets[1:]] - ends[offsets[:-1]]
        words = words.filter(pa.array(filled))
    return words, sizes
