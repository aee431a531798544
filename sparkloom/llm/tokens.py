"""Exact byte-level BPE ids of whole columns, with each distinct stretch encoded once.

The splitting pattern of the byte-level vocabularies never lets a piece run past a space
that stands between two other characters, except as that piece's first character. A text
can therefore be cut at those spaces, and each stretch looked up on its own. Arrow cuts a
column's texts and numbers the distinct stretches; these are encoded in one call, and the
ids are dealt to the texts with numpy. Texts with other white space around their spaces
are encoded as they are. Either way the ids are those of ``tiktoken`` on the whole text.
"""

from __future__ import annotations

import base64
import math
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]"
ODD_SPACE = f"{_SPACE}{_SPACE}|^{_SPACE}|{_SPACE}$"
BYTES_AT_ONCE = 16 << 20


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i]``, ``starts[i] + 1``, ... of all i, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def slices(texts: pa.Array, most: int = BYTES_AT_ONCE):
    """The array in parts of about ``most`` bytes, a longer text being a part of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)


class ColumnCoder:
    """Ids and counts of a ``.tiktoken`` vocabulary file."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.n_vocab = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.uint16 if self.n_vocab <= 1 << 16 else np.uint32
        self.width = np.zeros(self.n_vocab, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)

    def count(self, text: str | None) -> int:
        """How many ids the text has; 0 for null and for the empty text."""
        return len(self.encoding.encode_ordinary(text)) if text else 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        each = [self.encoding.encode_ordinary(text) for text in texts]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for ids in each for i in ids), self.kind, int(sizes.sum())), sizes

    def _stretches(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct stretches, each after a space; all in one call."""
        if not len(stretches):
            return np.empty(0, self.kind), np.empty(0, np.int64)
        whole = pa.ListArray.from_arrays(pa.array([0, len(stretches)], pa.int32()), stretches)
        joined = " " + pc.binary_join(whole, " ")[0].as_py()
        ids = np.array(self.encoding.encode_ordinary(joined), self.kind)
        ends = np.cumsum(pc.binary_length(stretches).to_numpy().astype(np.int64) + 1)
        return ids, np.diff(np.searchsorted(np.cumsum(self.width[ids]), ends, side="right"), prepend=0)

    def _cut(self, texts: pa.Array):
        """For one part: plain rows and the rest's rows, stretch numbers, offsets and stretches."""
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        blank = pc.fill_null(pc.equal(pc.binary_length(texts), 0), True)
        odd, blank = (pc.fill_null(x, False).to_numpy(zero_copy_only=False) for x in (odd, blank))
        plain, cut = np.flatnonzero(odd & ~blank), np.flatnonzero(~odd & ~blank)
        parts = pc.split_pattern(texts.take(pa.array(cut)), " ")
        coded = parts.flatten().dictionary_encode()
        return plain, cut, coded.indices.to_numpy(), parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py(), coded.dictionary

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids every text has; 0 for null and for the empty text."""
        return np.concatenate([np.empty(0, np.int64), *[self._part(part)[1] for part in slices(texts)]])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the place where each text's begin."""
        flat, sizes = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        for part in slices(texts):
            ids, own = self._part(part, True)
            flat.append(ids)
            sizes.append(own)
        return np.concatenate(flat), np.r_[0, np.cumsum(np.concatenate(sizes))]

    def _part(self, texts: pa.Array, with_ids: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        plain, cut, codes, offsets, stretches = self._cut(texts)
        ids, sizes = self._stretches(stretches)
        # a text's first stretch has no space before it: it counts as a stretch of its own
        firsts = offsets[:-1]
        first_ids, first_sizes = self._encode(stretches.take(pa.array(codes[firsts])).to_pylist() if len(cut) else [])
        codes = codes.astype(np.int64)
        codes[firsts] = len(sizes) + np.arange(len(cut))
        sizes = np.r_[sizes, first_sizes]
        plain_ids, plain_sizes = self._encode(texts.take(pa.array(plain)).to_pylist())
        out = np.zeros(len(texts), np.int64)
        ends = np.r_[0, np.cumsum(sizes[codes])]
        out[cut] = ends[offsets[1:]] - ends[offsets[:-1]]
        out[plain] = plain_sizes
        if not with_ids:
            return None, out
        known = np.concatenate([ids, first_ids])
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(out.sum()), self.kind)
        begins = np.cumsum(out) - out
        flat[ragged(begins[cut], out[cut])] = known[ragged(starts[codes], sizes[codes])]
        flat[ragged(begins[plain], plain_sizes)] = plain_ids
        return flat, out


def id_bits(n_vocab: int) -> int:
    """The fewest bits that can hold every id of a vocabulary."""
    return max(1, math.ceil(math.log2(n_vocab))) if n_vocab > 1 else 1


def coder(path: str = DEFAULT_VOCABULARY) -> ColumnCoder:
    """The worker's own coder for ``path``, kept from one task to the next."""
    kept = sys.modules.setdefault("_sparkloom_coders", types.ModuleType("_sparkloom_coders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = ColumnCoder(path)
    return kept.__dict__[path]
