"""Token ids in the fewest bits that a vocabulary needs, readable from any place.

Every id takes ``bits`` bits, the most significant first. Ids are packed in blocks of
``BLOCK`` ids; each block starts at a byte of its own, and ``offsets`` has the byte at
which each begins, then the length of the whole. Token i is in block i // BLOCK, at bit
(i % BLOCK) * bits of it, so any range is read from its own bytes, with a few
vectorised numpy operations and no loop over ids.

Defined results: null and empty texts have no ids: ``n_tokens`` 0, an empty ``packed``
and offsets [0]. Every row has a row in the result; repeated rows and null ids too. A very long
text has as many blocks as its ids fill. An empty table gives an empty one. Other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.tokens import DEFAULT_VOCABULARY, coder, id_bits

BLOCK = 1024


def _pack_block(ids: np.ndarray, bits: int) -> np.ndarray:
    if bits == 16:
        return ids.astype(">u2").view(np.uint8)
    if bits == 8:
        return ids.astype(np.uint8)
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :].ravel())


def pack_ids(ids: np.ndarray, bits: int, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The packed bytes and the offsets of the blocks."""
    size = -(-block * bits // 8)
    whole = len(ids) // block
    parts = []
    if whole:
        rows = ids[: whole * block]
        if block * bits % 8 == 0:
            parts.append(_pack_block(rows, bits))
        else:
            parts += [_pack_block(rows[i * block : (i + 1) * block], bits) for i in range(whole)]
    if len(ids) > whole * block:
        parts.append(_pack_block(ids[whole * block :], bits))
    packed = b"".join(p.tobytes() for p in parts)
    starts = np.arange(whole + (len(ids) > whole * block), dtype=np.int64) * size
    return packed, np.r_[starts, len(packed)]


def unpack(packed: bytes, offsets, bits: int, n_tokens: int, start: int = 0, stop: int | None = None, block: int = BLOCK) -> np.ndarray:
    """Ids ``start`` to ``stop`` (by default all), reading only the blocks that hold them."""
    stop = n_tokens if stop is None else min(stop, n_tokens)
    if start >= stop:
        return np.empty(0, np.uint32)
    first, last = start // block, (stop - 1) // block
    held = np.arange(first * block, min((last + 1) * block, n_tokens))
    at = (np.asarray(offsets)[held // block] - offsets[first]) * 8 + held % block * bits
    raw = np.frombuffer(packed, np.uint8, count=offsets[last + 1] - offsets[first], offset=offsets[first])
    raw = np.r_[raw, np.zeros(8, np.uint8)].astype(np.uint64)
    byte = (at >> 3)[start - first * block : stop - first * block]
    shift = (at & 7)[start - first * block : stop - first * block].astype(np.uint64)
    word = np.zeros(len(byte), np.uint64)
    for k in range(5):  # 32 bits that begin anywhere in a byte
        word = word << np.uint64(8) | raw[byte + k]
    return ((word >> (np.uint64(40 - bits) - shift)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def packed_ids(df: DataFrame, path: str = DEFAULT_VOCABULARY, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, bits, offsets, packed)`` of every row; nothing is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        bits = id_bits(own.n_vocab)
        for batch in batches:
            sizes, packs, offsets = [], [], []
            ids, ends = own.ids(batch.column(1))
            for start, stop in zip(ends, ends[1:]):
                packed, at = pack_ids(ids[start:stop], bits, block)
                sizes.append(stop - start)
                packs.append(packed)
                offsets.append(at)
            ends = np.r_[0, np.cumsum([len(o) for o in offsets])].astype(np.int32)
            flat = np.concatenate(offsets) if offsets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.full(len(sizes), bits, np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array(packs, pa.binary()),
                ],
                names=["doc_id", "n_tokens", "bits", "offsets", "packed"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(work, f"doc_id {kind}, n_tokens long, bits int, offsets array<long>, packed binary")
