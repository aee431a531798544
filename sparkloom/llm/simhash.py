"""Near duplicates by SimHash fingerprints and a grid over their segments' bit counts.

The fingerprint has 256 bits: each distinct lower-case word votes with the bits of its
hash, and a bit is set where more than half vote for it. Two texts of which a share of
the words differs get fingerprints that differ in a share of the bits.

The embedding maps a fingerprint to the number of set bits (0, 1 or 2) in each of 128
segments of two bits. The Manhattan distance of two such vectors never exceeds the
Hamming distance of the fingerprints. Points are joined by a grid: a band is a choice of
segments, a point's counts in them its cell there, and two points within the band's radius
of each other are compared, first by the Manhattan distance of the whole vectors, kept in
unary so that it is one population count, and then by the exact Hamming distance. Half of
the bits, which can differ in no more than all of them, are looked at before either.

The bands share all 128 segments out between them and have radius 1: every point looks
into its own cell and into those one step up in a segment, so any two whose counts in the band
differ by one step at most meet. With c bands, two points that never meet are at least 2c
bits apart, so c is the smallest number for which 2c exceeds the limit, and every pair
within the limit meets. The bands follow from the limit alone: what is found depends neither on
how many points there are nor on how much they are alike. What does grow with these is the
work: unrelated points share cells, and the pairs compared grow with the square of the points.

No cell is skipped and no partner dropped. A task passes on a cell of over ``HOT`` rows
instead of working on it; its rows are then dealt to blocks and every two blocks are compared in a
task of their own, so no cell is one task's burden. What leaves a task is not every near
pair but a spanning set of them, one link for each row.

Defined results: a text without any word is represented by its characters other than
white space; null, empty and blank texts have no fingerprint, and their rows are in no group. Rows with a
null id are in no group. Rows that repeat an id are one document, so they stay or go
together. The document of a group that stays is the one with the smallest id. A very long
text counts whole, as its set of words. An empty table has no groups. Ids are whole numbers; other
types are refused. Further columns, whatever their names, are ignored by the search and pass
through the filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import store
from sparkloom.llm.components import components
from sparkloom.llm.groups import binary_rows, fixed_binary, lean, runs
from sparkloom.llm.tokens import ragged

BITS = 256
SEGMENTS = BITS // 2
MAX_DISTANCE = 36
#: Share of the pairs within the distance that meet: all, whatever the table's size.
RECALL = 1.0
DOCS_AT_ONCE = 1000
HOT = 65_536
BLOCK = 32_768
ROWS_AT_ONCE = 50_000
PAIRS_AT_ONCE = 200_000
#: Cells of up to this many rows are compared many at a time, larger ones each by itself.
SMALL = 256
#: Up to this many ids (8 bytes each) the documents to leave out are broadcast.
BROADCAST_IDS = 4_000_000
WORD = re.compile(r"\w+")
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def features(text: str | None) -> set[str]:
    """What votes on the fingerprint: distinct words, else distinct characters."""
    if not text:
        return set()
    return set(WORD.findall(text.lower())) or set("".join(text.split()))


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a fingerprint, and these as a (rows, 32) array of bytes."""
    rows, prints = [], []
    for first in range(0, len(texts), DOCS_AT_ONCE):
        seen: dict[str, int] = {}
        votes = []
        for row, text in enumerate(texts[first : first + DOCS_AT_ONCE], first):
            own = features(text)
            if own:
                rows.append(row)
                votes.append([seen.setdefault(word, len(seen)) for word in own])
        digest = xxhash.xxh3_128_digest
        raw = b"".join(digest(w, 0) + digest(w, 1) for w in (word.encode() for word in seen))
        table = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8), axis=1)
        bits = np.empty((len(votes), BITS), bool)
        for at, own in enumerate(votes):
            total = np.zeros(BITS, np.int64)
            index = np.array(own)
            for k in range(0, len(own), 255):
                total += table[index[k : k + 255]].sum(axis=0, dtype=np.uint8)
            bits[at] = 2 * total > len(own)
        prints.append(np.packbits(bits, axis=1))
    return np.array(rows, np.int64), np.concatenate(prints) if prints else np.empty((0, BITS // 8), np.uint8)


def unary(prints: np.ndarray) -> np.ndarray:
    """The segments' counts in unary (0 as 00, 1 as 01, 2 as 11), as (rows, 4) uint64.

    The Hamming distance of two such codes is the Manhattan distance of the counts.
    """
    words = np.ascontiguousarray(prints).view(np.uint64)
    return ((words | words >> _ONE) & _LOW) | ((words & words >> _ONE) & _LOW) << _ONE


Band = tuple[np.ndarray, int]


def bands(points: int | None = None, agree: np.ndarray | None = None, max_distance: int = MAX_DISTANCE) -> list[Band]:
    """Segments and radius of every band: as many as it takes for all pairs within the distance to meet.

    ``points`` and ``agree`` (how many points there are, how often two agree in each segment)
    are not looked at: bands that follow them would find other pairs in a larger table.
    """
    core = max(4, max_distance // 2 + 1)  # a cell's number must fit 64 bits
    return [(own, 1) for own in np.array_split(np.random.default_rng(20).permutation(SEGMENTS), core)]


def _counts(prints: np.ndarray) -> np.ndarray:
    """The number of set bits in every segment, as (rows, segments)."""
    return np.unpackbits(prints, axis=1).reshape(len(prints), SEGMENTS, 2).sum(axis=2, dtype=np.uint8)


def cells(prints: np.ndarray, plan: list[Band]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and keys of the cells that each band wants them in.

    A key is twice the cell's number, plus one where the point is only looking into the cell.
    """
    held, offset = _counts(prints), 0
    for own, radius in plan:
        power = 3 ** np.arange(len(own), dtype=np.int64)
        mine = held[:, own]
        home = mine @ power + offset
        rows, keys = [np.arange(len(prints))], [home * 2]
        for at in range(len(own) if radius else 0):
            up = np.flatnonzero(mine[:, at] < 2)
            rows.append(up)
            keys.append((home[up] + power[at]) * 2 + 1)
        yield np.concatenate(rows), np.concatenate(keys)
        offset += 3 ** len(own)


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n rows the smallest row that the pairs connect each of them with."""
    label = np.arange(n)
    while len(a):
        low, high = label[a], label[b]
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        least = np.minimum(low, high)
        np.minimum.at(label, low, least)
        np.minimum.at(label, high, least)
        while (label[label] != label).any():
            label = label[label]
    return label


def _small_cells(keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that meet in the given cells, ``PAIRS_AT_ONCE`` at a time."""
    all_rows = ragged(starts, sizes)
    after = np.where(keys[all_rows] & 1, 0, np.repeat(starts + sizes, sizes) - all_rows - 1)
    before = np.cumsum(after) - after
    for at in range(0, int(after.sum()), PAIRS_AT_ONCE):
        low, high = np.searchsorted(before + after, at, side="right"), np.searchsorted(before, at + PAIRS_AT_ONCE, side="left")
        span = np.arange(low, high)
        first = np.maximum(at - before[span], 0)
        own = np.minimum(after[span], at + PAIRS_AT_ONCE - before[span]) - first
        rows = all_rows[span]
        a, b = np.repeat(rows, own), ragged(rows + 1 + first, own)
        if side is not None:
            apart = side[a] != side[b]
            a, b = a[apart], b[apart]
        yield a, b


def _large_cell(
    keys: np.ndarray, halves: np.ndarray, start: int, size: int, most: int, side: np.ndarray | None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that meet in one cell and are near in half of their bits, found in tiles of rows by columns."""
    rows = np.arange(start, start + size)
    home = rows[: size - int((keys[rows] & 1).sum())]
    own = None if side is None else side[rows]
    if own is None:
        parts = [(home, rows)]
    else:  # rows of a side with those of the later ones, and with all that are just looking
        looking = np.arange(size) >= len(home)
        parts = [(home[own[: len(home)] == v], rows[(own > v) | (looking & (own != v))]) for v in np.unique(own)]
    for these, those in parts:
        at = 0
        while at < len(these):
            if own is None:
                those = rows[at:]
            step = max(1, PAIRS_AT_ONCE // max(1, len(those)))
            tile = these[at : at + step]
            apart = np.bitwise_count(halves[0, tile, None] ^ halves[0, those])
            apart += np.bitwise_count(halves[1, tile, None] ^ halves[1, those])
            a, b = np.divmod(np.flatnonzero(apart <= most), max(1, len(those)))
            a, b = tile[a], those[b]
            yield (a[a < b], b[a < b]) if own is None else (a, b)
            at += step


def links(keys: np.ndarray, prints: np.ndarray, most: int, side: np.ndarray | None = None) -> np.ndarray:
    """Pairs of rows that connect all near ones that meet in a cell; rows are sorted by key.

    Points meet where at least one of them is at home. Where there are sides, just rows
    of different sides are compared.
    """
    words, counts = np.ascontiguousarray(prints).view(np.uint64), unary(prints)
    halves = np.ascontiguousarray(words[:, :2].T)
    starts, sizes = runs(keys >> 1)
    small = sizes <= SMALL
    tiles = (_large_cell(keys, halves, start, size, most, side) for start, size in zip(starts[~small].tolist(), sizes[~small].tolist()))
    one, other = np.empty(0, np.int64), np.empty(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def spanning() -> tuple[np.ndarray, np.ndarray]:
        label = _joined(len(keys), *(np.concatenate(ends) for ends in zip((one, other), *found)))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return label[moved], moved

    held = 0
    for a, b in chain(_small_cells(keys, starts[small], sizes[small], side), chain.from_iterable(tiles)):
        near = np.bitwise_count(halves[0, a] ^ halves[0, b]) + np.bitwise_count(halves[1, a] ^ halves[1, b]) <= most
        a, b = a[near], b[near]
        near = np.bitwise_count(counts[a] ^ counts[b]).sum(axis=1, dtype=np.int64) <= most
        a, b = a[near], b[near]
        near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= most
        if near.any():
            found.append((a[near], b[near]))
            held += len(found[-1][0])
        if held > max(len(keys), 10 * PAIRS_AT_ONCE):  # thousands of texts may all be near each other
            one, other = spanning()
            found, held = [], 0
    return np.column_stack(spanning())


def fingerprint(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, print)`` of every row that has both an id and a fingerprint."""
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of a type of whole numbers")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, prints = fingerprints(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), binary_rows(prints)], names=["id", "print"])

    source = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lean(work), "id long, print binary")


_WORDS = ["w0", "w1", "w2", "w3"]
_PLACED = "key long, id long, w0 long, w1 long, w2 long, w3 long"


def _prints(table: pa.Table) -> np.ndarray:
    words = np.column_stack([table.column(c).to_numpy() for c in _WORDS])
    return np.ascontiguousarray(words).view(np.uint8).reshape(len(words), BITS // 8)


def _edges(table: pa.Table, most: int, side: np.ndarray | None = None) -> pa.RecordBatch:
    ids = table.column("id").to_numpy()
    ends = np.unique(np.sort(ids[links(table.column("key").to_numpy(), _prints(table), most, side)], axis=1), axis=0)
    none = pa.nulls(len(ends), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), *[none] * 6], names=["u", "v", "key", "id", *_WORDS])


def _passed_on(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.to_batches():
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, *batch.columns], names=["u", "v", "key", "id", *_WORDS])


def _compare(batches: Iterator[pa.RecordBatch], most: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Links of the cells of batches sorted by key; the rows of larger cells than ``hot`` as they are."""
    held: list[pa.Table] = []
    passing = None  # the large cell whose rows are going by
    for batch in _and_none(batches):
        if batch is not None and batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
        rows = sum(t.num_rows for t in held)
        if not rows or (batch is not None and rows < max(ROWS_AT_ONCE, hot + 1)):
            continue
        table = pa.concat_tables(held).combine_chunks()
        held = []
        cell = table.column("key").to_numpy() >> 1
        starts, sizes = runs(cell)
        large = (sizes > hot) | (cell[starts] == passing if passing is not None else False)
        if batch is not None and not large[-1]:  # the last cell may go on in the next batch
            held = [table.slice(int(starts[-1]))]
            starts, sizes, large = starts[:-1], sizes[:-1], large[:-1]
        for start, size in zip(starts[large], sizes[large]):
            yield from _passed_on(table.slice(int(start), int(size)))
        passing = int(cell[starts[-1]]) if len(large) and large[-1] else None
        small = ragged(starts[~large], sizes[~large])
        if len(small):
            yield _edges(table.take(pa.array(small)) if large.any() or held else table, most)


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_edges(points: DataFrame, max_distance: int = MAX_DISTANCE, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Edges ``(u, v)`` that connect the near fingerprints of ``(id, print)``, which are distinct.

    All pairs within the distance are connected; ``hot`` and ``block`` just share out the work.
    """
    plan = bands(None, None, max_distance)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, ids = fixed_binary(batch.column(1), BITS // 8), batch.column(0).to_numpy()
            words = np.ascontiguousarray(prints).view(np.int64)
            for rows, keys in cells(prints, plan) if len(prints) else ():
                columns = [keys, ids[rows], *words[rows].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["key", "id", *_WORDS])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _compare(batches, max_distance, hot)

    placed = points.select("id", "print").mapInArrow(lean(place), _PLACED)
    found = placed.repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(lean(compare), f"u long, v long, {_PLACED}")
    found = store.written(found, "links")
    edges, left = found.where("u is not null").select("u", "v"), found.where("u is null").drop("u", "v")
    if left.isEmpty():
        return edges

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in _and_none(batches):
            if batch is not None and batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
            if not held:
                continue
            table = pa.concat_tables(held).combine_chunks()
            group = table.column("pair").to_numpy()
            starts, sizes = runs(group)
            last = len(starts) if batch is None else len(starts) - 1
            for start, size in zip(starts[:last], sizes[:last]):
                own = table.slice(int(start), int(size))
                side = own.column("side").to_numpy()
                yield _edges(own, max_distance, side if len(np.unique(side)) > 1 else None).select(["u", "v"])
            held = [table.slice(int(starts[-1]))] if last < len(starts) else []

    cell = F.shiftright("key", 1)
    sizes = left.groupBy(cell.alias("_cell")).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    dealt = left.withColumn("_cell", cell).join(sizes, "_cell").withColumn("side", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    low, high = F.least("side", "_other"), F.greatest("side", "_other")
    # a number for the cell and its two blocks; should two agree, their rows are merely compared as well
    task = paired.withColumn("pair", F.xxhash64("_cell", low, high)).select("pair", "side", *_PLACED.replace(" long", "").split(", "))
    crossed = task.repartition("pair").sortWithinPartitions("pair", "key").mapInArrow(lean(cross), "u long, v long")
    return edges.unionByName(crossed)


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(doc_id, rep_doc_id)`` for every document that a near one with a smaller id stands for.

    A group is a connected component of the pairs within ``max_distance`` bits. Equal
    fingerprints are joined before the search, so a group of thousands of copies costs one
    point in each grid.
    """
    prints = store.written(fingerprint(df, text_col, id_col), "prints")
    points = store.written(prints.groupBy("print").agg(F.min("id").alias("id")).select("id", "print"), "points")
    equal = prints.join(points.withColumnRenamed("id", "u"), "print").where("id <> u").select("u", F.col("id").alias("v"))
    found = components(equal.unionByName(near_edges(points, max_distance)))
    store.drop(prints)
    store.drop(points)
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("rep_doc_id"))


def drop_near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **settings: float) -> DataFrame:
    """``df`` without the documents that another one stands for."""
    gone = near_duplicates(df, text_col, id_col, **settings).select(F.col("doc_id").alias("_gone"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return df.join(gone, df[f"`{id_col}`"].cast("long") == gone["_gone"], "left_anti")
