"""Near-equal token windows, by multiway differencing after Karmarkar and Karp.

Every document starts as a partial partition with its size in one window and nothing in
the others. The two partial partitions with the widest spread are merged again and
again, the largest window of the one with the smallest of the other, so imbalances
cancel; the last one left is the result. It starts with as many windows as the tokens and
the large items need at least. Whenever a window comes out over capacity, the count rises
and the differencing starts afresh; the rise doubles each time, and the counts between the
last that failed and the first that fits are searched by halves.

Documents of more than a window are cut first: full windows are windows of their own,
and the remainder goes to the differencing. Documents are spread by a hash over groups of
about ``WINDOWS`` windows and at most about ``ITEMS`` documents, each solved alone, so
work and memory of a task do not grow with the corpus and a hot source is spread like any
other. Rows with the same id and size are counted first and numbered; the number is part
of the hash, so a hundred thousand copies of a row, or rows with null ids, spread as well.

Defined results: null and empty texts have no tokens and are in no window. Rows that
repeat an id are documents of their own, as is each row with a null id. Equal sizes are
taken in the order of their ids, pieces and sizes. A very long text makes as many full
windows as it fills. Ids may be of any type that can be put in order. Further columns,
whatever their names, are not looked at. An empty table gives no windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom import store
from sparkloom.llm.groups import lean, runs, whole_groups
from sparkloom.llm.mixing import counted, repeated
from sparkloom.llm.tokens import DEFAULT_VOCABULARY

CAPACITY = 4096
WINDOWS = 32
ITEMS = 4096


def _merge(a: list, b: list, k: int) -> list:
    """Two partial partitions as one: windows in falling order, empty ones left out."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    alone = k - len(b)
    joined = a[:alone] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[alone:], reversed(b))]
    joined += b[: len(b) - max(0, len(a) - alone)]
    joined.sort(key=lambda w: w[0], reverse=True)
    return joined


def _leaves(tree, out: list[int]) -> list[int]:
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node)
        else:
            out.append(node)
    return out


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """``k`` near-equal windows as ``(tokens, items)``, in falling order; empty ones left out."""
    heap = [(-size, at, [(size, at)]) for at, size in enumerate(sizes)]
    heapq.heapify(heap)
    ticket = len(sizes)
    while len(heap) > 1:
        one = heapq.heappop(heap)[2]
        two = heapq.heappop(heap)[2]
        both = _merge(one, two, k)
        low = both[-1][0] if len(both) == k else 0
        if low:  # what all windows have in common makes no spread
            spread = both[0][0] - low
        else:
            spread = both[0][0]
        heapq.heappush(heap, (-spread, ticket, both))
        ticket += 1
    return [(total, _leaves(tree, [])) for total, tree in heap[0][2]] if heap else []


def least_windows(sizes: list[int], capacity: int) -> int:
    """Windows needed at least: for the sum, and as j items of over capacity / (j + 1) fill one."""
    falling = -np.sort(-np.asarray(sizes, np.int64))
    least = max(1, -(-int(falling.sum()) // capacity))
    j = 1
    while j < len(falling) and capacity // (j + 1) > 0:
        large = int(np.searchsorted(-falling, -(capacity // (j + 1)), side="left"))
        least = max(least, -(-large // j))
        if large == len(falling):
            break
        j += 1
    return least


def windows(sizes: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """A differencing within the capacity, of as few windows as the search finds."""
    if not sizes:
        return []
    failed, k, step = 0, least_windows(sizes, capacity), 1
    while (found := differencing(sizes, k))[0][0] > capacity:
        failed, k, step = k, min(k + step, len(sizes)), step * 2
    while failed and k - failed > 1:
        middle = (failed + k) // 2
        tried = differencing(sizes, middle)
        if tried[0][0] <= capacity:
            found, k = tried, middle
        else:
            failed = middle
    return found


def pack(
    df: DataFrame,
    capacity: int = CAPACITY,
    path: str = DEFAULT_VOCABULARY,
    group_windows: int = WINDOWS,
    group_items: int = ITEMS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(window_id, doc_id, piece, start_token, n_tokens, window_tokens)``, a row for each piece.

    ``start_token`` is the piece's place in its document. ``window_tokens`` is what its
    window holds in all, at most ``capacity``.
    """
    plain = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = counted(plain, path).where("n_tokens > 0").groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies"))
    sized = store.written(counts, "sized")
    total, items = sized.agg(F.sum(F.col("n_tokens") * F.col("copies")), F.sum("copies")).first()
    groups = max(1, -(-(total or 0) // (capacity * group_windows)), -(-(items or 0) // group_items))
    each = repeated(sized, "copies", "copy")
    grouped = each.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id", "n_tokens", "copy"), F.lit(groups)).alias("group"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "group"):
            keys = table.column("group").to_numpy()
            ids, tokens = table.column("doc_id"), table.column("n_tokens").to_numpy()
            for start, size in zip(*runs(keys)):
                rows = _solve_group(tokens[start : start + size], capacity)
                rows[:, 0] += int(keys[start]) << 32
                out = [pa.array(rows[:, c]) for c in (0, 2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays(
                    [out[0], ids.slice(start, size).combine_chunks().take(pa.array(rows[:, 1])), *out[1:]],
                    names=["window_id", "doc_id", "piece", "start_token", "n_tokens", "window_tokens"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"window_id long, doc_id {kind}, piece long, start_token long, n_tokens long, window_tokens long"
    return grouped.repartition("group").sortWithinPartitions("group", "doc_id", "n_tokens").mapInArrow(lean(solve), schema)


def _solve_group(tokens: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of window, document, piece, start, tokens and window's tokens for one group."""
    rows, number = [], 0
    for doc in np.flatnonzero(tokens >= capacity).tolist():
        for piece in range(int(tokens[doc]) // capacity):
            rows.append((number, doc, piece, piece * capacity, capacity, capacity))
            number += 1
    rest = tokens % capacity
    items = np.flatnonzero(rest)
    for total, members in windows(rest[items].tolist(), capacity):
        for item in sorted(members):
            doc = int(items[item])
            piece = int(tokens[doc]) // capacity
            rows.append((number, doc, piece, piece * capacity, int(rest[doc]), total))
        number += 1
    return np.array(rows, np.int64).reshape(-1, 6)
