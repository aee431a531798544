"""Contiguous shards whose largest is as small as can be.

Groups that must not be cut (here the rows of one key) have sizes, in the order of their
keys. A shard capacity is feasible if filling shards greedily needs no more than the
wanted number of them. The smallest feasible capacity is found by binary search between
the larger of the largest group and the average, and that plus the largest group; the
cuts are those of the greedy filling at that capacity.

Sizes are summed for each group across the cluster. The search needs them in order, and one task
reads them as a sorted stream: it holds the key and eight bytes of size for each group,
and a trial capacity costs a binary search in the prefix sums for each shard. Only the
cuts, a row for each shard, come to the driver; groups are then given their shard in
parallel where they are. Where groups are too many for one task's memory (some 10^8),
group by a coarser key, such as the file or the host.

Defined results: rows with a null key form one group, ahead of all others. A null size
counts as 0. Rows that repeat a key are of one group. With fewer groups than shards,
some shards are left out. A group larger than all others together is a shard of its own, and
sizes may be as large as a 64-bit sum allows. An empty table gives no rows. Other columns are
not looked at. A key column called ``size``, ``shard`` or ``shard_size`` is called ``key`` in the result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import store

SHARDS = 64


def greedy_cuts(prefix: np.ndarray, capacity: int, most: int) -> list[int] | None:
    """Where each shard ends when filled up to ``capacity``; None beyond ``most`` shards.

    ``prefix[i]`` is the size of the first ``i`` groups.
    """
    cuts, at, n = [], 0, len(prefix) - 1
    while at < n:
        if len(cuts) == most:
            return None
        end = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        if end == at:
            return None
        cuts.append(end)
        at = end
    return cuts


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the end of each shard."""
    if not len(sizes):
        return 0, []
    prefix = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    largest = int(np.max(sizes))
    low = max(largest, -(-int(prefix[-1]) // shards))
    high = low + largest
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(prefix, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, greedy_cuts(prefix, low, shards)


def shard_cuts(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(shard, first_key, n_groups, shard_size, capacity)`` of every shard, in order.

    ``sizes`` has a row ``(key, size)`` for each group.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts = [], []
        for batch in batches:
            keys.append(batch.column(0))
            parts.append(batch.column(1).to_numpy(zero_copy_only=False))
        if not parts:
            return
        all_sizes = np.concatenate(parts)
        capacity, ends = minimax_cuts(all_sizes, shards)
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(ends), dtype=np.int32)),
                pa.chunked_array(keys).take(pa.array(starts)).combine_chunks(),
                pa.array(np.array(ends, np.int64) - starts),
                pa.array(np.add.reduceat(all_sizes, starts)),
                pa.array(np.full(len(ends), capacity, np.int64)),
            ],
            names=["shard", "first_key", "n_groups", "shard_size", "capacity"],
        )

    kind = sizes.schema["key"].dataType.simpleString()
    schema = f"shard int, first_key {kind}, n_groups long, shard_size long, capacity long"
    return sizes.select("key", "size").repartition(1).sortWithinPartitions(F.asc_nulls_first("key")).mapInArrow(search, schema)


def shard(df: DataFrame, key_col: str, size: Column, shards: int = SHARDS) -> DataFrame:
    """``(key, size, shard, shard_size)`` of every group; ``key`` has the name of its column."""
    key_name = "key" if key_col in ("size", "shard", "shard_size") else key_col
    grouped = df.groupBy(F.col(key_col).alias("key")).agg(F.sum(F.coalesce(size, F.lit(0)).cast("long")).alias("size"))
    sizes = store.written(grouped, "sizes")
    cuts = shard_cuts(sizes, shards).orderBy("shard").collect()
    # the null key's group, if there is one, is the first of shard 0
    firsts = [cut.first_key for cut in cuts[1:]]
    totals = np.array([cut.shard_size for cut in cuts], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([0 if k is None else bisect_right(firsts, k) for k in batch.column(0).to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at), pa.array(totals[at])], names=[key_name, "size", "shard", "shard_size"]
            )

    schema = T.StructType(
        [
            T.StructField(key_name, sizes.schema["key"].dataType),
            T.StructField("size", T.LongType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("shard_size", T.LongType()),
        ]
    )
    return sizes.mapInArrow(place, schema)


#: The same search by bisection, a step for each shard of each trial; for tables of some thousand groups.
ORACLE_SQL = f"""
WITH RECURSIVE g AS (SELECT conv_id, CAST(sum(coalesce(octet_length(encode(text)), 0)) AS BIGINT) AS size FROM conversations GROUP BY conv_id),
o AS (SELECT conv_id, size, CAST(sum(size) OVER (ORDER BY conv_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM g),
l AS (SELECT list(upto ORDER BY upto) AS ends, CAST(max(upto) AS BIGINT) AS total, max(size) AS large FROM o),
search AS (
  SELECT ends, total, greatest(large, (total + {SHARDS} - 1) // {SHARDS}) AS lo, greatest(large, (total + {SHARDS} - 1) // {SHARDS}) + large AS hi, CAST(0 AS BIGINT) AS pos, 0 AS used FROM l
  UNION ALL
  SELECT ends, total,
    CASE WHEN pos < total AND used = {SHARDS} THEN (lo + hi) // 2 + 1 ELSE lo END,
    CASE WHEN pos = total THEN (lo + hi) // 2 ELSE hi END,
    CASE WHEN pos = total OR used = {SHARDS} THEN 0 ELSE list_max(list_filter(ends, lambda e: e <= pos + (lo + hi) // 2)) END,
    CASE WHEN pos = total OR used = {SHARDS} THEN 0 ELSE used + 1 END
  FROM search WHERE lo < hi
),
best AS (SELECT ends, total, lo AS capacity FROM search WHERE lo >= hi LIMIT 1),
cuts AS (
  SELECT ends, total, capacity, CAST(0 AS BIGINT) AS start, list_max(list_filter(ends, lambda e: e <= capacity)) AS stop, 0 AS shard FROM best
  UNION ALL
  SELECT ends, total, capacity, stop, list_max(list_filter(ends, lambda e: e <= stop + capacity)), shard + 1 FROM cuts WHERE stop < total
)
SELECT conv_id, size, shard, stop - start AS shard_size FROM o JOIN cuts ON upto > start AND upto <= stop
"""
