"""Keyed tables: upserts and merges, counts, percentiles."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import urls


def last_of(df: DataFrame, key: str, order_col: str | None = None) -> DataFrame:
    """One row for each key: the last by ``order_col``, or by the order of the rows where that is None."""
    at = F.col(order_col) if order_col else F.monotonically_increasing_id()
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.col(key).alias("_k"), row.alias("_r"), at.alias("_o")).groupBy("_k").agg(F.max_by("_r", "_o").alias("_r")).select("_r.*")


def upsert(target: DataFrame, source: DataFrame, key: str, order_col: str | None = None) -> DataFrame:
    """All rows of ``source``, the last of each key, and those of ``target`` whose key it lacks; columns by name."""
    own = last_of(source, key, order_col).select(*target.columns)
    return target.join(own.select(key), key, "left_anti").select(*target.columns).unionByName(own)


def merge_counts(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``(written)``: how many keys of ``source`` are new to ``target``."""
    return source.select(key).distinct().join(target.select(key), key, "left_anti").agg(F.count("*").alias("written"))


def merge_queue(queued: DataFrame, source: DataFrame, seen: DataFrame) -> DataFrame:
    """The queue with the source's URLs that are neither seen nor queued."""
    fresh = source.select("url").distinct().join(seen.select("url"), "url", "left_anti").join(queued.select("url"), "url", "left_anti")
    return queued.select("url").unionByName(fresh)


#: The families that a merge takes over, in its order, and their keys; the queue comes last.
FAMILIES = {
    "seen": "url", "robots": "host", "content": "url", "chunks": "chunk_id",
    "embeddings": "chunk_id", "wiki": "wiki_key", "clicks": "click_id", "to_crawl": "url",
}


def merge_all(target: Mapping[str, DataFrame], source: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The merged families, and ``(family, written)``: how many keys were new to each.

    The source wins in all families but ``to_crawl``, which takes over what is neither queued
    nor seen, after the merge, in the target. Families that the source lacks, or that a merge does not
    take over (visits, article vectors, the queue of pages to chunk), stay as they are.
    """
    merged, written = dict(target), []
    for family, key in FAMILIES.items():
        if family not in source:
            continue
        own = source[family]
        if family not in target:
            merged[family] = last_of(own, key)
            new = own.select(key).distinct().agg(F.count("*").alias("written"))
        elif family == "to_crawl":
            merged[family] = merge_queue(target[family], own, merged["seen"]) if "seen" in merged else merge_queue(target[family], own, target[family])
            held = target[family].select(key).unionByName(merged["seen"].select(key)) if "seen" in merged else target[family]
            new = merge_counts(held, own, key)
        else:
            merged[family] = upsert(target[family], own, key)
            new = merge_counts(target[family], own, key)
        written.append(new.select(F.lit(family).alias("family"), "written"))
    return merged, reduce(DataFrame.unionByName, written)


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(name, rows)`` of every table, in one job."""
    each = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out


def top_hosts(pages: DataFrame, url_col: str = "url", n: int = 20) -> DataFrame:
    """The n hosts with the most rows; rows without a host do not count."""
    counted = pages.select(urls.host(url_col).alias("host")).where("host is not null").groupBy("host").agg(F.count("*").alias("pages"))
    return counted.orderBy(F.desc("pages"), "host").limit(n)


#: Groups of up to this many values are put in order whole.
SMALL_GROUP = 4096


def percentile(df: DataFrame, value: str, share: float, by: list[str], small_group: int = SMALL_GROUP) -> DataFrame:
    """The nearest-rank percentile of each group: an actual value, nothing in between.

    The rank is (n - 1) * share, rounded, halves up. Groups of up to ``small_group`` values are
    put in order whole. Of larger ones sketches bracket the rank, 2 % to either side where
    a sketch errs by 0.05 %, and only the values between the brackets are put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    sketch = F.percentile_approx("_v", F.array(F.lit(max(0.0, share - 0.02)), F.lit(min(1.0, share + 0.02))), F.lit(2000))
    bounds = rows.groupBy(*by).agg(sketch.alias("_b"), F.count("*").alias("_all"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    whole = F.col("_all") <= small_group
    low = F.when(whole | F.lit(share <= 0.02), F.col("_low")).otherwise(F.col("_b")[0])
    high = F.when(whole | F.lit(share >= 0.98), F.col("_high")).otherwise(F.col("_b")[1])
    near = rows.join(bounds.select(*by, "_all", low.alias("_from"), high.alias("_to")), by)
    below = near.groupBy(*by).agg(F.sum((F.col("_v") < F.col("_from")).cast("long")).alias("_below"))
    order = Window.partitionBy(*by).orderBy("_v")
    inside = near.where(F.col("_v").between(F.col("_from"), F.col("_to"))).withColumn("_n", F.row_number().over(order)).join(below, by)
    at = F.floor((F.col("_all") - 1) * share + 0.5) + 1
    return inside.where(F.col("_n") + F.col("_below") == at).select(*by, F.col("_v").alias("percentile"))
