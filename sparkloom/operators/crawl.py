"""The crawl as waves over keyed tables: plan, parse, persist, follow links, until nothing is left.

State is a set of tables (``seen``, ``to_crawl``, ``domains``, ``content``, ``normalize_queue``,
``robots``). A wave takes the best admitted frontier rows of every host, meets them with what was
fetched for them, and gives the next state; each wave's tables are written to the shared folder,
so the lineage does not grow and a lost executor costs a wave at most. Fetching itself is
outside: ``fetched`` has the pages by URL.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom import store
from sparkloom.functions import urls
from sparkloom.operators import pages, tables

SCHEMAS = {
    "seen": "url string",
    "to_crawl": "url string, depth int",
    "domains": "key string, visited_at long",
    "content": "url string, title string, description string, blocks array<struct<heading_chain:array<string>,text:string>>",
    "normalize_queue": "url string",
    "robots": "host string, disallow array<string>",
}
State = dict[str, DataFrame]


def empty_state(spark: SparkSession, **tables_: DataFrame) -> State:
    """A state in which all tables but the given ones are empty."""
    return {name: tables_.get(name, spark.createDataFrame([], schema)) for name, schema in SCHEMAS.items()}


def host_counts(content: DataFrame) -> DataFrame:
    """``(host, n)``: pages stored of each host."""
    return content.select(urls.host("url").alias("host")).where("host is not null").groupBy("host").agg(F.count("*").alias("n"))


def admit(state: Mapping[str, DataFrame], links: DataFrame, max_depth: int = 6, caps: bool = True) -> DataFrame:
    """Links ``(url, depth)`` as frontier rows, without what is seen, stored, over its host's cap (with ``caps``) or forbidden."""
    known = state["seen"].select("url").unionByName(state["content"].select("url")).distinct()
    none = state["seen"].select("url").limit(0)
    counts = host_counts(state["content"] if caps else state["content"].limit(0))
    return pages.admit(links, F.col("depth"), known, none, state["robots"], counts, max_depth)


def recover(state: State) -> tuple[State, DataFrame]:
    """The queue with its inadmissible rows purged, at depth 0, and ``(live, purged)``."""
    queued = state["to_crawl"].select("url").distinct()
    live = admit(state, queued.withColumn("depth", F.lit(0))).select("url", "depth")
    left = queued.agg(F.count("*").alias("all")).crossJoin(live.agg(F.count("*").alias("live")))  # one row each
    return state | {"to_crawl": live}, left.select("live", (F.col("all") - F.col("live")).alias("purged"))


def enqueue(state: State, links: DataFrame, caps: bool = True) -> State:
    """The state with admitted links ``(url, depth)`` added to the queue, unless they are queued already."""
    fresh = admit(state, links, caps=caps).select("url", "depth").join(state["to_crawl"].select("url"), "url", "left_anti")
    return state | {"to_crawl": state["to_crawl"].unionByName(fresh)}


def next_wave(state: State, per_host: int, limit: int | None = None, rate_ms: int = 100) -> DataFrame:
    """The rows ``(url, host, depth, priority, turn, start_ms)`` to fetch: each host's best, at its rate."""
    frontier = admit(state, state["to_crawl"])
    wave = pages.waves(frontier, rate_ms).where(F.col("turn") < per_host)
    return wave if limit is None else wave.orderBy("turn", "start_ms", F.desc("priority"), "url").limit(limit)


def persist(state: State, wave: DataFrame, fetched: DataFrame, now_ms: int, left: int | None = None, caps: bool = True) -> tuple[State, DataFrame]:
    """The state after a wave, and ``(url, reject_reason)`` of its rows.

    ``fetched`` has ``url, final_url, html`` and, if wanted, ``x_noindex`` and ``reject_reason`` (why a fetch
    failed). Rows without a page are rejected as ``fetch_failed``. All a page is called by (asked
    for, landed on, canonical) is seen and leaves the queue. Accepted pages, at most ``left`` of them
    and no more of a host than its cap leaves, enter content and the queue of pages to chunk. The outlinks of
    accepted and rejected pages, one deeper, are admitted to the queue; without ``caps`` those of hosts that are full too.
    """
    for name, kind in (("x_noindex", "boolean"), ("reject_reason", "string")):
        if name not in fetched.columns:
            fetched = fetched.withColumn(name, F.lit(None).cast(kind))
    landed = fetched.select("url", F.col("final_url").alias("landed_on"), "html", "x_noindex", F.col("reject_reason").alias("failed"))
    got = wave.select("url", "host", "depth", "priority").join(landed.dropDuplicates(["url"]), "url", "left")
    got = got.withColumn("failed", F.when(F.col("html").isNull(), F.coalesce("failed", F.lit("fetch_failed"))).otherwise(F.col("failed")))
    bad = got.where("failed is not null").select("url", "host", "depth", F.col("failed").alias("reason"))
    fine = got.where("failed is null")
    parsed = pages.parse_pages(fine.select("url", "depth", "priority", "landed_on", "html", "x_noindex"), "landed_on", "html", F.coalesce("x_noindex", F.lit(False)), keep=("url", "depth", "priority"))
    judged = store.written(parsed, "wave")
    counts = host_counts(state["content"]).withColumnRenamed("n", "had")
    good = judged.where("reject_reason is null").withColumn("host", urls.host("canonical_url"))
    best = Window.partitionBy("canonical_url").orderBy(F.desc("priority"), "depth", "url")
    once = good.withColumn("_n", F.row_number().over(best)).where("_n = 1").join(state["content"].select(F.col("url").alias("canonical_url")), "canonical_url", "left_anti")
    inside = Window.partitionBy("host").orderBy(F.desc("priority"), "depth", "canonical_url")
    room = once.withColumn("_n", F.row_number().over(inside)).join(counts, "host", "left")
    room = room.where(F.col("_n") + F.coalesce("had", F.lit(0)) <= urls.page_cap("host"))
    accepted = room if left is None else room.orderBy("_n", F.desc("priority"), "canonical_url").limit(left)
    accepted = store.written(accepted.select("canonical_url", "title", "description", "blocks"), "accepted")
    names = [judged.select(F.col(c).alias("url")) for c in ("url", "final_url", "canonical_url")] + [bad.select("url")]
    seen = reduce(DataFrame.unionByName, names).where("url is not null").distinct()
    links = judged.select(F.explode("outlinks").alias("url"), (F.col("depth") + 1).alias("depth"))
    visits = [
        judged.where("reject_reason is not null").select(urls.host("final_url").alias("key")),
        bad.select(F.col("host").alias("key")),
        accepted.select(F.col("canonical_url").alias("key")),
    ]
    visited = reduce(DataFrame.unionByName, visits).where("key is not null").distinct().withColumn("visited_at", F.lit(now_ms).cast("long"))
    content = accepted.select(F.col("canonical_url").alias("url"), "title", "description", "blocks")
    after = state | {
        "seen": state["seen"].unionByName(seen).distinct(),
        "to_crawl": state["to_crawl"].join(seen, "url", "left_anti"),
        "domains": tables.upsert(state["domains"], visited, "key"),
        "content": state["content"].unionByName(content),
        "normalize_queue": state["normalize_queue"].unionByName(content.select("url")).distinct(),
    }
    report = judged.select("url", "reject_reason").unionByName(bad.select("url", F.col("reason").alias("reject_reason")))
    return enqueue(after, links, caps), report


def crawl(
    state: State, fetched: DataFrame, now_ms: int, seeds: DataFrame | None = None, max_pages: int = 2_000_000,
    per_host: int = 64, rate_ms: int = 100, max_waves: int = 10_000,
) -> tuple[State, list[dict]]:
    """Waves until ``max_pages`` are stored or the frontier is empty; the state, and a report for each wave.

    A report has ``wave, fetched, accepted, rejected, queued``. ``max_waves`` stops a loop that a
    fault keeps going; reaching it is an error.
    """
    state, _ = recover(state)
    if seeds is not None:
        state = enqueue(state, seeds.select("url", F.lit(0).alias("depth")))
    stored = state["content"].count()
    reports: list[dict] = []
    for number in range(max_waves):
        if stored >= max_pages:
            return state, reports
        wave = store.written(next_wave(state, per_host, rate_ms=rate_ms), "next")
        asked = wave.count()
        if not asked:
            return state, reports
        after, report = persist(state, wave, fetched, now_ms, max_pages - stored)
        held = {name: store.written(df, name) for name, df in after.items() if name != "robots"}
        judged = report.agg(F.count("*"), F.count("reject_reason")).first()
        before, state = state, after | held
        for name in held:
            store.drop(before[name])
        store.drop(wave)
        had, stored = stored, state["content"].count()
        reports.append({"wave": number, "fetched": asked, "accepted": stored - had, "rejected": judged[1], "queued": state["to_crawl"].count()})
    raise RuntimeError(f"the crawl did not end within {max_waves} waves")


def normalize(state: State, chunks: DataFrame, **settings: int) -> tuple[State, DataFrame]:
    """The queue of pages worked off: ``chunks`` with those of all queued pages in place of their old ones.

    Queued URLs without a stored page just leave the queue.
    """
    queued = state["content"].join(state["normalize_queue"].distinct(), "url", "left_semi")
    fresh = pages.chunk_records(queued.select("url", "title", "blocks"), **settings)
    kept = chunks.join(queued.select(F.col("url").alias("source_url")), "source_url", "left_anti")
    return state | {"normalize_queue": state["normalize_queue"].limit(0)}, kept.select(*fresh.columns).unionByName(fresh)
