"""JSON-line and JSON-document sources with explicit schemas; what does not parse is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import urls
from sparkloom.rules.seeds import SEEDS

HN_POINTS, LOBSTERS_SCORE = 100, 10
_LINE = "title string, summary string, extract string, image_url string, description string"
_HN = "hits array<struct<url:string,title:string,points:bigint,created_at_i:bigint>>"
_LOBSTERS = "array<struct<url:string,score:bigint>>"


def wiki_records(lines: DataFrame, line_col: str = "value", order_col: str | None = None) -> DataFrame:
    """``(wiki_key, title, summary, image_url, description)`` of JSON lines; the last line of a key wins.

    An article needs a title and a summary (or else an extract). A present but empty
    summary is not replaced by the extract. ``order_col`` tells which line is later; it
    defaults to the order of the file.
    """
    at = F.col(order_col) if order_col else F.monotonically_increasing_id()
    parsed = lines.select(at.alias("at"), F.from_json(line_col, _LINE).alias("j"))
    title, summary = F.trim("j.title"), F.trim(F.coalesce("j.summary", "j.extract", F.lit("")))
    rows = parsed.select("at", title.alias("title"), summary.alias("summary"), "j.image_url", "j.description").where("title <> '' and summary <> ''")
    keyed = rows.select(wiki_key("title").alias("wiki_key"), "at", F.struct("title", "summary", "image_url", "description").alias("r"))
    return keyed.groupBy("wiki_key").agg(F.max_by("r", "at").alias("r")).select("wiki_key", "r.*")


def wiki_key(title: Column | str) -> Column:
    """An article's key: its title with ASCII letters in lower case."""
    return F.translate(title, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """:func:`wiki_records` of a file or folder of JSON lines."""
    return wiki_records(spark.read.text(path))


def wiki_text() -> Column:
    """What of an article is embedded: title, summary and description, a line each."""
    return F.concat_ws("\n", "title", "summary", F.nullif(F.trim("description"), F.lit("")))


def hn_links(bodies: DataFrame, body_col: str = "value") -> DataFrame:
    """``(url, created_at)`` of stories above 100 points whose host is harvested."""
    hits = bodies.select(F.explode(F.from_json(body_col, _HN)["hits"]).alias("h")).select("h.*")
    good = hits.where((F.col("points") > HN_POINTS) & (F.coalesce("url", F.lit("")) != "") & urls.harvest_worthy("url"))
    return good.select("url", F.col("created_at_i").alias("created_at"))


def hn_cursor(bodies: DataFrame, body_col: str = "value") -> DataFrame:
    """``(cursor, n)``: the earliest positive time among all stories, and how many there are."""
    hits = bodies.select(F.explode(F.from_json(body_col, _HN)["hits"]).alias("h"))
    return hits.agg(F.min(F.when(F.col("h.created_at_i") > 0, F.col("h.created_at_i"))).alias("cursor"), F.count("*").alias("n"))


def lobsters_links(bodies: DataFrame, body_col: str = "value") -> DataFrame:
    """``(url)`` of stories scored ten or more whose host is harvested."""
    items = bodies.select(F.explode(F.from_json(body_col, _LOBSTERS)).alias("i")).select("i.*")
    return items.where((F.coalesce("score", F.lit(0)) >= LOBSTERS_SCORE) & (F.coalesce("url", F.lit("")) != "") & urls.harvest_worthy("url")).select("url")


def tildes_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(url)`` of a page's outward links whose host is harvested."""
    links = pages.select(F.explode(F.regexp_extract_all(html_col, F.lit('href="(http[^"]+)"'), 1)).alias("url"))
    return links.where(~F.col("url").contains("tildes.net") & urls.harvest_worthy("url"))


def enqueue(links: DataFrame, seen: DataFrame, queued: DataFrame) -> DataFrame:
    """Canonical distinct links that are neither seen nor queued."""
    known = links.select(urls.canonicalize("url").alias("url")).where("url is not null").distinct()
    return known.join(seen.select("url"), "url", "left_anti").join(queued.select("url"), "url", "left_anti")


def seeds(spark: SparkSession, urls_=None) -> DataFrame:
    """The admitted ones of some URLs, by default the engine's own list, as frontier rows at depth 0."""
    listed = [f"https://{place}" for place in SEEDS] if urls_ is None else list(urls_)
    df = spark.createDataFrame([(u,) for u in listed], "url string").select(urls.canonicalize("url").alias("url")).distinct()
    fit = df.where(F.col("url").isNotNull() & urls.rejected_by("url").isNull())
    return fit.select("url", urls.host("url").alias("host"), F.lit(0).alias("depth"), urls.priority("url", F.lit(0)).alias("priority"))


def enqueue_counts(links: DataFrame, seen: DataFrame, queued: DataFrame) -> DataFrame:
    """``(enqueued, skipped)`` of :func:`enqueue`: links that enter the queue, and all others."""
    known = links.select(urls.canonicalize("url").alias("url")).where("url is not null").groupBy("url").agg(F.count("*").alias("n"))
    old = seen.select("url").unionByName(queued.select("url")).distinct().withColumn("old", F.lit(1))
    told = known.join(old, "url", "left").agg(F.count("*").alias("all"), F.sum("n").alias("rows"), F.count("old").alias("old"))
    enqueued = F.coalesce(F.col("all") - F.col("old"), F.lit(0))
    return told.select(enqueued.alias("enqueued"), (F.coalesce("rows", F.lit(0)) - enqueued).alias("skipped"))


def label_rows(statements: DataFrame, page_col: str, order_col: str, text_col: str) -> DataFrame:
    """Each statement with up to three before it on its page: what is labelled by hand."""
    order = Window.partitionBy(page_col).orderBy(order_col)
    before = [F.lag(text_col, n).over(order).alias(f"prev_{n}") for n in (1, 2, 3)]
    return statements.select(page_col, order_col, F.col(text_col).alias("current_sentence"), *before)


def training_pairs(labelled: DataFrame) -> DataFrame:
    """``(current_sentence, previous, position, target)``: a row for each statement before that is not blank."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("position"), F.col(f"prev_{n}").alias("previous")) for n in (1, 2, 3)])).alias("x")
    rows = labelled.select("current_sentence", "label", each).where(F.trim(F.coalesce("x.previous", F.lit(""))) != "")
    return rows.select("current_sentence", "x.previous", "x.position", (F.col("label") == F.col("x.position")).cast("int").alias("target"))
