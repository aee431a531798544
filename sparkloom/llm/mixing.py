"""Sources brought to target weights, by exact token budgets.

Every document gets a random key, the hash of its id and a seed. Within its source the
keys are put in order: a fixed range of keys goes to each of ``RANGES`` buckets, so the
ranges of even the largest source are sorted in parallel and no boundary has to be
sampled. Token sums of the buckets give each bucket its offset, a window inside the
bucket the rest of the prefix sum. A source with budget b and t tokens in all gives
b // t whole epochs, then the documents whose prefix starts below b mod t; of the last
of these it takes just the tokens that are missing.

Without ``weights`` a source's weight is its tokens to the power ``ALPHA``, which raises
small sources over their share and lowers large ones. Sources missing from ``weights``
get nothing. Weights are whole numbers of 2**-60 of the largest, so a light source keeps its
exact share. The shares are rounded to whole tokens by largest remainders (equal ones in
the order of the sources), so the budgets' sum is the mixture's size.

Defined results: a null source counts as the source ``""``. Null and empty texts have no
tokens and are in no mixture. Rows that repeat an id are documents of their own, in the
order of their token counts; of rows equal in both it does not matter which comes first. A
null id has a key like any other value. A source without tokens, and an empty table, give
no rows. A very long text is a document like any other, and the one at the cut gives only
what is missing. Further columns, whatever their names, pass through :func:`mix_documents`
and are not looked at by :func:`mixture`. Weights that are negative or not finite are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import store
from sparkloom.llm.groups import lean
from sparkloom.llm.tokens import DEFAULT_VOCABULARY, coder

ALPHA = 0.7
RANGES = 1024
SEED = 7
#: Up to this many sources (a key and two numbers each) are broadcast to the documents.
BROADCAST_SOURCES = 200_000
SALTS = 64


def counted(df: DataFrame, path: str = DEFAULT_VOCABULARY, text_col: str = "text") -> DataFrame:
    """``df`` without its text and with ``n_tokens``, the ids of each text under ``path``."""
    kept = [f for f in df.schema.fields if f.name not in (text_col, "n_tokens")]
    at = len(kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = coder(path).counts
        for batch in batches:
            sizes = pa.array(counts(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], sizes], names=[*batch.schema.names[:at], "n_tokens"])

    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType())])
    return df.select(*[f"`{f.name}`" for f in kept], f"`{text_col}`").mapInArrow(lean(work), schema)


def repeated(df: DataFrame, times: str, name: str) -> DataFrame:
    """Every row ``times`` times, numbered from 0 in ``name``; no array is longer than the root of it or 4,096."""
    size = F.greatest(F.lit(4096), F.ceil(F.sqrt(F.col(times).cast("double"))).cast("long"))
    first = df.where(F.col(times) > 0).withColumn("_size", size)
    first = first.withColumn("_part", F.explode(F.expr(f"sequence(0L, ({times} - 1) div _size)")))
    last = F.expr(f"sequence(_part * _size, least((_part + 1) * _size, {times}) - 1)")
    return first.withColumn(name, F.explode(last)).drop("_size", "_part")


def _whole_weights(weights: Mapping[str, float]) -> list[tuple[str, int]]:
    """Weights as whole numbers in proportion, the largest 2**60."""
    if any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    most = max([Fraction(w) for w in weights.values()], default=Fraction(0))
    return [(source, max(1, round(Fraction(w) / most * 2**60))) for source, w in weights.items() if w > 0]


def budgets(totals: DataFrame, weights: Mapping[str, float] | None, tokens: int | None, alpha: float = ALPHA) -> DataFrame:
    """``(source, total, budget)`` from ``(source, total)``, a row for each source."""
    held = totals.where("total > 0")
    if weights is None:
        w = F.greatest(F.lit(1.0), F.round(F.pow(F.col("total").cast("double"), F.lit(alpha)) * 2.0**20))
        weighted = held.withColumn("w", w.cast("decimal(20,0)"))
    else:
        given = held.sparkSession.createDataFrame([(s, w) for s, w in _whole_weights(weights)], "source string, w long")
        # as many rows as the caller's mapping has
        weighted = held.join(F.broadcast(given), "source", "left").withColumn("w", F.coalesce("w", F.lit(0)).cast("decimal(20,0)"))
    # one row, whatever the input
    whole = weighted.agg(F.sum("total").alias("tokens"), F.sum("w").cast("decimal(28,0)").alias("weights"))
    wanted = (F.col("tokens") if tokens is None else F.lit(tokens)).cast("decimal(17,0)")
    shared = weighted.crossJoin(F.broadcast(whole)).withColumn("wanted", wanted).withColumn("share", wanted * F.col("w"))
    floored = shared.where("weights > 0").select(
        "source", "total", "w", "wanted", F.expr("cast(share div weights as long)").alias("floor"), F.expr("share % weights").alias("rest"),
        F.floor(F.expr("cast(share % weights as double) / cast(weights as double)") * 1023).cast("int").alias("span"),
    )
    # the tokens that rounding down left over go to the largest remainders: first by ranges of these
    spans = floored.groupBy("span").agg(F.count("*").alias("n"), F.sum("floor").alias("floors"), F.max("wanted").alias("wanted"))
    ahead = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = spans.select("span", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), (F.col("wanted") - F.sum("floors").over(every)).alias("left"))
    inside = Window.partitionBy("span").orderBy(F.desc("rest"), "source")
    placed = floored.withColumn("at", F.row_number().over(inside)).join(F.broadcast(left), "span")  # at most 1,024 rows
    more = F.when((F.col("rest") > 0) & (F.col("ahead") + F.col("at") <= F.col("left")), 1).otherwise(0)
    return placed.select("source", "total", (F.col("floor") + more).alias("budget"))


def _placed(df, weights, tokens, path, seed, ranges, alpha, source_col, id_col, text_col) -> DataFrame:
    """Every document with its key, its source's whole epochs and what the last epoch takes of it."""
    plain = df.select(F.col(id_col).alias("doc_id"), _source(source_col).alias("source"), F.col(text_col).alias("text"))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    # the key's order is that of a signed 64-bit number; its top bits are its range
    span = F.floor((F.col("key") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(ranges)).cast("int")
    keyed = store.written(counted(plain, path).where("n_tokens > 0").withColumn("key", key).withColumn("span", span), "keyed")
    parts = keyed.groupBy("source", "span").agg(F.sum("n_tokens").alias("part"))
    running = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source", "span", F.coalesce(F.sum("part").over(running), F.lit(0)).alias("offset"))
    totals = parts.groupBy("source").agg(F.sum("part").alias("total"))
    plan = offsets.join(budgets(totals, weights, tokens, alpha), "source")
    inside = Window.partitionBy("source", "span").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(plan, ["source", "span"])
    start = F.col("offset") + F.col("inside")
    rest = F.expr("budget % total")
    last = F.when(start < rest, F.least("n_tokens", rest - start)).otherwise(F.lit(0))
    return placed.select("source", "doc_id", "key", "n_tokens", start.alias("start_token"), F.expr("budget div total").alias("whole"), last.alias("last"))


def _source(source_col: str) -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit(""))


def mixture(
    df: DataFrame,
    weights: Mapping[str, float] | None = None,
    tokens: int | None = None,
    path: str = DEFAULT_VOCABULARY,
    seed: int = SEED,
    ranges: int = RANGES,
    alpha: float = ALPHA,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(source, epoch, start_token, doc_id, n_tokens, take_tokens)`` of every document taken, by epoch.

    ``tokens`` is the size of the whole mixture; without it, that of the input.
    ``start_token`` is the document's place in its source's order.
    """
    taken = _placed(df, weights, tokens, path, seed, ranges, alpha, source_col, id_col, text_col).where("whole > 0 or last > 0")
    epochs = repeated(taken.withColumn("times", F.col("whole") + F.expr("if(last > 0, 1L, 0L)")), "times", "epoch")
    return epochs.select("source", "epoch", "start_token", "doc_id", "n_tokens", F.expr("if(epoch < whole, n_tokens, last)").alias("take_tokens"))


def mix_documents(
    df: DataFrame,
    weights: Mapping[str, float] | None = None,
    tokens: int | None = None,
    path: str = DEFAULT_VOCABULARY,
    seed: int = SEED,
    ranges: int = RANGES,
    alpha: float = ALPHA,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents of the mixture, once for each epoch that has them, with ``df``'s columns.

    The keys decide: a source's last epoch has what lies up to the key and id of its cut,
    a row for each source. So texts are not shuffled, and each document is judged where it
    is. Documents stay whole: the one at the cut brings all its text, and rows that repeat
    its id come with it.
    """
    placed = _placed(df, weights, tokens, path, seed, ranges, alpha, source_col, id_col, text_col)
    edge = F.max(F.when(F.col("last") > 0, F.struct("key", F.col("doc_id").alias("id"))))
    cuts = placed.groupBy(F.col("source").alias("_source")).agg(F.max("whole").alias("_whole"), edge.alias("_edge"))
    cuts = store.written(cuts, "cuts")
    id_ = F.col(f"_doc.`{id_col}`")
    own = F.struct(F.xxhash64(F.lit(seed), id_).alias("key"), id_.alias("id"))
    times = F.col("_whole") + F.when(own <= F.col("_edge"), 1).otherwise(0)
    doc = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc")
    held = df.where(F.length(f"`{text_col}`") > 0).select(_source(source_col).alias("_source"), doc)
    if cuts.count() <= BROADCAST_SOURCES:
        joined = held.join(F.broadcast(cuts), "_source")
    else:  # a hot source's documents meet one of many copies of its row
        salted = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = held.withColumn("_salt", F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int")).join(salted, ["_source", "_salt"])
    return repeated(joined.select("_doc", times.cast("long").alias("_times")), "_times", "_at").select("_doc.*")
