"""Exact BM25 top-k for many queries, with block-max pruning over a stored forward index.

Documents are cut into blocks of up to ``BLOCK`` that follow one another in the table. The
index has a row for each block: every word of its documents, in how many of them it is, the
largest count and the smallest document length that go with it, and the forward index, which
tells for each document the words it holds and how often. It depends on the documents alone:
:func:`build_index` reads the texts and is written once, :func:`search` answers any number of
batches of queries from it and reads no text. Corpus statistics (documents, their mean
length, documents for each word) are exact sums over the index.

A word's score grows with its count and falls with the document's length, so the stored
extremes bound what it can score in a block. The sum of the bounds of a query's words bounds
every document of the block. For every query, a task orders its blocks, ``BLOCKS_AT_ONCE`` at
a time, by that sum and scores them through the forward index until the next bound falls below
the k-th best score so far; blocks that no query reaches are never decoded. A first pass scores
just the best block of each task; the k-th best score over all tasks is where every task
starts in the second.

``QUERIES`` queries are searched together; their words are what the tasks are sent. More
queries make more rounds over the index.

The score is rounded to six places before ranking; equal scores rank by document id.
A word counts once in a query. Words are lower-case runs of letters, digits and underscores.

Defined results: null, empty and wordless texts are no documents, nor are rows with a null
id; they count in no statistic. Rows that repeat an id are documents of their own, and so
may appear more than once. Queries without words, with a null id or with no matching
document have no rows; queries that repeat an id and text are one. An empty table of documents
or queries gives no rows. A very long text is one document of its block. Document ids are
whole numbers; other types are refused. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import store
from sparkloom.llm.groups import lean
from sparkloom.llm.tokens import ragged, slices
from sparkloom.llm.words import lower_words, stretches

K, K1, B = 10, 1.2, 0.75
BLOCK = 128
BLOCKS_AT_ONCE = 128
BYTES_AT_ONCE = 2 << 20
#: Rows of the index are some 100 kB, so its files have small row groups.
ROW_GROUP = 16 << 20
QUERIES = 2048
DIGITS = 6
SLACK = 1e-5

_INDEX = (
    "n_docs long, n_words long, words string, word_docs binary, most_count binary, least_length binary, "
    "ids binary, lengths binary, ends binary, terms binary, counts binary"
)


def query_words(texts: list[str | None]) -> list[list[str]]:
    """The distinct words of each query, in order."""
    words, sizes = lower_words(pa.array([t or "" for t in texts], pa.string()))
    ends = np.cumsum(sizes)
    flat = words.to_pylist()
    return [sorted(set(flat[end - size : end])) for end, size in zip(ends.tolist(), sizes.tolist())]


def _blocks(ids: np.ndarray, texts: pa.Array) -> Iterator[tuple]:
    codes, offsets, distinct = stretches(texts)
    words, sizes = lower_words(distinct)
    coded = words.dictionary_encode()
    known, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    starts = np.cumsum(sizes) - sizes
    per = np.r_[0, np.cumsum(sizes[codes])][offsets]
    lengths = np.diff(per)
    n = max(1, len(words))
    key, tf = np.unique(np.repeat(np.arange(len(ids)), lengths) * n + known[ragged(starts[codes], sizes[codes])], return_counts=True)
    rows = np.flatnonzero(lengths)
    for at in range(0, len(rows), BLOCK):
        own = rows[at : at + BLOCK]
        low, high = np.searchsorted(key, [own[0] * n, (own[-1] + 1) * n])
        doc, term = np.divmod(key[low:high], n)
        held, count = np.unique(term), tf[low:high]
        local = np.searchsorted(held, term)
        most, least = np.zeros(len(held), np.int64), np.full(len(held), np.iinfo(np.int64).max)
        np.maximum.at(most, local, count)
        np.minimum.at(least, local, lengths[doc])
        ends = np.searchsorted(doc, own, side="right")
        sizes_ = [x.astype(np.int32).tobytes() for x in (lengths[own], ends)]
        packed = [*map(_narrow, (np.bincount(local), most, least)), ids[own].tobytes(), *sizes_, _narrow(local), _narrow(count)]
        yield len(own), int(lengths[own].sum()), " ".join(words.take(pa.array(held)).to_pylist()), *packed


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest of 1, 2 or 4 bytes each."""
    most = numbers.max(initial=0)
    return numbers.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    """The n numbers that :func:`_narrow` wrote."""
    return np.frombuffer(raw, f"u{max(1, len(raw) // max(1, n))}")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each block of documents; write it, and search it as often as wanted."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of a type of whole numbers")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_numpy(), 0
            for part in slices(batch.column(1), BYTES_AT_ONCE):
                rows = list(_blocks(ids[at : at + len(part)], part))
                at += len(part)
                if rows:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 8])]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _INDEX.split(", ")])

    plain = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(lean(work), _INDEX)


def _known(words: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For a batch of blocks: the number of each word in the vocabulary or -1, and where each block's begin."""
    parts = pc.split_pattern(words, " ")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    held = pc.fill_null(pc.index_in(parts.flatten(), value_set=vocabulary), -1).to_numpy().astype(np.int64)
    return held, offsets - offsets[0]


def _df(index: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """In how many documents each word of the vocabulary is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, asked = np.zeros(len(vocabulary), np.int64), pa.array(vocabulary, pa.string())
        for batch in batches:
            held, offsets = _known(batch.column(0), asked)
            docs = np.concatenate([np.empty(0, np.int64), *[_wide(raw, n) for raw, n in zip(batch.column(1).to_pylist(), np.diff(offsets))]])
            total += np.bincount(held[held >= 0], docs[held >= 0], minlength=len(vocabulary)).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])

    found = index.select("words", "word_docs").mapInArrow(work, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


class Block:
    """One block for one batch of queries: bounds at once, the forward index when it is asked for."""

    def __init__(self, row: dict, terms: np.ndarray, searcher: Searcher):
        self.row, self.terms, self.searcher, self._held = row, terms, searcher, None
        self.found = np.flatnonzero(terms >= 0)
        most, least = (_wide(row[c], len(terms))[self.found].astype(np.int64) for c in ("most_count", "least_length"))
        self.bound = searcher.impact(terms[self.found], most, least)

    @property
    def forward(self) -> tuple:
        """Ids of the documents with any of the batch's words, where their postings begin, and these."""
        if self._held is None:
            ids, lengths, ends = (np.frombuffer(self.row[c], t) for c, t in (("ids", np.int64), ("lengths", np.int32), ("ends", np.int32)))
            local, counts = (_wide(self.row[c], int(ends[-1])) for c in ("terms", "counts"))
            doc = np.repeat(np.arange(len(ids)), np.diff(np.r_[0, ends]))
            term = self.terms[local]
            keep = np.flatnonzero(term >= 0)
            doc, term, counts = doc[keep], term[keep], counts[keep].astype(np.int64)
            held, starts = np.unique(doc, return_index=True)
            self._held = ids[held], starts, term, self.searcher.impact(term, counts, lengths[doc])
            self.row = {}
        return self._held


class Searcher:
    """Scores blocks against a set of queries; what a task is sent."""

    def __init__(self, queries: list[np.ndarray], vocabulary: list[str], idf: np.ndarray, mean: float, k: int, floor: np.ndarray):
        self.queries, self.vocabulary, self.idf, self.mean, self.k, self.floor = queries, vocabulary, idf, mean, k, floor
        self.blocks = self.decoded = 0

    def impact(self, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What words score by their counts in documents of some lengths."""
        return self.idf[terms] * (counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / self.mean)))

    def search(self, batches: Iterator[pa.RecordBatch], first_only: bool) -> Iterator[pa.RecordBatch]:
        """Each query's best documents of the blocks; with ``first_only``, of the best block alone."""
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in self.queries]
        floor, asked = self.floor.copy(), pa.array(self.vocabulary, pa.string())
        chunk: list[Block] = []
        for batch in (whole.slice(at, BLOCKS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, BLOCKS_AT_ONCE)):
            held, offsets = _known(batch.column("words"), asked)
            held = held.astype(np.int32)
            for row, a, b in zip(batch.drop_columns(["words"]).to_pylist(), offsets, offsets[1:]):
                chunk.append(Block(row, held[a:b].copy(), self))
                if len(chunk) == BLOCKS_AT_ONCE:
                    self._chunk(chunk, best, floor, first_only)
                    chunk = []
        if chunk:
            self._chunk(chunk, best, floor, first_only)
        rows = [(np.full(len(s), q), i, s) for q, (s, i) in enumerate(best)]
        if rows:
            q, i, s = (np.concatenate(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=["q", "doc_id", "score"])

    def _chunk(self, chunk: list[Block], best: list, floor: np.ndarray, first_only: bool) -> None:
        size = len(self.idf)
        lens = np.array([len(q) for q in self.queries])
        heads, flat = np.cumsum(lens) - lens, np.concatenate(self.queries)
        bounds = np.empty((len(chunk), len(self.queries)))
        most = np.zeros(size)
        for b, block in enumerate(chunk):
            most[:] = 0
            most[block.terms[block.found]] = block.bound
            bounds[b] = np.add.reduceat(most[flat], heads)
        has = np.zeros(size)
        for q, terms in enumerate(self.queries):
            has[:] = 0
            has[terms] = 1
            order = np.argsort(-bounds[:, q], kind="stable")
            for b in order[:1] if first_only else order:
                bound = bounds[b, q]
                if bound <= 0 or bound + SLACK < floor[q]:
                    break
                ids, starts, held, impact = chunk[b].forward
                scores = np.round(np.add.reduceat(impact * has[held], starts), DIGITS)
                take = np.flatnonzero((scores > 0) & (scores >= floor[q]))
                if not len(take):
                    continue
                s, i = np.r_[best[q][0], scores[take]], np.r_[best[q][1], ids[take]]
                top = np.lexsort((i, -s))[: self.k]
                best[q] = s[top], i[top]
                if len(top) == self.k:
                    floor[q] = max(floor[q], s[top[-1]])
        self.blocks += len(chunk)
        self.decoded += sum(block._held is not None for block in chunk)


def _round(index: DataFrame, n: int, mean: float, keys: list, words: list[list[str]], k: int, query_id: str, kind: str) -> DataFrame:
    vocabulary = sorted({w for own in words for w in own})
    place = {w: i for i, w in enumerate(vocabulary)}
    queries = [np.array([place[w] for w in own], np.int64) for own in words]
    df = _df(index, vocabulary)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def run(floor: np.ndarray, first_only: bool) -> DataFrame:
        own = Searcher(queries, vocabulary, idf, mean, k, floor)
        return index.mapInArrow(lean(lambda batches: own.search(batches, first_only)), "q long, doc_id long, score double")

    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    ranked = run(np.zeros(len(queries)), True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    floor = np.zeros(len(queries))
    for q, score in ranked.select("q", "score").collect():  # a row for each query, at most
        floor[q] = score
    found = run(floor, False).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = index.sparkSession.createDataFrame(list(enumerate(keys)), f"q long, {query_id} {kind}")
    return found.join(F.broadcast(names), "q").select(query_id, "rank", "doc_id", "score")  # at most QUERIES names


def search(index: DataFrame, queries: DataFrame, k: int = K, at_once: int = QUERIES, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``(query id, rank, doc_id, score)``: the k best documents of every query, from a written index."""
    kind = queries.schema[query_id].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("id"), F.col(query_text).alias("text")).where("id is not null and text is not null").distinct()
    n, total = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    rounds = max(1, math.ceil(asked.count() / at_once)) if n else 0
    found = []
    for r in range(rounds):
        rows = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(rounds)) == r).orderBy("id", "text").collect()
        words = query_words([row.text for row in rows])
        some = [i for i, own in enumerate(words) if own]
        if some:
            found.append(_round(index, n, total / n, [rows[i].id for i in some], [words[i] for i in some], k, query_id, kind))
    if not found:
        return index.sparkSession.createDataFrame([], f"{query_id} {kind}, rank int, doc_id long, score double")
    return reduce(DataFrame.unionByName, found)


def top_k(
    docs: DataFrame,
    queries: DataFrame,
    k: int = K,
    at_once: int = QUERIES,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
) -> DataFrame:
    """:func:`search` over an index of ``docs``, built and written for the purpose."""
    index = store.written(build_index(docs, id_col, text_col), "forward", **{"parquet.block.size": str(ROW_GROUP)})
    return search(index, queries, k, at_once, query_id, query_text)


ORACLE_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents WHERE doc_id IS NOT NULL
), lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
stats AS (SELECT count(*) AS docs, avg(n) AS mean FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM benchmark
), postings AS (
  SELECT doc_id, word, count(*) AS tf FROM words WHERE word IN (SELECT word FROM asked) GROUP BY doc_id, word
), df AS (SELECT word, count(*) AS df FROM postings GROUP BY word),
scored AS (
  SELECT item_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * n / mean))), {DIGITS}) AS score
  FROM asked JOIN postings USING (word) JOIN df USING (word) JOIN lengths USING (doc_id) CROSS JOIN stats
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
