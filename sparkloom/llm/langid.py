"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word's subwords are its n-grams of ``GRAMS`` characters, with marks at both ends, and the word itself; each
is hashed to one of ``BUCKETS`` embeddings of ``DIM`` numbers. A text is the mean of the
embeddings of all its words' subwords, and a linear softmax gives the languages'
probabilities. Embeddings and softmax are trained together by stochastic gradient descent
in numpy, on passages of differing length from a sample of the labelled rows.

The sample is bounded: ``TRAIN_ROWS`` documents for each language, the lowest by a hash of the id among
those of up to ``TRAIN_CHARS`` characters. A quarter of them is held out, to fit the temperature
of the softmax and the two limits of rejection: a text is rejected if its probability or
the share of its subwords that training has seen is below nearly all of what the held-out
texts have (a share ``REJECTED`` of those that are recognised falls below). Texts without a
letter are rejected as well.

Since mean and softmax layer are both linear, tasks get their product: one row of scores
for each bucket, some MB whatever the corpus. Every text is read whole, on its own.

Defined results: every row has a row in the result, repeated rows and null ids too.
Null, empty and letterless texts, and all texts where no row has a label, have language
``und``, confidence 0 and are not accepted. Rejected texts keep their best guess and its
confidence. Rows with a null label are not trained on. A very long text counts whole, read on its
own, but is not trained on. An empty table gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.tokens import ragged, slices
from sparkloom.llm.words import stretches

BUCKETS, DIM, GRAMS = 1 << 16, 16, (2, 3, 4)
TRAIN_ROWS, TRAIN_CHARS, SEED = 200, 20_000, 11
EPOCHS, STEPS, BATCH, RATE = 4, 800, 16, 4.0
REJECTED = 0.002
BYTES_AT_ONCE = 4 << 20
UNKNOWN = "und"
_NOT_LETTERS = r"[^\p{L}\p{M}]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letter_words(distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case runs of letters in each stretch, one after the other, and how many each has."""
    parts = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(distinct), _NOT_LETTERS, " "), " ")
    words, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(filled)][offsets - offsets[0]]
    return words.filter(pa.array(filled)), np.diff(ends)


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' subwords one after the other, and how many each word has."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    points = np.frombuffer(("<" + pc.binary_join(whole, "><")[0].as_py() + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = pc.utf8_length(words).to_numpy().astype(np.int64) + 2
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))
    keys, owner = [], []
    hashed = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        hashed[: len(points) - n + 1] = (hashed[: len(points) - n + 1] ^ points[n - 1 :]) * _MIX
        hashed[: len(points) - n + 1] ^= hashed[: len(points) - n + 1] >> np.uint64(29)
        if n in GRAMS:
            at = np.flatnonzero(left >= n)
            keys.append(hashed[at] + np.uint64(n))
            owner.append(at)
    # the word itself: the sum of its characters, each mixed with its place
    place = (np.arange(len(points)) - np.repeat(ends - sizes, sizes)).astype(np.uint64)
    mixed = (points + place * np.uint64(1_000_003)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    keys.append(np.add.reduceat(mixed * _MIX, ends - sizes))
    owner.append(ends - 1)
    key, at = np.concatenate(keys), np.concatenate(owner)
    word = np.repeat(np.arange(len(words)), sizes)[at]
    order = np.argsort(word, kind="stable")
    buckets = ((key * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return buckets[order], np.bincount(word, minlength=len(words))


@dataclass
class Model:
    """What tasks need: a row for each bucket, with each language's score and whether it was seen."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    least_seen: float = 0.0

    def means(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean row of the table, and its number of subwords."""
        codes, offsets, distinct = stretches(texts)
        words, per = letter_words(distinct)
        buckets, sizes = subwords(words)
        width = self.table.shape[1] + 1
        # word, stretch and text sums are differences of one running sum each
        by_word = _sums(np.c_[self.table, np.ones(len(self.table), np.float32)], buckets, sizes)
        by_stretch = _sums(by_word, np.arange(len(words)), per)
        total = _sums(by_stretch, codes, np.diff(offsets)).reshape(-1, width)
        return total[:, :-1] / np.maximum(total[:, -1:], 1), total[:, -1]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number (-1 for none), its probability, and whether it is accepted."""
        mean, size = self.means(texts)
        seen = mean[:, -1]
        scores = (mean[:, :-1] + self.bias) / self.temperature
        chance = np.exp(scores - scores.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        best = np.where(size > 0, chance.argmax(axis=1), -1)
        most = np.where(size > 0, chance.max(axis=1), 0.0)
        return best, most, (size > 0) & (most >= self.least) & (seen >= self.least_seen)


def _sums(rows: np.ndarray, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``rows[index]`` over consecutive groups of the given sizes; 0 for empty ones."""
    out = np.zeros((len(sizes), rows.shape[1]))
    held = np.flatnonzero(sizes)
    if len(held):
        starts = (np.cumsum(sizes) - sizes)[held]
        for c in range(rows.shape[1]):
            out[held, c] = np.add.reduceat(rows[index, c], starts, dtype=np.float64)
    return out


def _passages(texts: list[str], labels: np.ndarray, dice: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """The texts cut into passages of 3 to 120 words."""
    out, of = [], []
    for text, label in zip(texts, labels):
        words, at = text.split(), 0
        while at < len(words):
            n = int(np.exp(dice.uniform(np.log(3), np.log(120))))
            out.append(" ".join(words[at : at + n]))
            of.append(label)
            at += n
    return out, np.array(of, np.int64)


def _buckets(texts: list[str]) -> list[np.ndarray]:
    codes, offsets, distinct = stretches(pa.array(texts, pa.string()))
    words, per = letter_words(distinct)
    buckets, sizes = subwords(words)
    first_word, first = np.cumsum(per) - per, np.cumsum(sizes) - sizes
    out = []
    for a, b in zip(offsets, offsets[1:]):
        own = codes[a:b]
        word = ragged(first_word[own], per[own])
        out.append(buckets[ragged(first[word], sizes[word])])
    return out


def train(texts: list[str], labels: list[str], seed: int = SEED) -> Model | None:
    """A model of labelled texts; None without any."""
    languages = sorted(set(labels))
    if not languages:
        return None
    dice = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    held = dice.permutation(len(texts)) % 4 == 0
    passages, of = _passages([t for t, h in zip(texts, held) if not h], y[~held], dice)
    bags = _buckets(passages)
    use = np.array([i for i, b in enumerate(bags) if len(b)], np.int64)
    rows = (dice.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    weights = dice.standard_normal((DIM, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    # small samples are gone through more often
    each = max(1, -(-len(use) // BATCH))
    epochs = max(EPOCHS, -(-STEPS // each)) if len(use) else 0
    steps, step = epochs * each, 0
    for _ in range(epochs):
        for batch in np.array_split(dice.permutation(use), each):
            if not len(batch):
                continue
            rate = RATE * (1 - step / steps)
            step += 1
            sizes = np.array([len(bags[i]) for i in batch])
            flat = np.concatenate([bags[i] for i in batch])
            hidden = np.add.reduceat(rows[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            scores = hidden @ weights + bias
            chance = np.exp(scores - scores.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(batch)), of[batch]] -= 1
            wrong = (chance / len(batch)).astype(np.float32)
            back = (wrong @ weights.T / sizes[:, None]).astype(np.float32)
            weights -= rate * (hidden.T @ wrong).astype(np.float32)
            bias -= rate * wrong.sum(axis=0)
            owner = np.repeat(np.arange(len(batch)), sizes)
            cell, where = np.unique(flat * len(batch) + owner, return_counts=True)
            bucket, own = np.divmod(cell, len(batch))
            np.add.at(rows, bucket, -rate * where[:, None].astype(np.float32) * back[own])
    seen = np.zeros((BUCKETS, 1), np.float32)
    for i in use:
        seen[bags[i]] = 1
    model = Model(languages, np.hstack([rows @ weights, seen]).astype(np.float32), bias.astype(np.float64))
    if held.any():
        _calibrate(model, [t for t, h in zip(texts, held) if h], y[held])
    return model


def _calibrate(model: Model, texts: list[str], y: np.ndarray) -> None:
    """The temperature of least loss on held-out texts, then both limits."""
    column = pa.array(texts, pa.string())
    mean, size = model.means(column)
    some = size > 0
    if not some.any():
        return
    scores, y = (mean[:, :-1] + model.bias)[some], y[some]

    def loss(t: float) -> float:
        z = scores / t
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))

    model.temperature = min(np.geomspace(0.1, 10, 81), key=loss)
    best, most, _ = model.predict(column)
    right = best[some] == y
    if right.any():
        model.least = float(np.quantile(most[some][right], REJECTED))
        model.least_seen = float(np.quantile(mean[some][right][:, -1], REJECTED))


def sample(df: DataFrame, label_col: str, id_col: str, text_col: str, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[list[str], list[str]]:
    """Texts and labels to train on: up to ``rows`` for each language, by a hash of the id."""
    spread = 1 << 20
    key = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)), F.lit(spread))
    fit = df.where(F.col(label_col).isNotNull() & F.length(text_col).between(1, chars)).select(key.alias("key"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    counts = {r.label: r["count"] for r in fit.groupBy("label").count().collect()}  # a row for each language
    if not counts:
        return [], []
    # half as many again as are wanted, so that the lowest keys are surely among them
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(spread, int(spread * (1.5 * rows + 20) / n) + 1))).otherwise(share)
    drawn = fit.where(F.col("key") < share).limit(4 * (rows + 20) * len(counts)).toArrow().to_pylist()
    taken: dict[str, int] = {}
    out = []
    for row in sorted(drawn, key=lambda r: (r["key"], r["label"], r["text"])):
        if taken.get(row["label"], 0) < rows:
            taken[row["label"]] = taken.get(row["label"], 0) + 1
            out.append(row)
    return [r["text"] for r in out], [r["label"] for r in out]


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, language, confidence, accepted)`` of every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the corpus

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), BYTES_AT_ONCE):
                if own is None:
                    best, most, good = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
                else:
                    best, most, good = own.predict(texts)
                names = np.array([*(own.languages if own else []), UNKNOWN], object)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(names[best], pa.string()), pa.array(np.round(most, 4)), pa.array(good)],
                    names=["doc_id", "language", "confidence", "accepted"],
                )
                at += len(texts)

    kind = df.schema[id_col].dataType.simpleString()
    plain = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(work, f"doc_id {kind}, language string, confidence double, accepted boolean")


def languages(df: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on a bounded sample of the labelled rows and identify every row."""
    return identify(df, train(*sample(df, label_col, id_col, text_col)), id_col, text_col)
