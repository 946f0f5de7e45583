"""Quality classifier: logistic regression on hashed word n-grams, trained
with follow-the-regularised-leader updates, scored as sparse dot products.

A text's features are its words and word pairs, each as written and as its
shape (which kinds of characters it has, and whether it repeats the word
before), hashed to ``BUCKETS`` numbers and counted relative to the text's
length. Nothing but the text enters a score.

Training reads at most ``TRAIN_ROWS`` labelled rows (a documented bound: the
rows whose document id hashes lowest); features are made in parallel and
packed in about four bytes each, the sequential updates run in one task over
that bounded set and unpack one text at a time. Scoring covers every row and
whole texts.

Defined results: a null or empty text has no features and gets the score of
the intercept; repeated rows score alike; labels other than 0 and 1 and rows
without a document train nothing; without any training row the score is 0.5.
A column with the name of the score is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.shared import released
from tablewright.llm.words import Words, mix, slices, words
from tablewright.names import quote_ident

BUCKETS = 1 << 18
TRAIN_ROWS = 8_000
EPOCHS = 4
#: Scale of relative frequencies, and the updates' rate, smoothing and penalties.
SCALE, ALPHA, BETA, L1, L2 = 4.0, 0.3, 1.0, 0.02, 0.02


def _classes() -> np.ndarray:
    kinds = np.full(256, 16, np.uint8)  # other signs
    kinds[[ord(c) for c in ".,;:?'\"()-"]] = 8
    kinds[ord("0") : ord("9") + 1] = 4
    kinds[ord("A") : ord("Z") + 1] = 2
    kinds[ord("a") : ord("z") + 1] = 1
    kinds[128:] = 32
    return kinds


_KINDS = _classes()


def _buckets(found: Words) -> np.ndarray:
    """Bucket numbers, four per word: word, pair, shape, pair of shapes."""
    n = len(found.starts)
    if not n:
        return np.zeros((0, 4), np.int64)
    edges = np.stack([found.starts, found.ends], 1).ravel()
    kinds = _KINDS[found.data]
    shape = np.bitwise_or.reduceat(kinds, edges[:-1] if edges[-1] == len(kinds) else edges)[::2].astype(np.uint64)
    shape |= (_KINDS[found.data[found.starts]] == 2).astype(np.uint64) << np.uint64(6)
    first = np.zeros(n, bool)
    first[found.bounds[:-1][np.diff(found.bounds) > 0]] = True
    last_word = np.where(first, 0, np.roll(found.hashes, 1)).astype(np.uint64)
    shape |= (last_word == found.hashes).astype(np.uint64) << np.uint64(7)
    last_shape = np.where(first, 1 << 8, np.roll(shape, 1)).astype(np.uint64)
    keys = np.stack([found.hashes, last_word * np.uint64(3) + found.hashes, shape + np.uint64(1 << 10), (last_shape << np.uint64(9)) + shape + np.uint64(1 << 20)], 1)
    return (mix(keys) % np.uint64(BUCKETS)).astype(np.int64)


#: Bytes of text scored, or packed, together.
SLICE = 1_000_000
#: Bytes of text read into features at once; some forty times as many bytes are held for them.
READ = 128_000


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def margins(self, column: pa.Array) -> np.ndarray:
        sums, n = [np.zeros(1)], [np.zeros(0, np.int64)]
        for part in slices(pa.record_batch([column], ["text"]), 0, READ):
            found = words(part.column(0), lower=False)
            sums.append(self.weights[_buckets(found)].sum(1))
            n.append(np.diff(found.bounds))
        total, n = np.cumsum(np.concatenate(sums)), np.concatenate(n)
        return self.bias + SCALE * np.diff(total[np.concatenate([[0], np.cumsum(n)])]) / np.maximum(n, 1)


def _updates(rows: Callable[[], Iterator[tuple[np.ndarray, np.ndarray, float]]]) -> Model:
    """``rows`` gives the examples anew for each epoch, so that one of them at a time is unpacked."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(EPOCHS):
        for at, x, y in rows():
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(w[:-1], float(w[-1]))


def _short(v: np.ndarray) -> bytes:
    """Numbers of the least width that holds them all."""
    return v.astype(np.min_scalar_type(v.max(initial=0))).tobytes()


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Id, label and text to id, label and features: how many, the steps between their buckets, their counts."""
    many, steps, counts = [], [], []
    for part in slices(batch, 2, READ):
        found = words(part.column(2), lower=False)
        buckets = _buckets(found)
        for a, b in zip(found.bounds, found.bounds[1:]):
            which, count = np.unique(buckets[a:b], return_counts=True)
            many.append(len(which))
            steps.append(_short(np.diff(which, prepend=0)))
            counts.append(_short(count))
    columns = pa.array(many, pa.int32()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["__id", "__y", "many", "steps", "counts"])


def _fitted(table: pa.Table) -> Model:
    """The model of packed examples, which stay as they came: an epoch unpacks one at a time."""
    ids = [crc32(str(i).encode()) for i in table["__id"].to_pylist()]
    ys, many = table["__y"].to_pylist(), table["many"].to_pylist()
    steps, counts = ([v.as_buffer() for v in table[c]] for c in ("steps", "counts"))
    one = np.ones(1)

    def numbers(v: pa.Buffer, n: int) -> np.ndarray:
        return np.frombuffer(v, f"u{len(v) // max(n, 1) or 1}").astype(np.int64)

    def at(i: int) -> np.ndarray:
        return np.cumsum(numbers(steps[i], many[i]))

    def rows() -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        for i in order:
            count = numbers(counts[i], many[i])
            x = (count * (SCALE / max(count.sum() // 4, 1))).astype(np.float32)  # four features a word
            yield np.append(at(i), BUCKETS), np.append(x.astype(float), one), ys[i]

    def key(i: int) -> tuple[int, float]:
        return ids[i], ys[i]

    alike = groupby(sorted(range(len(ids)), key=key), key)
    order = [i for _, tied in alike for i in sorted(tied, key=lambda i: at(i).astype(np.int32).tobytes())]
    return _updates(rows)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """The model of at most ``rows`` labelled rows outside the held-out fifth."""
    key = F.col(quote_ident(doc_id))
    marks = labels.select(key.alias("__id"), F.col(quote_ident(label)).cast("double").alias("__y")).filter("__y in (0, 1)")
    marks = marks.filter(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id", "__y").limit(rows)
    texts = docs.select(key.alias("__id"), F.col(quote_ident(text)).alias("__text"))
    sample = texts.join(F.broadcast(marks), "__id").select("__id", "__y", "__text")  # at most `rows` rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                yield _packed(part)

    def fit(table: pa.Table) -> pa.Table:
        model = _fitted(table)
        return pa.table({"weights": pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([model.bias])})

    schema = T.StructType([sample.schema["__id"], sample.schema["__y"], *(T.StructField(c, t) for c, t in (("many", T.IntegerType()), ("steps", T.BinaryType()), ("counts", T.BinaryType())))])
    fitted = sample.mapInArrow(released(features), schema).withColumn("__all", F.lit(True)).groupBy("__all").applyInArrow(fit, "weights binary, bias double").collect()
    if not fitted:
        return Model(np.zeros(BUCKETS), 0.0)
    return Model(np.frombuffer(bytes(fitted[0].weights), np.float32).astype(float), fitted[0].bias)


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the probability of label 1."""
    df = df.drop(name)
    at = df.columns.index(text)
    small = model.weights.astype(np.float32), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(small[0].astype(float), small[1])
        for batch in batches:
            for part in slices(batch, at, SLICE):
                value = 1 / (1 + np.exp(-np.clip(own.margins(part.column(at)), -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value)], names=[*part.schema.names, name])

    return df.mapInArrow(released(run), T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))
