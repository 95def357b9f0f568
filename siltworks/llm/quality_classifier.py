"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax, numpy SGD.

Learning takes a bounded sample of labelled rows (``max_rows``, those of least
hash of the id) whose features are counted on executors; the fit runs on the
driver over that sample.  Once learnt, vector times output weights is one number
a bucket, so a text's score is a softmax over the average of its buckets' numbers,
worked out where the texts are; nothing is shuffled.

Defined cases: null and empty text have no n-grams and score the learnt bias;
without labels of both classes all scores are the share of label 1 (0.5 with no
labels); labels other than 0 and 1 are skipped; of repeated labels for one
id the mean decides, 0.5 counting as 1; repeated documents are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.features import ngrams

BUCKETS, DIM, SIZES, WORD_ORDERS = 1 << 18, 8, (3, 4), (1, 2)
#: Rows to learn from, at most.
MAX_ROWS = 4000
#: Steps over single rows that learning takes, about, at whatever number of rows.
VISITS = 12_000
THRESHOLD = 0.3


@dataclass
class Model:
    value: np.ndarray
    bias: float
    buckets: int
    sizes: tuple[int, ...]
    word_orders: tuple[int, ...]


def _featurise(buckets: int, sizes: tuple[int, ...], word_orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights = [b""] * batch.num_rows, [b""] * batch.num_rows
            for i, j, bucket, row in ngrams(batch, sizes, buckets, word_orders):
                key, count = np.unique(row * buckets + bucket, return_counts=True)
                split = np.searchsorted(key, np.arange(j - i + 1) * buckets)
                for r in range(j - i):
                    part = slice(split[r], split[r + 1])
                    ids[i + r] = (key[part] & (buckets - 1)).astype(np.uint32).tobytes()
                    weights[i + r] = (count[part] / max(1, count[part].sum())).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], names=["doc_id", "label", "ids", "weights"])

    return run


def sgd(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int, dim: int = DIM, visits: int = VISITS, rate: float = 2.0, batch: int = 16, seed: int = 11) -> tuple[np.ndarray, float]:
    """(number of each bucket, bias) after minibatch descent on (label, ids, weights) rows."""
    rng = np.random.default_rng(seed)
    labels = np.array([r[0] for r in rows], np.float32)
    if len(rows) == 0 or labels.min() == labels.max():
        share = min(max(labels.mean() if len(rows) else 0.5, 1e-3), 1 - 1e-3)
        return np.zeros(buckets, np.float32), float(np.log(share / (1 - share)))
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    done, total = 0, max(visits, 2 * len(rows))
    while done < total:
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            lr = rate * max(0.02, 1 - done / total)
            ids = np.concatenate([rows[r][1] for r in part])
            weights = np.concatenate([rows[r][2] for r in part])
            cuts = np.concatenate([[0], np.cumsum([len(rows[r][1]) for r in part])])
            hidden = np.stack([weights[a:b] @ vectors[ids[a:b]] for a, b in pairwise(cuts)])
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part].astype(int)] -= 1
            back = lr * (p @ out.T)
            out -= lr * hidden.T @ p / len(part) * 4
            bias -= lr * p.mean(axis=0)
            for k, (a, b) in enumerate(pairwise(cuts)):  # a row names each bucket once
                vectors[ids[a:b]] -= weights[a:b, None] * back[k]
            done += len(part)
    side = out[:, 1] - out[:, 0]
    return vectors @ side, float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None = None, max_rows: int = MAX_ROWS, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES, word_orders: tuple[int, ...] = WORD_ORDERS) -> Model:
    """Learn from at most ``max_rows`` rows of ``labels`` (doc_id, ``label``), those of least hash, where ``usable`` holds."""
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    known = known.filter(usable) if usable is not None else known
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    made = texts.mapInArrow(_featurise(buckets, sizes, word_orders), "doc_id long, label int, ids binary, weights binary").toArrow()
    rows = sorted(zip(made.column("doc_id").to_pylist(), made.column("label").to_pylist(), made.column("ids").to_pylist(), made.column("weights").to_pylist(), strict=True))
    value, bias = sgd([(y, np.frombuffer(i, np.uint32), np.frombuffer(w, np.float32)) for _, y, i, w in rows], buckets)
    return Model(value.astype(np.float32), bias, buckets, sizes, word_orders)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = np.zeros((2, batch.num_rows))
            for i, j, bucket, row in ngrams(batch, model.sizes, model.buckets, model.word_orders):
                total[i:j] = np.bincount(row, model.value[bucket], j - i)
                count[i:j] = np.bincount(row, minlength=j - i)
            z = total / np.maximum(count, 1) + model.bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: the probability of label 1."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows are never seen."""
    model = fit(docs, labels, "quality", ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
