"""Exact cosine search as column expressions, and in blocks for many probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def cosine(x: Column, y: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    fits = (F.size(x) == F.size(y)) & (F.size(x) > 0)
    return F.when(fits & (norm(x) > 0) & (norm(y) > 0), dot(x, y) / (norm(x) * norm(y))).otherwise(0.0)


#: Probes of a block, from which on probes meet the vectors in blocks; vectors of a block, and parts that the blocks of vectors are dealt into, if the session has no more partitions.
BLOCK, ROWS, PARTS = 64, 2048, 64
#: Probes of a block where there are many blocks.
WIDE = 512
#: What a product of matrices may differ by from a sum in order; squares of norms outside these bounds aren't left to it.
SLACK, LEAST, MOST = 1e-9, 1e-250, 1e250


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the vectors, the vectors padded by zeros); a vector that is null or holds a null has length 0."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, owner = pc.list_flatten(lists), np.repeat(np.arange(len(lists)), size)
    out = np.zeros((len(lists), size.max(initial=0)))
    out[owner, np.arange(len(owner)) - (np.cumsum(size) - size)[owner]] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        size[owner[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = 0
        out[size == 0] = 0.0
    return size, out


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first place to the last as ``dot`` does."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total = total + x[:, k] * y[:, k]
    return total


def _best(threshold: float, k: int):
    """(blocks of vectors and of probes, both sorted by id) to the ``k`` best of each probe in the block.

    A product of matrices finds who may be among the best; their scores are then summed in order.
    """

    def pick(vectors: pa.Array, probes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (n, x), (m, y) = _matrix(vectors), _matrix(probes)
        wide = max(x.shape[1], y.shape[1])
        x, y = (np.pad(a, ((0, 0), (0, wide - a.shape[1]))) for a in (x, y))
        xx, yy = _in_order(x, x), _in_order(y, y)
        plain = lambda s: np.isfinite(s) & (s > LEAST) & (s < MOST)
        unit = lambda a, s: a / np.sqrt(np.where(plain(s), s, np.inf))[:, None]
        sure_x, sure_y = plain(xx) | (xx == 0), plain(yy) | (yy == 0)
        odd = ~sure_x
        about = unit(np.where(sure_y[:, None], y, 0.0), yy) @ unit(np.where(sure_x[:, None], x, 0.0), xx).T
        about[m[:, None] != n[None, :]] = 0.0
        limit = np.full(len(y), threshold - SLACK)
        if len(x) > k:
            rest = np.where(odd[None, :], -np.inf, about)
            limit = np.maximum(limit, np.partition(rest, len(x) - k, axis=1)[:, len(x) - k] - SLACK)
        may = (about >= limit[:, None]) | odd[None, :] | ~sure_y[:, None]
        q, v = np.nonzero(may)
        dots = _in_order(y[q], x[v])
        fits = (m[q] == n[v]) & (m[q] > 0) & ((xx[v] > 0) | np.isnan(xx[v])) & ((yy[q] > 0) | np.isnan(yy[q]))
        score = np.zeros(len(q))
        score[fits] = dots[fits] / (np.sqrt(xx[v][fits]) * np.sqrt(yy[q][fits]))
        some = (score >= threshold) | np.isnan(score)
        q, v, score = q[some], v[some], score[some]
        # As Spark sorts: what isn't a number first, then by score; ties by id, which is the place in the block.
        order = np.lexsort((v, -score, ~np.isnan(score), q))
        q, v, score = q[order], v[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return q[place < k], v[place < k], score[place < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                vectors, probes = (batch.column(c)[r].values for c in ("vectors", "probes"))
                with np.errstate(all="ignore"):
                    q, v, score = pick(vectors.field("v"), probes.field("probe"))
                yield pa.RecordBatch.from_arrays([probes.field("query").take(pa.array(q)), vectors.field("id").take(pa.array(v)), pa.array(score)], names=["query", "id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, threshold: float, k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, id, score): the ``k`` best of each query at or above ``threshold``, ties by id.

    Up to ``BLOCK`` queries (a request's expansions) are gathered into one literal row
    and every vector is scanned once.  More are dealt into blocks by hash, and the blocks are
    copied to every part of the vectors; a vector is sent once, in a block of its part, and meets all
    blocks of probes there, so the rows sent grow with the vectors and, times the parts, with the
    blocks.  Two blocks are scored by one product of matrices, and only the ``k`` best of each query
    in a block go on.
    """
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    n = queries.count()
    if n <= BLOCK:
        probe = F.struct("query", doubles(F.col("probe")).alias("probe"))
        scored = vectors.select(F.col(id).alias("id"), doubles(F.col(vector)).alias("v"))
        met = scored.join(F.broadcast(queries.agg(F.collect_list(probe).alias("probes"))))
        each = met.select("id", "v", F.explode("probes").alias("p")).select(F.col("p.query").alias("query"), "id", cosine(F.col("v"), F.col("p.probe")).alias("score"))
        each = each.filter(F.col("score") >= threshold)
    else:
        in_block = lambda c, count, size: F.pmod(F.xxhash64(c), F.lit(-(-count // size)))
        gathered = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
        parts = max(PARTS, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = queries.groupBy(in_block("query", n, WIDE).alias("block")).agg(gathered("query", doubles(F.col("probe")).alias("probe")).alias("probes"))
        dealt = dealt.select("probes", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        blocks = vectors.select(F.col(id).alias("id"), doubles(F.col(vector)).alias("v")).withColumn("block", in_block("id", vectors.count(), ROWS))
        blocks = blocks.groupBy("block").agg(gathered("id", "v").alias("vectors")).select("vectors", F.pmod("block", F.lit(parts)).cast("int").alias("part"))
        met = blocks.join(dealt.hint("shuffle_merge"), "part").select("vectors", "probes")
        kinds = queries.select("query").schema["query"].dataType.simpleString(), vectors.schema[id].dataType.simpleString()
        each = met.mapInArrow(_best(threshold, k), f"query {kinds[0]}, id {kinds[1]}, score double")
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "id", "score")
